"""Reference tables and settings that plans are parameterised with."""
