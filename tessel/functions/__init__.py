"""Column functions: text, vectors, scores and boxes.  All stay inside the JVM."""
