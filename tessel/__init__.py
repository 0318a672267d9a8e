"""Product retrieval, ranking and text analytics written for Spark's DataFrame API."""
