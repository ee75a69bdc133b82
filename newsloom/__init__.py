"""Article monitoring and retrieval analytics as Spark DataFrame functions."""
