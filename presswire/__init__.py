"""presswire: news retrieval and data processing on Spark."""
