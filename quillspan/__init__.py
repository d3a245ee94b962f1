"""Text analytics, hybrid retrieval and corpus preparation on PySpark."""
