"""A Spark-first engine for analytics over text, code and activity records."""
