"""Search-term trend analytics as Spark DataFrame operators and jobs."""
