"""Day-graph analytics as Spark DataFrame jobs."""
