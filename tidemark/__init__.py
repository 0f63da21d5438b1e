"""Water-quality anomaly analytics as Spark DataFrame jobs."""
