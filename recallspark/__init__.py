"""Knowledge-memory analytics as Spark DataFrame jobs."""
