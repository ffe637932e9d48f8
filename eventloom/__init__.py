"""Event and panel analytics expressed as Spark DataFrame jobs."""
