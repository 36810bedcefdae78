"""Access-event and document analytics as PySpark DataFrame jobs."""
