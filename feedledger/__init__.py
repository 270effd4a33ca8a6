"""Push-event ingestion, entity state and reporting as Spark jobs."""
