"""Quality checks for field-survey polygons, written as Spark jobs."""
