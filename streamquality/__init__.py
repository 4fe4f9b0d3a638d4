"""Quality analytics for filtered event streams, as Spark DataFrame jobs."""
