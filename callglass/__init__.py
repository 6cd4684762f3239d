"""Log analytics for model calls, written as Spark DataFrame jobs."""
