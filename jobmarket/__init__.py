"""Job-market analytics as PySpark DataFrame jobs."""
