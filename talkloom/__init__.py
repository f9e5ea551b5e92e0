"""Chat-dataset preparation as PySpark DataFrame jobs."""
