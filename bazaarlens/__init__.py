"""Price intelligence and training-data preparation as Spark DataFrame jobs."""
