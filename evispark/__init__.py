"""evispark: evidence screening and data preparation as Spark DataFrame jobs."""
