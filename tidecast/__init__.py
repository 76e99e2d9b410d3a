"""Point-in-time analytics for two-sided timed results, as Spark DataFrame operators."""
