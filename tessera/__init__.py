"""Schema-driven data quality, document query and data processing on Spark."""
