"""Retail sales, review and forecast analytics as Spark DataFrame jobs."""
