"""Screening, ranking and review of entities and documents as Spark DataFrame jobs."""
