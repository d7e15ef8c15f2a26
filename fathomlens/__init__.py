"""Incident-memory analytics and text pipelines as Spark DataFrame operators."""
