"""Sensitive-data redaction and document reporting on Spark."""
