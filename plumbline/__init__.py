"""Data readiness on Spark."""
