"""Measurement analytics for two-colour microscopy tables, written as Spark jobs."""
