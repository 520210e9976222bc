"""Phage-cohort annotation analytics as Spark DataFrame operators."""
