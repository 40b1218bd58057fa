"""Cohort analytics on time-stamped clinical measurements, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
