"""Monitoring analytics on PySpark: telemetry to features, correlation, groups and evaluation."""
