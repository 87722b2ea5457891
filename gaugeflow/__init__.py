"""Streaming telemetry analytics on Spark."""
