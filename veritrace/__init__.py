"""Trace conformance and answer grading as Spark DataFrame jobs."""
