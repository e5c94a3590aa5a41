"""Functional-data analytics on PySpark: every observation is a curve stored as a row."""
