"""Batch analytics on PySpark: cleaning, matching, gap filling, star schemas and reports as DataFrame functions."""
