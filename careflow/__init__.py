"""Clinical time-series analytics as PySpark DataFrame functions."""
