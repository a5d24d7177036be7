"""Scalar functions: Spark column expressions, and Python for metadata-sized work."""
