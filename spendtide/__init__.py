"""Competitive ad-spend analytics on PySpark.

Every operator takes DataFrames and returns DataFrames, for all brands at once.
"""
