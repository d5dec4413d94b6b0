"""Spark operators for large tagged image libraries.

Every operator takes DataFrames and plain parameters and returns DataFrames;
the work stays on the executors.
"""
