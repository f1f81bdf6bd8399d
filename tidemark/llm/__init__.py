"""Training-data operators: each takes and returns DataFrames.

Nothing outside this package imports it.
"""
