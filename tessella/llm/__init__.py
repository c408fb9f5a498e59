"""Training-data operators.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
subpackage imports it.
"""
