"""Dataset analytics as Spark DataFrame functions.

Every operator takes DataFrames and returns a DataFrame; nothing in the library collects rows.
"""
