"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names, keeps whatever other columns the caller has out of its way, and is
lazy except where its docstring says that it writes intermediate results to the
shared folder (``spark.checkpoint.dir``).
"""
