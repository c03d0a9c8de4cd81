"""Point-in-time risk analytics on Spark: every operator takes and returns lazy DataFrames.

``sources`` reads and normalises tables and documents, ``operators`` holds joins, windows, fitted statistics,
document analytics, quality, evaluation and models, ``functions`` column expressions, ``plans`` whole jobs,
and ``queries`` binds them to the test tables with the SQL they are compared with.  There are no stream
operators: a row counts from its publication date, which is the batch form of late data.
"""
