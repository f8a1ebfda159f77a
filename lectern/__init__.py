"""Lectern: book-intelligence analytics as PySpark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame, keyed by book,
session, request or run.  Nothing here owns state: tables go in, tables come
out, and Catalyst picks the physical plan.
"""
