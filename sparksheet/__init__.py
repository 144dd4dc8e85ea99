"""Spreadsheet semantics on Spark DataFrames."""
