"""Tracewright: metadata, lineage and code-graph analytics on Spark DataFrames."""
