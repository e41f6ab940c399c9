"""Execution-profile analytics on Spark: labelled control-flow graphs of passing and failing runs as DataFrames."""
