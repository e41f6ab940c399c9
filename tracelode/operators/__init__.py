"""Operators on profile tables; each takes and returns DataFrames."""
