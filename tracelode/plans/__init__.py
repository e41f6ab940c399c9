"""Queries: how the operators are composed over the driver's tables, and the SQL that states the same."""
