"""Operators of a training-data pipeline over the document tables.

One module an operator; ``queries`` registers them, ``common`` holds what they share.  Nothing
outside this subpackage imports it.
"""
