"""Posting intelligence on PySpark: sources, text functions, operators, plans and streaming twins."""
