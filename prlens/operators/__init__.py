"""Operators: DataFrame-to-DataFrame transformations, one per SURVEY §2 row."""
