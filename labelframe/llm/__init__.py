"""Operators for training-data pipelines: filters, near duplicates, packing, archives, scoring.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin queries that apply them to the
tables and the SQL that states their results.
"""
