"""Training-data operators: tokenising, scoring, filtering, deduplication, archives.

Nothing else in the library imports this subpackage.  Every module works on
DataFrames with a text column; ``queries`` holds the registered queries.
"""
