"""Training-data operators: cleaning, deduplication, scoring, tokenising and sharding of text tables.

Nothing else in the library imports this subpackage. Every module holds one
operator with a general interface; ``queries`` applies each to the driver's
tables.
"""
