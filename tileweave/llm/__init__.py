"""Training-data operators: scoring, deduplication, filtering, sharding and tokenising of text corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` registers one thin query per operator.
"""
