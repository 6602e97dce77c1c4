"""Catalogue of queries over imagery-shaped views of the test tables."""
