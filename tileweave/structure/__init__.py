"""Declarative binary structures: definitions, expressions, reading and writing."""
