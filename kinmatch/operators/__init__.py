"""Relational operators of entity resolution: pairs in, pairs or clusters out."""
