"""Relational and sequence operators over the tables of books."""
