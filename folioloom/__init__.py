"""Restructuring of paged documents, many books at once, as DataFrame operations."""
