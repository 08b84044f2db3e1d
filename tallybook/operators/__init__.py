"""Operators over whole tables: record linkage, comparison of documents, aggregation, time."""
