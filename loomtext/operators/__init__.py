"""Operators over DataFrames: postings, search, catalogue, upsert."""
