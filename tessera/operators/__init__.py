"""Operators over queries, passages and graphs; each takes and returns DataFrames."""
