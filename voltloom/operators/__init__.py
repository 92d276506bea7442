"""Relational and graph operators; each takes DataFrames and returns DataFrames."""
