"""Relational, window, aggregate and sequence operators. Each takes and returns DataFrames."""
