"""Readers: files to DataFrames."""
