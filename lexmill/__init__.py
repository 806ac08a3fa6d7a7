"""Lexicon and parallel-corpus analytics as DataFrame functions on Spark."""
