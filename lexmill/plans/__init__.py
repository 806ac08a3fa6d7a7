"""Whole plans made of the operators: phrase mining, evaluation, curation, serving."""
