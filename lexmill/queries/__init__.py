"""Queries over the driver's tables, each with its SQL where that can express it."""

from lexmill.queries import corpus, lexicon, rules, search, steps, timeline  # noqa: F401
from lexmill.queries.registry import ORACLES, QUERIES  # noqa: F401
