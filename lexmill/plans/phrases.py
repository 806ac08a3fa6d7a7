"""Phrase mining from aligned texts: n-grams of one side, words or n-grams of the other, scored and cut to the best per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.text import dice
from lexmill.operators.picks import top_n
from lexmill.operators.stats import cooccurrence


def phrase_pairs(units: DataFrame, key: str, a: str, b: str, least: int = 3, least_dice: float = 0.15, n: int = 2, marginal: str = "doc") -> DataFrame:
    """a, b, together, a_n, b_n, score: the n best b of each a by score, ties to the smaller."""
    # two items share at most the units of the rarer one: where even that is too little, no pair is made
    may = dice(F.least("a_n", "b_n"), F.col("a_n"), F.col("b_n"))["dice"] >= least_dice
    pairs = cooccurrence(units, key, a, b, least, marginal, may)
    s = dice(F.col("together"), F.col("a_n"), F.col("b_n"))
    scored = pairs.withColumn("score", s["score"]).where(s["dice"] >= least_dice)
    return top_n(scored, [a], [F.desc("score"), F.asc(b)], n).drop("rank")
