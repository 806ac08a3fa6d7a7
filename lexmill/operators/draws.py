"""Seeded draws of an exact size, by the smallest hashes: the same rows whatever the partitions, and no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.operators.durable import durable


def order_of(key: Column, seed: int) -> Column:
    """A number from the seed and the key alone, that SQL can repeat."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 16)


def draw(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest numbers (all, if fewer), ties by key. Each task keeps n rows, which are merged; null keys are not drawn."""
    return rows.where(F.col(key).isNotNull()).withColumn("_h", order_of(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def draw_accepted(rows: DataFrame, key: str, n: int, accept, seed: int = 42, attempts: int = 20) -> DataFrame:
    """The first n accepted rows in the order of their numbers, of the first attempts * n rows of that order: rejection sampling with bounded attempts.

    accept: a function from drawn rows to the accepted ones (a filter, or joins that keep the key); it sees the next n of
    the order first, then twice as many, and so on, until enough are accepted or all attempts are used, so dear tests run on few rows.
    """
    placed = durable(draw(rows, key, attempts * n, seed).withColumn("_h", order_of(F.col(key), seed)))
    looked = n
    while True:
        part = placed.orderBy("_h", key).limit(looked)
        got = accept(part)
        if looked >= attempts * n or got.count() >= n:
            return got.orderBy(order_of(F.col(key), seed), key).limit(n)
        looked = min(2 * looked, attempts * n)
