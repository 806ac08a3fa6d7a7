"""Upserts as functions from the old table and a batch to the new table. Running one twice changes nothing more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.operators.picks import pick


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old, and of new the first row of each key that old has not. Keys are equal where their columns are, nulls included."""
    n, o = pick(new, keys, order).alias("n"), old.select(*keys).distinct().alias("o")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return old.unionByName(n.join(o, same, "left_anti").select(*(F.col(f"n.{c}") for c in old.columns)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], set_columns: dict[str, Column], order: list[str]) -> DataFrame:
    """Rows of both tables by key (unique in old; of new the first by order). Where both have a key, the columns of set_columns are set; their expressions see old's columns as o.name and new's as n.name.

    Keys may hold nulls, which are equal to each other; markers, not keys, tell which table a row is from.
    """
    o, n = old.withColumn("_in_old", F.lit(True)).alias("o"), pick(new, keys, order).withColumn("_in_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    in_old, in_new = F.col("o._in_old").isNotNull(), F.col("n._in_new").isNotNull()
    value = lambda c: F.when(in_old & in_new, set_columns[c] if c in set_columns else F.col(f"o.{c}")).when(in_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(*(value(c) for c in old.columns))


def upsert_max(old: DataFrame, new: DataFrame, keys: list[str], column: str, order: list[str]) -> DataFrame:
    """On conflict the larger value stays; other columns stay as they were."""
    return upsert(old, new, keys, {column: F.greatest(f"o.{column}", f"n.{column}")}, order)


def upsert_guarded(old: DataFrame, new: DataFrame, keys: list[str], column: str, source: str, protected: list[str], order: list[str]) -> DataFrame:
    """As upsert_max, but rows of a protected source, or without one, are left alone."""
    locked = F.col(f"o.{source}").isin(protected) | F.col(f"o.{source}").isNull()
    return upsert(old, new, keys, {column: F.when(locked, F.col(f"o.{column}")).otherwise(F.greatest(f"o.{column}", f"n.{column}"))}, order)


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """On conflict the columns are taken from the new row."""
    return upsert(old, new, keys, {c: F.col(f"n.{c}") for c in columns}, order)


def boost(old: DataFrame, new: DataFrame, keys: list[str], column: str, source: str, order: list[str]) -> DataFrame:
    """On conflict a higher value replaces value and source; else both stay."""
    higher = F.col(f"n.{column}") > F.col(f"o.{column}")
    return upsert(old, new, keys, {column: F.greatest(f"o.{column}", f"n.{column}"), source: F.when(higher, F.col(f"n.{source}")).otherwise(F.col(f"o.{source}"))}, order)


def purge(rows: DataFrame, *conditions: Column) -> DataFrame:
    """rows without those for which a condition holds; an unknown condition deletes nothing."""
    for c in conditions:
        rows = rows.where(~F.coalesce(c, F.lit(False)))
    return rows
