"""First, last and best per key, top n per key, deduplication. Ties are always broken by named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.operators.durable import durable

from lexmill import vocab


def pick(df: DataFrame, keys: list[str], order: list[Column | str], keep: str = "first") -> DataFrame:
    """The first or last row of each key under the order; one aggregation with map-side combine, no sort of a key's rows."""
    cols = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    chosen = (F.min_by if keep == "first" else F.max_by)(F.struct(*cols), by).alias("_r")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_r.*").select(df.columns)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key. The filter on the row number lets Spark cut each key's rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def source_rank(source: Column, ranks: dict[str, int] = vocab.SOURCE_RANK) -> Column:
    table = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[source], F.lit(0))


def best_source(df: DataFrame, keys: list[Column], rank: Column, seq: str) -> DataFrame:
    """The row of best rank for each folded key; ties keep the earliest."""
    names = [f"_k{i}" for i in range(len(keys))]
    return pick(df.withColumns(dict(zip(names, keys, strict=True))).withColumn("_rank", -rank), names, ["_rank", seq]).drop(*names, "_rank")


def first_of(df: DataFrame, keys: list[Column], seq: str) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    return pick(df.withColumns(dict(zip(names, keys, strict=True))), names, [seq]).drop(*names)


def tiered_cap(tiers: list[DataFrame], key: str, order: list[Column | str], cap: int) -> DataFrame:
    """key and tier of the first cap keys: tiers in their order, a key in its first tier alone, by the order within a tier."""
    rows = None
    for t, df in enumerate(tiers):
        part = df.select(key).withColumn("tier", F.lit(t))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min("tier").alias("tier")).orderBy("tier", *order).limit(cap)


def hash_sample(df: DataFrame, key: Column, of: int, below: int, multiplier: int = 2654435761) -> DataFrame:
    """A sample that depends on the key alone, and that SQL can repeat."""
    return df.where(F.pmod(key.cast("long") * multiplier, F.lit(of)) < below)


def page(df: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """One page of the rows; only as many rows as pages up to it hold are kept while sorting."""
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def number_rows(df: DataFrame, order: list[Column | str], name: str = "id") -> DataFrame:
    """Consecutive numbers from 1 in the order, without moving all rows to one task: range partitions, then their offsets.

    The placed rows are kept once, as both their counts and they themselves are read.
    """
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_low"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_m") - F.col("_low") + F.col("_before") + 1).drop("_p", "_m", "_low", "_before")


def relax(candidates: DataFrame, keys: list[str], tiers: list[Column], enough: Column) -> DataFrame:
    """Per key the candidates of the first tier that has enough; of the last tier if none has."""
    tagged = None
    for i, tier in enumerate(tiers):
        part = candidates.where(tier).withColumn("tier", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    sizes = tagged.groupBy(*keys, "tier").agg(F.count("*").alias("_n"), enough.alias("_ok"))
    chosen = sizes.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("tier"))), F.lit(len(tiers) - 1)).alias("tier"))
    return tagged.join(chosen, [*keys, "tier"])
