"""Scans over ordered rows of keys, also of keys that hold very many rows.

A window over a key is one task. Where a key has more than MOST rows, rows are range partitioned by key and order instead, so
that a key lies in many stretches; windows run over the stretches, a small table of what each stretch hands on (sums, last and first
values) is scanned over a key's stretches, and its values are merged into the rows. Results are the same either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.operators.durable import durable

MOST = 2_000_000


class Ordered:
    """Rows of keys in an order of named columns that leaves no ties; scan adds columns to rows. Keys may be null."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> None:
        self.keys, self.order = keys, order
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        self.split = largest > (MOST if most is None else most)
        self.rows = rows
        if self.split:
            placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
            self.rows = durable(placed.withColumn("_s", F.spark_partition_id()))  # where the ranges lie must not change between reads

    def scan(self, **columns: tuple[str, Column]) -> Ordered:
        """Adds name=(kind, value). Kinds: sum (running), total, last and next (value that is not null up to here, or from here on), lag, lead, first_row (value is not used)."""
        own = [*self.keys, "_s"] if self.split else self.keys
        w = Window.partitionBy(*own).orderBy(*self.order)
        back, ahead, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*own)
        local = {"sum": lambda v: F.sum(v).over(back), "total": lambda v: F.sum(v).over(whole), "last": lambda v: F.last(v, True).over(back), "next": lambda v: F.first(v, True).over(ahead), "lag": lambda v: F.lag(v).over(w), "lead": lambda v: F.lead(v).over(w), "first_row": lambda v: F.row_number().over(w) == 1}
        if not self.split:
            self.rows = self.rows.withColumns({n: local[kind](v) for n, (kind, v) in columns.items()})
            return self
        at = F.struct(*self.order)
        told = {  # what a stretch hands on
            "sum": F.sum, "total": F.sum, "lag": lambda v: F.max_by(F.struct(v.alias("v")), at), "lead": lambda v: F.min_by(F.struct(v.alias("v")), at),
            "last": lambda v: F.max_by(v, F.when(v.isNotNull(), at)), "next": lambda v: F.min_by(v, F.when(v.isNotNull(), at)), "first_row": lambda v: F.lit(True),
        }
        o = Window.partitionBy(*self.keys).orderBy("_s")
        before, after = o.rowsBetween(Window.unboundedPreceding, -1), o.rowsBetween(1, Window.unboundedFollowing)
        taken = {"sum": lambda c: F.sum(c).over(before), "total": lambda c: F.sum(c).over(Window.partitionBy(*self.keys)), "last": lambda c: F.last(c, True).over(before), "next": lambda c: F.first(c, True).over(after), "lag": lambda c: F.lag(c).over(o), "lead": lambda c: F.lead(c).over(o), "first_row": lambda c: F.lag(c).over(o)}
        edges = self.rows.groupBy(*self.keys, "_s").agg(*(told[kind](v).alias(f"_t_{n}") for n, (kind, v) in columns.items()))
        carried = edges.select(*(F.col(k).alias(f"_k_{k}") for k in [*self.keys, "_s"]), *(taken[kind](F.col(f"_t_{n}")).alias(f"_c_{n}") for n, (kind, _) in columns.items()))
        end = {"lag": F.row_number().over(w) == 1, "lead": F.lead(F.lit(1)).over(w).isNull()}
        rows = self.rows.withColumns({f"_l_{n}": local[kind](v) for n, (kind, v) in columns.items()} | {f"_e_{k}": end[k] for k in {kind for kind, _ in columns.values()} & end.keys()})
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*self.keys, "_s"]))
        met = rows.join(carried, same, "left")
        merge = {
            "sum": lambda n: F.when(F.col(f"_l_{n}").isNull(), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.col(f"_l_{n}") - F.col(f"_l_{n}"))),
            "total": lambda n: F.col(f"_c_{n}"), "last": lambda n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")), "next": lambda n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")),
            "lag": lambda n: F.when(F.col("_e_lag"), F.col(f"_c_{n}")["v"]).otherwise(F.col(f"_l_{n}")), "lead": lambda n: F.when(F.col("_e_lead"), F.col(f"_c_{n}")["v"]).otherwise(F.col(f"_l_{n}")),
            "first_row": lambda n: F.col(f"_l_{n}") & F.col(f"_c_{n}").isNull(),
        }
        kept = [c for c in self.rows.columns if c not in columns]
        self.rows = met.select(*kept, *(merge[kind](n).alias(n) for n, (kind, _) in columns.items()))
        return self

    def done(self, *columns: str | Column) -> DataFrame:
        """The rows with these columns (all but helpers by default)."""
        return self.rows.select(*(columns or [c for c in self.rows.columns if not c.startswith("_")]))
