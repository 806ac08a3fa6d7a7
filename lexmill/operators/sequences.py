"""Ordered rows: running targets, gap fill, islands, repeats, adjacent rows, dictionary pages."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexmill.functions.text import HEADWORD_LINE
from lexmill.operators.stretches import Ordered


def structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def proportional_targets(rows: DataFrame, keys: list[str], order: list[str], size: str, total: Column, most: int | None = None) -> DataFrame:
    """rows with cum (running size) and target (total times its share, cut to an integer; null where the sizes of a key sum to 0). most: see Ordered, as below."""
    out = Ordered(rows, keys, order, most).scan(cum=("sum", F.col(size)), _whole=("total", F.col(size))).rows
    return out.select(*rows.columns, "cum", F.floor(total * F.col("cum") / F.nullif(F.col("_whole"), F.lit(0))).alias("target"))


def fill_gaps(rows: DataFrame, keys: list[str], order: list[str], value: str, most: int | None = None) -> DataFrame:
    """rows with filled: the value, else the last one before, else the first one after."""
    out = Ordered(rows, keys, order, most).scan(_before=("last", F.col(value)), _after=("next", F.col(value))).rows
    return out.select(*rows.columns, F.coalesce("_before", "_after").alias("filled"))


def fill_spans(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, most: int | None = None) -> DataFrame:
    """rows with filled_start and filled_end: a missing start is the (filled) end before, or 0 for a key's first row; a missing end lies half way to the next known start, or at the start if none follows.

    Where starts and ends are missing one after another, each step halves what is left to the next known start, so a
    start is that start less its distance from the last anchor (a known start, or one after a known end) halved once a step.
    """
    scan = Ordered(rows.withColumn("_a", F.col(start).cast("double")).withColumn("_z", F.col(end).cast("double")), keys, order, most)
    scan.scan(_before=("lag", F.col("_z")), _later=("lead", F.col("_a")), _n=("sum", F.lit(1)), _first=("first_row", F.lit(1)))
    scan.rows = scan.rows.withColumn("_anchor", F.coalesce("_a", "_before", F.when(F.col("_first"), 0.0)))
    scan.scan(_from=("last", F.when(F.col("_anchor").isNotNull(), F.struct(F.col("_anchor").alias("v"), F.col("_n").alias("n")))), _next=("next", F.col("_later")))
    begun = F.when(F.col("_next").isNull(), F.col("_from.v")).otherwise(F.col("_next") - (F.col("_next") - F.col("_from.v")) * F.pow(F.lit(0.5), F.col("_n") - F.col("_from.n")))
    out = scan.rows.withColumn("filled_start", F.coalesce("_anchor", begun))
    half = F.coalesce("_z", F.col("filled_start") + (F.col("_next") - F.col("filled_start")) / 2, "filled_start")
    return out.select(*rows.columns, "filled_start", half.alias("filled_end"))


def islands(rows: DataFrame, keys: list[str], order: list[str], inside: Column, least: int = 1, keep_open: bool = True, most: int | None = None) -> DataFrame:
    """keys, island, first, last (of the first order column), n: maximal runs of rows where inside holds, of at least so many rows.

    keep_open False drops a run that the key's last row is in.
    """
    scan = Ordered(rows.withColumn("_in", F.coalesce(inside, F.lit(False))), keys, order, most).scan(_before=("lag", F.col("_in")), _after=("lead", F.col("_in")))
    scan.scan(island=("sum", (F.col("_in") & ~F.coalesce("_before", F.lit(False))).cast("int")))
    runs = scan.rows.where("_in").withColumn("_open", F.col("_after").isNull())
    out = runs.groupBy(*keys, "island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"), F.max("_open").alias("_open")).where(F.col("n") >= least)
    return (out if keep_open else out.where("NOT _open")).drop("_open")


def silences(frames: DataFrame, keys: list[str], threshold: float, least_ms: int, frame_ms: int = 10, keep_open: bool = True) -> DataFrame:
    """keys, start_ms, end_ms, mid_ms of runs of frames (frame, rms) below the threshold."""
    runs = islands(frames, keys, ["frame"], F.col("rms") < threshold, ceil(least_ms / frame_ms), keep_open)
    start, end = F.col("first") * frame_ms, (F.col("last") + 1) * frame_ms
    return runs.select(*keys, start.alias("start_ms"), end.alias("end_ms"), F.floor((start + end) / 2).alias("mid_ms"))


def longest_run(runs: DataFrame, keys: list[str], until: Column, after: int | None = 20, least: int = 8) -> DataFrame:
    """Per key the longest run of at least so many rows that starts after (if given) and before the given places; ties to the first."""
    good = runs.where((F.col("n") >= least) & (F.col("first") < until))
    good = good if after is None else good.where(F.col("first") > after)
    return good.groupBy(*keys).agg(F.min_by(F.struct("first", "last", "n"), F.struct(-F.col("n"), "first")).alias("r")).select(*keys, "r.*")


def collapse_repeats(rows: DataFrame, keys: list[str], order: list[str], value: str, blank: str | None = None, most: int | None = None) -> DataFrame:
    """Rows whose value differs from the row before, without blanks (which part repeats)."""
    out = Ordered(rows, keys, order, most).scan(_b=("lag", F.col(value))).rows
    kept = out.where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).select(rows.columns)
    return kept if blank is None else kept.where(F.col(value) != blank)


def adjacent(rows: DataFrame, keys: list[str], order: list[str], value: str, most: int | None = None) -> DataFrame:
    """rows with next_value; a key's last row has none and goes."""
    return Ordered(rows, keys, order, most).scan(next_value=("lead", F.col(value))).done(*rows.columns, "next_value").where("next_value IS NOT NULL")


def consumed_pairs(rows: DataFrame, keys: list[str], order: list[str], value: str, opens: Column, closes: Column, most: int | None = None) -> DataFrame:
    """Pairs of neighbours where opens holds for the first and closes for the second, and no row is in two pairs: of a chain of candidate pairs every other is taken."""
    scan = Ordered(rows.withColumn("_o", opens).withColumn("_cl", closes), keys, order, most).scan(next_value=("lead", F.col(value)), _after=("lead", F.col("_cl")), _n=("sum", F.lit(1)))
    scan.rows = scan.rows.withColumn("_p", F.coalesce(F.col("_o") & F.col("_after"), F.lit(False)))
    scan.scan(_b=("lag", F.col("_p")))
    scan.scan(_from=("last", F.when(F.col("_p") & ~F.coalesce("_b", F.lit(False)), F.col("_n"))))
    return scan.rows.where(F.col("_p") & ((F.col("_n") - F.col("_from")) % 2 == 0)).select(*rows.columns, "next_value")


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, most: int | None = None) -> DataFrame:
    return Ordered(rows, keys, order, most).scan(**{name: ("last", value)}).done(*rows.columns, name)


@F.udtf(returnType="headword string, pos string, definition string, line_no int")
class DictionaryPage:
    """Entries of a dictionary page: a line 'headword (pos) definition', to which following lines without a headword are joined;
    a headword on a line of its own takes the bracketed pos and definition of the next line, which is then used up."""

    def eval(self, text: str):
        import re

        whole = re.compile(HEADWORD_LINE)
        tail = re.compile(r"^\s*\(([^)]+)\)\s*(.+)$")
        lines, i, held = (text or "").split("\n"), 0, None
        while i < len(lines):
            entry = whole.match(lines[i])
            following = tail.match(lines[i + 1]) if i + 1 < len(lines) else None
            if entry or (following and lines[i].strip() and not tail.match(lines[i])):
                if held:
                    yield held
                head, pos, definition = entry.groups() if entry else (lines[i].strip(), *following.groups())
                held = (head.strip(), re.split("[:,]", pos)[0].strip(), definition.strip(), i)
                i += 1 if entry else 2
                continue
            if held and lines[i].strip():
                held = (*held[:2], f"{held[2]} {lines[i].strip()}", held[3])
            i += 1
        if held:
            yield held
