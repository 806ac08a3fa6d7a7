"""A full-text index as tables: ranked, phrase and prefix queries for whole tables of queries at once.

Documents are dealt to ranges of about RANGE documents by a hash of their id. A posting row holds one token's entries in one range
(document, frequency, length, places), so a token that every document has is cut into as many rows as there are ranges. Each
row also has its largest impact. For top-k queries these are added up to a bound for each query and range; the
best ranges by bound are scored first, which gives each query a score to beat, and of the rest only ranges whose bound
reaches it are read (block-max pruning). Results are those of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.operators.durable import durable
from lexmill.operators.picks import top_n

RANGE = 2048
#: BM25's constants; impacts are whole millionths, so sums don't depend on order.
K1, B, UNIT = 1.2, 0.75, 1_000_000
#: Ranges of each query that are scored first.
FIRST = 2


@dataclass
class Index:
    """postings: token, range, most, entries; terms: token, df; n and mean: number of documents and their mean length. All in the shared folder."""

    postings: DataFrame
    terms: DataFrame
    n: int
    mean: float


def impact(tf: Column, length: Column, df: Column, n: int, mean: float) -> Column:
    idf = F.ln(1.0 + (F.lit(n) - df + 0.5) / (df + 0.5))
    return F.floor(UNIT * (idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean))))


def build(rows: DataFrame, key: str, words: str, ranges: int | None = None, among: DataFrame | None = None, places: bool = True) -> Index:
    """The index of words (an array) of each row; a row's places count from 0.

    With among (a column token, nulls and repeats allowed), only these tokens are indexed; lengths, frequencies and numbers of documents are those of all
    words, so queries of these tokens have the same results. Without places, entries hold none: enough for ranked queries.

    Rows without words are documents too. Keys should be unique: rows that share one are one document of their joined entries. Null keys and null arrays are left
    out. The words of one document in one range are gathered in one row; nothing else is.
    """
    docs = rows.where(F.col(key).isNotNull() & F.col(words).isNotNull()).select(F.col(key).alias("doc"), F.size(words).alias("len"), F.col(words).alias("_w"))
    n, mean = docs.agg(F.count("*"), F.avg("len")).first()
    ranges = ranges or max(1, ceil(n / RANGE))
    each = docs.select("doc", "len", F.posexplode("_w").alias("at", "token"))
    if among is not None:
        each = each.join(among.select("token").distinct(), "token", "left_semi")
    of_each = [F.array_sort(F.collect_list("at")).alias("places")] if places else []  # of one document
    tf = each.groupBy("token", "doc").agg(F.max("len").alias("len"), F.count("*").alias("tf"), *of_each)
    entries = durable(tf.withColumn("range", F.pmod(F.xxhash64("doc"), F.lit(ranges)).cast("int")))
    terms = durable(entries.groupBy("token").agg(F.count("*").alias("df")))
    scored = entries.join(terms, "token").withColumn("impact", impact(F.col("tf"), F.col("len"), F.col("df"), n, mean or 1.0))
    postings = scored.groupBy("token", "range").agg(F.max("impact").alias("most"), F.array_sort(F.collect_list(F.struct("doc", "impact", *(["places"] if places else [])))).alias("entries"))
    return Index(durable(postings), terms, n, mean or 1.0)


def vocabulary(rows: DataFrame, key: str, words: str) -> DataFrame:
    """token, df: the terms of the index of these rows, without its postings.

    Where keys are unique a row's distinct words are counted as they are, with partial counts in the tasks; rows that share a key are one document.
    """
    docs = rows.where(F.col(key).isNotNull() & F.col(words).isNotNull()).select(F.col(key).alias("doc"), F.array_distinct(words).alias("_w"))
    each = docs.select("doc", F.explode("_w").alias("token"))
    if docs.groupBy("doc").count().where("count > 1").limit(1).count():
        each = each.distinct()
    return each.groupBy("token").agg(F.count("*").alias("df"))


def ranked(index: Index, queries: DataFrame, query: str, words: str, k: int = 10) -> DataFrame:
    """query, rank, doc, score: each query's k best documents by BM25 (millionths), ties to the smaller document; those that hold none of its words are no results.

    Repeated words of a query count once; queries without known words have no rows.
    """
    asked = durable(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(words)).alias("token")))
    meta = asked.join(index.postings.select("token", "range", "most"), "token")
    bounds = durable(meta.groupBy("query", "range").agg(F.sum("most").alias("bound")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "range"))
    placed = bounds.withColumn("_p", place)

    def scored(of: DataFrame) -> DataFrame:
        """of: query, range."""
        hit = asked.join(of, "query").join(index.postings.select("token", "range", "entries"), ["token", "range"])
        return hit.select("query", F.inline("entries")).groupBy("query", "doc").agg(F.sum("impact").alias("score"))

    best = lambda df: top_n(df, ["query"], [F.desc("score"), F.asc("doc")], k)
    first = durable(best(scored(placed.where(F.col("_p") <= FIRST).select("query", "range"))))
    to_beat = first.where(F.col("rank") == k).select("query", F.col("score").alias("_beat"))
    rest = placed.where(F.col("_p") > FIRST).join(to_beat, "query", "left").where(F.coalesce(F.col("bound") >= F.col("_beat"), F.lit(True)))
    both = first.select("query", "doc", "score").unionByName(scored(rest.select("query", "range")))
    return best(both).select(F.col("query").alias(query), F.col("rank").cast("int").alias("rank"), "doc", "score")


def phrases(index: Index, queries: DataFrame, query: str, words: str) -> DataFrame:
    """query, doc, n, first: documents that hold the query's words one after another, how often (overlaps included) and where first.

    A query's rarest word comes first: only entries of documents that hold it are opened for the other words.
    """
    asked = durable(queries.select(F.col(query).alias("query"), F.size(words).alias("m"), F.posexplode(words).alias("i", "token")))
    known = asked.join(index.terms, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = known.groupBy("query").agg(F.min(F.struct("df", "i")).alias("r")).select("query", F.col("r.i").alias("i"))
    opened = lambda part: part.join(index.postings.select("token", "range", "entries"), "token").select("query", "m", "i", "range", F.inline("entries")).drop("impact")
    led = durable(opened(asked.join(rarest, ["query", "i"])))
    others = asked.join(rarest, ["query", "i"], "left_anti")
    near = led.select("query", "range").distinct()
    more = others.join(near, "query").join(index.postings.select("token", "range", "entries"), ["token", "range"]).select("query", "m", "i", F.inline("entries")).join(led.select("query", "doc").distinct(), ["query", "doc"], "left_semi")
    starts = led.select("query", "m", "i", "doc", "places").unionByName(more.select("query", "m", "i", "doc", "places")).select("query", "m", "doc", F.explode("places").alias("at"), "i").groupBy("query", "m", "doc", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("c"))
    return starts.where(F.col("c") == F.col("m")).groupBy("query", "doc").agg(F.count("*").alias("n"), F.min("start").alias("first")).withColumnRenamed("query", query)


def prefixes(index: Index | DataFrame, queries: DataFrame, query: str, prefix: str, least: int = 2) -> DataFrame:
    """query, token, df: known tokens that begin with the prefix (of at least so many characters), joined on its first characters. index: an index, or its terms alone."""
    terms = index.terms if isinstance(index, Index) else index
    head = lambda c: F.substring(c, 1, least)
    asked = queries.select(F.col(query), F.col(prefix).alias("_p")).where(F.length("_p") >= least).withColumn("_h", head("_p"))
    return asked.join(terms.withColumn("_h", head("token")), "_h").where(F.col("token").startswith(F.col("_p"))).select(query, "token", "df")
