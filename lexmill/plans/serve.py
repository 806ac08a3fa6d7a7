"""What the serving surface asks for: lookup, search pages, entries, statistics, ratings, inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.operators.picks import hash_sample, page, pick


def search_request(url: Column) -> dict[str, Column]:
    """query, page and per_page of a search address, with their defaults."""
    value = lambda name, other: F.coalesce(F.try_to_number(F.parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit("999999")).cast("int"), F.lit(other))
    text = F.coalesce(F.parse_url(url, F.lit("QUERY"), F.lit("q")), F.lit(""))
    return {"query": F.url_decode(text), "page": F.greatest(value("page", 1), F.lit(1)), "per_page": F.least(F.greatest(value("per_page", 30), F.lit(1)), F.lit(100))}


def search_page(entries: DataFrame, query: str, head: str, meaning: str, number: int = 1, per_page: int = 30, most: int = 4) -> DataFrame:
    """headword, meanings, total, pages, page of the heads that contain the query (folded), by folded head; at most so many meanings each."""
    hits = entries.where(F.lower(head).contains(query.lower()))
    grouped = hits.groupBy(F.lower(head).alias("headword_lower")).agg(F.min(head).alias("headword"), F.array_join(F.slice(F.array_sort(F.collect_set(meaning)), 1, most), "; ").alias("meanings"))
    total = grouped.agg(F.count("*").alias("total"))
    shown = page(grouped, [F.asc("headword_lower")], number, per_page)
    return shown.crossJoin(F.broadcast(total)).select("headword_lower", "headword", "meanings", "total", F.ceil(F.col("total") / per_page).cast("long").alias("pages"), F.lit(number).alias("page"))  # total is one row


def entry(entries: DataFrame, sentences: DataFrame, head: str, word: str, text: str, key: str, samples: int = 3) -> DataFrame:
    """kind, text of the entry's meanings and of the first sentences that hold the word."""
    meanings = entries.where(F.lower(head) == word.lower()).select(F.lit("meaning").alias("kind"), F.col(head).alias("text"))
    found = sentences.where(F.arrays_overlap(F.split(F.lower(text), " "), F.array(F.lit(word.lower())))).orderBy(key).limit(samples)
    return meanings.unionByName(found.select(F.lit("sentence").alias("kind"), F.col(text).alias("text")))


def lookup(entries: DataFrame, query: str, lang: str, columns: dict[str, str], most: int = 50) -> DataFrame:
    """The entries whose column of the language contains the query (folded), shortest first, at most so many, the cut being the feature; no rows for an unknown language or an empty query."""
    if lang not in columns or not query:
        return entries.limit(0)
    c = columns[lang]
    return entries.where(F.lower(c).contains(query.lower())).orderBy(F.length(c), c, *(x for x in entries.columns if x != c)).limit(most)


def inverted_index(rows: DataFrame, key: str, words: str) -> DataFrame:
    """token, key, tf."""
    return rows.select(key, F.explode(words).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def net_ratings(events: DataFrame, keys: list[str], rating: str) -> DataFrame:
    return events.where(F.col(rating).isin(-1, 1)).groupBy(*keys).agg(F.sum(rating).alias("net"), F.count("*").alias("votes"))


def training_items(entries: DataFrame, key: str, columns: list[str], of: int, below: int) -> DataFrame:
    """Items to train with: a sample that depends on the key alone, without entries that lack a side."""
    whole = entries
    for c in columns:
        whole = whole.where(F.coalesce(F.col(c), F.lit("")) != "")
    return hash_sample(whole, F.col(key), of, below).select(key, *columns)


def translate_words(words: DataFrame, word: str, known: DataFrame, inferred: DataFrame) -> DataFrame:
    """A lookup of our own: dictionary first, inferred entries next, with the method's name."""
    first = lambda df: pick(df, ["word"], ["value"]).select(F.col("word").alias(word), "value")
    a, b = first(known).withColumnRenamed("value", "_a"), first(inferred).withColumnRenamed("value", "_b")
    return words.join(a, word, "left").join(b, word, "left").select(*words.columns, F.coalesce("_a", "_b").alias("translation"), F.when(F.col("_a").isNotNull(), "dictionary").when(F.col("_b").isNotNull(), "inferred").otherwise("not_found").alias("method"))
