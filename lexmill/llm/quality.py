"""Quality rules with thresholds that adapt to each language and source.

Four base counts come from the words of a text. Every other rule compares a rate of the text (per thousand words or lines)
with fences around the quartiles of its own language and source, in place of fixed cutoffs. Quartiles come from mergeable
sketches: a value is kept to its six leading bits (an error below 1/32), and a sketch is the number of texts of each such
value. Sketches merge by adding counts, so partial sketches of tasks, sources and languages give the same result in any
order, and a source with few texts is judged by the merged sketch of its language, a language with few by that of all.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.llm.common import lookup_skewed, stored

SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
#: Leading bits of a value that a sketch keeps.
BITS = 6
#: Texts that a sketch must hold to be used by itself.
LEAST_TEXTS = 200
#: Fences lie so many quartile distances outside the quartiles, and the least room of each rate: a rate that hardly varies doesn't reject small differences.
REACH = 4
ROOM = {"word_length": 2500, "symbols": 200, "capitals": 800, "same_lines": 400}
LOW = ("word_length",)
SPACE = r"[ \t-\r]"


def _distinct_short(a: Column) -> Column:
    return F.size(F.array_distinct(a)) < F.size(a)


def counts(docs: DataFrame, text: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines and n_repeat_words of the whole text, without the text.

    Windows are hashed from their words' hashes (64 bits). Repeated ones are found by sorting the hashes of a text's windows with their places, and only in texts that
    have equal hashes at all; the words they cover are counted by the gaps between places in order. The work is n log n in a text's words.
    """
    rows = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    rows = rows.withColumn("_w", F.filter(F.split("_t", SPACE + "+"), lambda w: w != "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    n = F.size("_w")
    rows = rows.select(
        *[c for c in docs.columns if c != text],
        n.cast("long").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).alias("_g"),
    )
    window = lambda x, i: F.xxhash64(x, *(F.get("_g", i + j) for j in range(1, WINDOW)))  # noqa: E731 - slices of the words themselves would copy them
    rows = rows.withColumn("_h", F.transform(F.slice("_g", F.lit(1), F.size("_g") - (WINDOW - 1)), window)).drop("_g")
    rows = rows.withColumn("_s", F.when(_distinct_short(F.col("_h")), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_h")
    same = lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"])
    rows = rows.withColumn("_p", F.array_sort(F.transform(F.filter("_s", same), lambda x: x["i"]))).drop("_s")
    gap = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def per_thousand(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN 1000 * {part} DIV {whole} ELSE 0 END")


#: What each rate divides: a count, and the words or lines that it goes by.
RATES = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "capitals": ("n_capitals", "n_words"),
    "same_lines": ("n_dup_lines", "n_lines"),
}


def sketch_value(c: Column) -> Column:
    """A number of 0 or more to its BITS leading bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(c)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", c, drop), drop)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, value, n: a mergeable sketch of each rate; as many rows a key as rates have different leading bits, a few hundred each at most."""
    each = F.array(*(F.struct(F.lit(name).alias("rate"), sketch_value(F.col(name)).alias("value")) for name in RATES))
    return rows.select(*keys, F.inline(each)).groupBy(*keys, "rate", "value").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """keys, texts, and low_/high_ of each rate, from the quartiles of the sketch merged over all but the keys."""
    merged = sketch.groupBy(*keys, "rate", "value").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys, "rate")  # a sketch's values: a bounded number
    run = merged.withColumn("_c", F.sum("n").over(over.orderBy("value"))).withColumn("_n", F.sum("n").over(over))
    quartile = lambda q: F.min(F.when(4 * F.col("_c") >= q * F.col("_n"), F.col("value")))
    spread = run.groupBy(*keys, "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("_n").alias("texts"))
    edge = []
    for name in RATES:
        of = lambda c, name=name: F.max(F.when(F.col("rate") == name, c))
        reach_by = reach * (F.col("q3") - F.col("q1")) + ROOM[name]
        edge += [of(F.col("q1") - reach_by).alias(f"low_{name}"), of(F.col("q3") + reach_by).alias(f"high_{name}")]
    return spread.groupBy(*keys).agg(F.max("texts").alias("texts"), *edge)


def thresholds(sketch: DataFrame, least: int = LEAST_TEXTS) -> DataFrame:
    """_lang, _source, texts and the fences that hold for them: their own, their language's or all texts', the first whose sketch holds enough texts."""
    own, by_lang, every = fences(sketch, ["_lang", "_source"]), fences(sketch, ["_lang"]), fences(sketch, [])
    edges = [c for c in every.columns if c != "texts"]
    tagged = lambda df, t: df.withColumnsRenamed({c: f"{t}_{c}" for c in [*edges, "texts"]})
    both = tagged(own, "own").join(tagged(by_lang, "lang"), "_lang").crossJoin(F.broadcast(tagged(every, "all")))  # every is one row
    first = lambda c: F.when(F.col("own_texts") >= least, F.col(f"own_{c}")).when(F.col("lang_texts") >= least, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    return both.select("_lang", "_source", F.col("own_texts").alias("texts"), *(first(c).alias(c) for c in edges))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, the counts of each whole text, base_failed, kept and the rules broken (reasons, comma-joined, sorted).

    Texts that fail the base rules are not counted in the sketches. Null and empty texts have no words and fail; null
    languages and sources are groups of their own; repeated rows are judged alike, null keys stay, other columns are not read, an empty table
    gives no rows. Counts are stored once in the shared folder (a few numbers a text), as sketches and verdicts both read
    them. A source may hold any share of the texts: sketches are added up before they are shuffled, and fences of large
    groups are broadcast.
    """
    named = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = stored(counts(named, "_text").withColumn("base_failed", failed).withColumns({k: F.when(~F.col("base_failed"), per_thousand(*v)) for k, v in RATES.items()}), "quality")
    group = F.concat(F.coalesce(F.concat(F.lit("="), F.col("_lang")), F.lit("")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")))
    passed = rows.where("NOT base_failed").withColumn("_lang", F.coalesce(F.concat(F.lit("="), F.col("_lang")), F.lit(""))).withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")))
    edges = thresholds(stored(sketches(passed, ["_lang", "_source"]), "quality-sketches")).withColumn("_group", F.concat("_lang", F.lit("\x1f"), "_source")).drop("_lang", "_source")
    judged = lookup_skewed(rows.withColumn("_group", group), stored(edges, "quality-fences"), "_group", "texts")
    broken = [F.when(F.col(name) > F.col(f"high_{name}"), f"{name}_high") for name in RATES] + [F.when(F.col(name) < F.col(f"low_{name}"), f"{name}_low") for name in LOW]
    reasons = F.array_join(F.array_sort(F.array_compact(F.array(*broken))), ",")
    kept = ~F.col("base_failed") & reduce(lambda a, b: a & b, [F.coalesce(F.col(name) <= F.col(f"high_{name}"), F.lit(True)) for name in RATES] + [F.coalesce(F.col(name) >= F.col(f"low_{name}"), F.lit(True)) for name in LOW])
    return judged.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), reasons).otherwise("base").alias("reasons"))


def op13_quality_rules(docs: DataFrame) -> DataFrame:
    """The digest columns of judge over every document, whose docstring says what each odd case gives."""
    return judge(docs)


def op13_sql() -> str:
    rate = lambda part, whole: f"CASE WHEN {whole} > 0 THEN 1000 * {part} // {whole} ELSE 0 END"
    parts = {k: rate(*v) for k, v in RATES.items()}
    per = " UNION ALL ".join(f"SELECT l, s, '{k}' AS rate, {k} AS v FROM p WHERE NOT base_failed" for k in RATES)
    room = "CASE rate " + " ".join(f"WHEN '{k}' THEN {ROOM[k]}" for k in RATES) + " END"
    pick = lambda c: f"CASE WHEN o.n >= {LEAST_TEXTS} THEN o.{c} WHEN g.n >= {LEAST_TEXTS} THEN g.{c} ELSE e.{c} END"
    level = lambda name, keys: f"""{name}m AS (SELECT {keys}rate, v, sum(n) AS n FROM sk GROUP BY ALL),
{name}c AS (SELECT {keys}rate, v, sum(n) OVER (PARTITION BY {keys}rate ORDER BY v) AS c, sum(n) OVER (PARTITION BY {keys}rate) AS n FROM {name}m),
{name}q AS (SELECT {keys}rate, min(v) FILTER (4 * c >= n) AS q1, min(v) FILTER (4 * c >= 3 * n) AS q3, max(n) AS n FROM {name}c GROUP BY ALL),
{name} AS (SELECT {keys}rate, n, q1 - {REACH} * (q3 - q1) - {room} AS low, q3 + {REACH} * (q3 - q1) + {room} AS high FROM {name}q)"""  # noqa: E731
    top = " OR ".join(f"(rate = '{k}' AND v < low)" for k in LOW)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
g5 AS (SELECT rid, i, ws[i : i + 4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rp AS (SELECT rid, i FROM g5 QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rw AS (SELECT rid, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rp) GROUP BY rid),
c AS (SELECT rid, doc_id, l, s, len(ws) AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rw USING (rid)),
p AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {', '.join(f'{v} AS {k}' for k, v in parts.items())} FROM c),
per AS ({per}),
sk AS (SELECT l, s, rate, v, count(*) AS n FROM (SELECT l, s, rate, (v >> e) << e AS v FROM (SELECT *, CAST(greatest(0, length(bin(v)) - {BITS}) AS BIGINT) AS e FROM (SELECT l, s, rate, CAST(v AS BIGINT) AS v FROM per))) GROUP BY ALL),
{level('o', 'l, s, ')}, {level('g', 'l, ')}, {level('e', '')},
th AS (SELECT o.l, o.s, o.rate, {pick('low')} AS low, {pick('high')} AS high FROM o JOIN g ON o.l = g.l AND o.rate = g.rate JOIN e ON o.rate = e.rate),
bad AS (SELECT rid, string_agg(rate || CASE WHEN v > high THEN '_high' ELSE '_low' END, ',' ORDER BY rate || CASE WHEN v > high THEN '_high' ELSE '_low' END) AS reasons
  FROM (SELECT rid, x.rate, x.v, th.low, th.high FROM ({' UNION ALL '.join(f"SELECT rid, l, s, '{k}' AS rate, {k} AS v FROM p WHERE NOT base_failed" for k in RATES)}) x JOIN th ON x.l = th.l AND x.s = th.s AND x.rate = th.rate) WHERE v > high OR {top} GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND reasons IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE coalesce(reasons, '') END AS reasons FROM p LEFT JOIN bad USING (rid)"""
