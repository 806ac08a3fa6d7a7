"""Scores of outputs against references, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.text import bag_overlap, common_subsequence, split_words
from lexmill.operators.draws import draw_accepted
from lexmill.operators.joins import whole_or_words
from lexmill.operators.stats import bucket, threshold_counts


def scores(rows: DataFrame, got: str, wanted: str) -> DataFrame:
    """rows with word_count, lcs and bow (shares of the wanted words); words of one letter don't count."""
    words = lambda c: F.filter(c, lambda w: F.length(w) > 1)
    out = rows.withColumn("_g", words(got)).withColumn("_w", words(wanted)).withColumn("word_count", F.size("_w"))
    lcs = F.when((F.size("_g") > 0) & (F.col("word_count") > 0), common_subsequence(F.col("_w"), F.col("_g")) / F.col("word_count")).otherwise(0.0)
    return out.withColumn("lcs", lcs).withColumn("bow", F.coalesce(bag_overlap(F.col("_w"), F.col("_g")), F.lit(0.0))).drop("_g", "_w")


def sampled_phrases(pairs: DataFrame, key: str, source: str, target: str, n: int, seed: int = 42, shortest: int = 2, longest: int = 10, attempts: int = 20) -> DataFrame:
    """key, phrase, reference (arrays of words): n phrases of shortest to longest words from places of aligned texts (arrays of words), by a seeded draw with rejection.

    Length and place of a pair's phrase come from a hash of seed and key; a pair is rejected if it is shorter than its phrase, has no target
    words, or the phrase has a word of one letter. The reference is the part of the target in the same proportion.
    """
    number = lambda what, of: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long") % of

    def accept(part: DataFrame) -> DataFrame:
        size, m = F.size(source), F.size(target)
        sized = part.withColumn("_k", (number("length", longest - shortest + 1) + shortest).cast("int")).where((size >= F.col("_k")) & (m > 0))
        placed = sized.withColumn("_a", number("place", size - F.col("_k") + 1).cast("int"))
        first, last = F.expr(f"size({target}) * _a DIV size({source})").cast("int"), F.expr(f"size({target}) * (_a + _k) DIV size({source})").cast("int")
        cut = placed.withColumn("phrase", F.slice(source, F.col("_a") + 1, F.col("_k"))).withColumn("reference", F.slice(target, first + 1, last - first))
        return cut.where(F.forall("phrase", lambda w: F.length(w) > 1)).select(key, "phrase", "reference")

    return draw_accepted(pairs, key, n, accept, seed, attempts)


def evaluation(phrases: DataFrame, key: str, glosses: DataFrame, known: DataFrame) -> DataFrame:
    """key, how, word_count, lcs, bow: sampled phrases translated as a whole or word by word (untranslated ones as they are), scored against their references."""
    text = phrases.select(key, F.array_join("phrase", " ").alias("text"))
    done = whole_or_words(text, key, "text", glosses, known).select(key, F.col("text").alias("_got"), "how")
    rows = phrases.join(text, key).join(done, key, "left").select(key, F.coalesce("how", F.lit("none")).alias("how"), split_words(F.coalesce("_got", "text")).alias("got"), F.col("reference").alias("wanted"))
    return scores(rows, "got", "wanted").select(key, "how", "word_count", "lcs", "bow")


def report(scored: DataFrame, keys: list[str], score: str = "bow") -> DataFrame:
    s = F.col(score)
    cuts = {"perfect": s >= 1.0, "half": s >= 0.5, "quarter": s >= 0.25, "some": s > 0, "none": s == 0}
    return scored.groupBy(*keys).agg(*threshold_counts(keys, s, cuts))


def histogram(scored: DataFrame, score: str = "bow") -> DataFrame:
    return scored.groupBy(bucket(F.col(score)).alias("bucket")).agg(F.count("*").alias("n"))


def missed_words(rows: DataFrame, expected: str, got: str, top: int = 20) -> DataFrame:
    """word, missed: how many rows expect a word and lack it, the top ones, the cut being the feature; ties to the smaller word. Arrays of words."""
    each = rows.select(F.explode(F.array_except(expected, got)).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("missed")).orderBy(F.desc("missed"), "word").limit(top)


def report_lines(scored: DataFrame, key: str, score: str = "bow") -> DataFrame:
    """key and one line of text each: rows, those at least half right, and their share in per cent with one decimal."""
    half = F.count_if(F.col(score) >= 0.5)
    out = scored.groupBy(key).agg(F.count("*").alias("n"), half.alias("half"))
    share = F.format_string("%.1f", F.col("half") * 100.0 / F.col("n"))
    return out.select(key, F.concat(F.coalesce(F.col(key).cast("string"), F.lit("unknown")), F.lit(": "), F.col("half").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" ("), share, F.lit("%)")).alias("line"))


def template_sentences(spark, templates: dict[str, tuple[str, list[str], int]], seed: int = 42) -> DataFrame:
    """template, i, sentence: so many sentences of each template, its blank filled by a hash of (seed, template, i)."""
    rows = spark.createDataFrame([(k, form, words, n) for k, (form, words, n) in templates.items()], "template string, form string, words array<string>, n int")
    each = rows.select("template", "form", "words", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    word = F.get("words", F.pmod(F.xxhash64(F.lit(seed), "template", "i"), F.size("words")).cast("int"))
    return each.select("template", "i", F.replace("form", F.lit("_"), word).alias("sentence"))
