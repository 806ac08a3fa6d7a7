"""Dictionary joins: chains, bridges, ladders, expansions, fallbacks, fuzzy matches, backfills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill import vocab
from lexmill.functions.text import file_stem, split_words, similarity, spellings, without_accents
from lexmill.operators.durable import durable
from lexmill.operators.picks import pick


def align(sides: dict[str, DataFrame], keys: list[str], value: str = "text") -> DataFrame:
    """keys and a column per side, for keys that all sides have."""
    parts = [df.select(*keys, F.col(value).alias(name)) for name, df in sides.items()]
    return reduce(lambda a, b: a.join(b, keys), parts)


def align_from(lead: DataFrame, sides: dict[str, DataFrame], keys: list[str], within: list[str], value: str = "text") -> DataFrame:
    """Keys of any side within groups (such as chapters) that the leading side has; texts that are missing are null."""
    groups = lead.select(*within).distinct()
    parts = [df.join(groups, within, "left_semi").select(*keys, F.col(value).alias(name)) for name, df in sides.items()]
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def chain_first(first: DataFrame, second: DataFrame, seq: str = "seq") -> DataFrame:
    """key, via, value: first(key, via, seq) joined with second(via, value); each key keeps its first via that has a value."""
    return pick(first.join(second, "via").select("key", "via", "value", seq), ["key"], [seq, "value", "via"]).select("key", "via", "value")


def ladder(keys: DataFrame, key: str, steps: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """key, value, found_by, confidence: the first step (name, frame of key and value unique by key, confidence) that knows the key; not_found else."""
    out = keys
    for name, df, _ in steps:
        out = out.join(df.select(F.col(key), F.col("value").alias(f"_{name}")), key, "left")
    chain = lambda what: reduce(lambda w, s: w.when(F.col(f"_{s[0]}").isNotNull(), what(s)), steps[1:], F.when(F.col(f"_{steps[0][0]}").isNotNull(), what(steps[0])))
    return out.select(*keys.columns, F.coalesce(*(F.col(f"_{s[0]}") for s in steps)).alias("value"), chain(lambda s: F.lit(s[0])).otherwise("not_found").alias("found_by"), chain(lambda s: F.lit(s[2])).alias("confidence"))


def expand_synonyms(known: DataFrame, edges: DataFrame, confidence: float = vocab.CONFIDENCE["synonym"], both_ways: bool = True) -> DataFrame:
    """source_word, target, confidence, path: known(word, target) carried one edge on, to words that have no target yet."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("synonym").alias("word"), F.col("word").alias("synonym"))).distinct()
    got = known.join(edges, "word").select(F.col("synonym").alias("source_word"), "target", F.lit(confidence).alias("confidence"), F.concat_ws("→", "synonym", "word", "target").alias("path"))
    new = got.join(known.select(F.col("word").alias("source_word")).distinct(), "source_word", "left_anti")
    return pick(new, ["source_word", "target"], ["path"])


def bridge(edges: DataFrame, across: DataFrame, known: DataFrame, exclude: DataFrame | None = None, cap: int = 500_000, confidence: float = vocab.CONFIDENCE["bridge"]) -> DataFrame:
    """source_word, target: edges(word, synonym), then across(synonym, via), then known(via, target); not the excluded pairs; ordered, at most cap rows."""
    got = edges.join(across, "synonym").join(known, "via").select(F.col("word").alias("source_word"), "target", F.lit(confidence).alias("confidence"), F.concat_ws("→", "word", "synonym", "via", "target").alias("path"))
    if exclude is not None:
        got = got.join(exclude, ["source_word", "target"], "left_anti")
    return pick(got, ["source_word", "target"], ["path"]).orderBy("source_word", "target").limit(cap)


def earliest_strategy(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all strategies; of rows with equal keys that of the earliest strategy."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("strategy", F.lit(i)) for i, p in enumerate(parts, 1)))
    return pick(rows, keys, ["strategy", *(c for c in rows.columns if c not in keys and c != "strategy")])


def fallback(words: DataFrame, word: str, known: DataFrame) -> DataFrame:
    """words with value and step: the exact word, else without accents, else its first word. known: word, value, unique by word."""
    plain = pick(known.withColumn("_plain", without_accents(F.col("word"))), ["_plain"], ["word"]).select("_plain", F.col("value").alias("_v2"))
    exact = known.select(F.col("word").alias(word), F.col("value").alias("_v1"))
    head = known.select(F.col("word").alias("_head"), F.col("value").alias("_v3"))
    rows = words.withColumn("_plain", without_accents(F.col(word))).withColumn("_head", F.substring_index(word, " ", 1))
    got = rows.join(exact, word, "left").join(plain, "_plain", "left").join(head, "_head", "left")
    step = F.when(F.col("_v1").isNotNull(), "exact").when(F.col("_v2").isNotNull(), "accents").when(F.col("_v3").isNotNull(), "first_word").otherwise("none")
    return got.select(*words.columns, F.coalesce("_v1", "_v2", "_v3").alias("value"), step.alias("step"))


def substitute_words(rows: DataFrame, key: str, words: str, known: DataFrame) -> DataFrame:
    """key, text, changed: each word replaced by its value (known: word, value, unique by word), order kept; only rows with a change."""
    each = rows.select(key, F.posexplode(words).alias("pos", "word")).join(known, "word", "left")
    put = F.struct("pos", F.coalesce("value", "word").alias("w"))
    out = each.groupBy(key).agg(F.array_sort(F.collect_list(put)).alias("_ws"), F.count("value").alias("changed")).where("changed > 0")
    return out.select(key, F.array_join(F.transform("_ws", lambda x: x["w"]), " ").alias("text"), "changed")


def whole_or_words(rows: DataFrame, key: str, text: str, glosses: DataFrame, known: DataFrame) -> DataFrame:
    """key, text, how, changed: the value of the whole (folded, stripped) text where glosses (gloss, value, unique by gloss) has it, else the text word by word, and only where a word changed.

    Null texts have no rows; keys should be unique. known: word, value, unique by word.
    """
    folded = rows.select(key, F.lower(F.trim(text)).alias("_t")).where("_t IS NOT NULL")
    whole = folded.join(glosses.select(F.col("gloss").alias("_t"), "value"), "_t").select(key, F.col("value").alias("text"), F.lit("whole").alias("how"), F.lit(1).cast("long").alias("changed"))
    rest = folded.join(glosses.select(F.col("gloss").alias("_t")), "_t", "left_anti").select(key, split_words(F.col("_t")).alias("_w"))
    return whole.unionByName(substitute_words(rest, key, "_w", known).select(key, "text", F.lit("words").alias("how"), "changed"))


def first_category(rows: DataFrame, key: str, words: str, keywords: DataFrame, order: str, other: str = "other") -> DataFrame:
    """key and category: of the categories whose keywords (word, category, and the order in which they are tried) are among a row's words, the first; other if none.

    For keyword tables of any size, by a join; see text.semantic_category for a few words. Keys should be unique; equal orders go by category.
    """
    each = rows.select(key, F.explode(F.array_distinct(words)).alias("word")).join(keywords.select("word", "category", F.col(order).alias("_o")), "word")
    best = each.groupBy(key).agg(F.min(F.struct("_o", "category")).alias("_b"))
    return rows.select(key).join(best, key, "left").select(key, F.coalesce("_b.category", F.lit(other)).alias("category"))


def candidates(keys: DataFrame, key: str, steps: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """key, rank, value, found_by, percent: all values of all steps (name, frame of key and value, confidence), a value under its best step, by confidence, then value."""
    rows = reduce(DataFrame.unionByName, (df.select(key, "value", F.lit(name).alias("found_by"), F.lit(c).alias("_c"), F.lit(i).alias("_i")) for i, (name, df, c) in enumerate(steps)))
    best = pick(rows.where("value IS NOT NULL").join(keys.select(key).distinct(), key, "left_semi").withColumn("_o", -F.col("_c")), [key, "value"], ["_o", "_i"])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_c"), "value"))
    return best.select(key, rank.alias("rank"), "value", "found_by", F.round(F.col("_c") * 100).cast("int").alias("percent"))


def by_file(manifest: DataFrame, segments: DataFrame, file: str, path: str) -> DataFrame:
    """manifest rows whose file has a segment, joined by the stem of the name, whatever folder and ending; of several segments of a stem the first by path."""
    stem = lambda c: file_stem(F.substring_index(c, "/", -1))
    own = pick(segments.withColumn("_stem", stem(path)), ["_stem"], [path])
    return manifest.withColumn("_stem", stem(file)).join(own, "_stem").drop("_stem")


def backfill(rows: DataFrame, known: DataFrame, on: list[str], column: str, order: list[str], empty: Column | None = None) -> DataFrame:
    """rows whose column is empty (null, or as empty says) get it from the first known row of equal keys."""
    best = pick(known.select(*on, *(o for o in order if o not in on and o != column), column), on, order).select(*on, F.col(column).alias("_new"))
    lacks = F.col(column).isNull() if empty is None else empty
    return rows.join(best, on, "left").withColumn(column, F.when(lacks, F.coalesce("_new", column)).otherwise(F.col(column))).select(rows.columns)


def bags(words: DataFrame, word: str, rare_first: str) -> DataFrame:
    """word and bag: its characters, each with the number of its occurrence so far, in an order in which rare ones come first.

    Words share as many bag members as characters, with their multiplicities. Linear in a word's length for each of its letters.
    """
    letters = F.filter(F.array_distinct(F.split(word, "")), lambda c: c != "")
    ordered = F.array_sort(F.transform(letters, lambda c: F.struct(F.coalesce(-F.nullif(F.call_function("instr", F.lit(rare_first), c), F.lit(0)), F.lit(-1000)).alias("o"), c.alias("c"))))
    times = lambda c: F.length(word) - F.length(F.replace(F.col(word), c, F.lit("")))
    each = F.transform(ordered, lambda x: F.transform(F.sequence(F.lit(0), times(x["c"]) - 1), lambda k: F.concat(x["c"], k.cast("string"))))
    return words.withColumn("bag", F.flatten(each))


def near_words(words: DataFrame, vocabulary: DataFrame, least: float, band: int) -> DataFrame:
    """word, match, ratio of all pairs with an equal first letter, lengths that differ by at most band, and a ratio of least or more.

    An exact similarity join. A ratio is at most twice the number of shared characters over both lengths. Words that can
    reach least therefore share a member among the first (rarest) of their bags: only those are joined, with
    first letter and length, which splits the blocks of common letters and lengths; each pair comes from its first shared member alone. Pairs whose whole
    bags share too little go before the ratio itself is taken.
    """
    commonest = "".join(r.c for r in vocabulary.select(F.explode(F.array_distinct(F.split("match", ""))).alias("c")).where("c <> ''").groupBy("c").count().orderBy(F.desc("count"), "c").limit(64).collect())
    need = lambda n: F.ceil(least * n / 2 - 1e-9)  # noqa: E731 - characters that words of n in sum must share
    shortest = lambda n: F.greatest(F.lit(1), n - band)
    kept = lambda c, n: F.slice(c, F.lit(1), F.greatest(F.lit(0), n - need(n + shortest(n)) + 1).cast("int"))
    side = lambda df, name: bags(df, name, commonest).select(name, "bag", F.substring(name, 1, 1).alias("_c"), F.length(name).alias("_n"), kept(F.col("bag"), F.length(name)).alias("_p"))
    left = side(words, "word").withColumnsRenamed({"bag": "_a", "_n": "_la", "_p": "_pa"})
    left = left.withColumn("_n", F.explode(F.sequence(shortest(F.col("_la")), F.col("_la") + band))).withColumn("_m", F.explode("_pa"))
    right = side(vocabulary, "match").withColumn("_m", F.explode("_p"))
    met = left.join(right, ["_c", "_n", "_m"])
    first = met.where(F.col("_m") == F.get(F.array_intersect("_pa", "_p"), F.lit(0)))
    close = first.where(F.size(F.array_intersect("_a", "bag")) >= need(F.col("_la") + F.col("_n")))
    return close.select("word", "match", similarity("word", "match").alias("ratio")).where(F.col("ratio") >= least)


def fuzzy(words: DataFrame, word: str, vocabulary: DataFrame, least: float = 0.85, band: int = 3, variants: int | None = None) -> DataFrame:
    """word, match, ratio, step: a vocabulary word that is equal, else the first spelling variant that is one, else the most similar of like length and equal first letter.

    variants: of the spelling variants only so many are tried. Null and empty words have no rows.
    """
    base = durable(words.select(F.col(word).alias("word")).where("word <> ''").distinct())  # both are read several times
    known = durable(vocabulary.select(F.col(vocabulary.columns[0]).alias("match")).where("match <> ''").distinct())
    tried = base.select("word", F.posexplode(spellings(F.col("word"), variants)).alias("n", "match")).join(known, "match")
    spelled = pick(tried.select("word", "n", "match"), ["word"], ["n"]).select("word", "match", F.lit(1.0).alias("ratio"), F.when(F.col("n") == 0, "exact").otherwise("variant").alias("step"))
    scored = near_words(base.join(spelled, "word", "left_anti"), known, least, band)
    best = pick(scored.withColumn("_o", -F.col("ratio")), ["word"], ["_o", "match"]).select("word", "match", "ratio", F.lit("similar").alias("step"))
    return spelled.unionByName(best)


def respelled(phrases: DataFrame, key: str, text: str, vocabulary: DataFrame, least: float = 0.88, band: int = 2, variants: int = 5) -> DataFrame:
    """key, text: each word of a phrase in the vocabulary's spelling by the stricter rule, or as it is (lower case, without punctuation) if none is near; order kept."""
    word = F.regexp_replace(F.lower("w"), r"[.,;:!?]", "")
    each = phrases.select(key, F.posexplode(split_words(F.col(text))).alias("pos", "w")).select(key, "pos", word.alias("word"))
    found = fuzzy(each, "word", vocabulary, least, band, variants).select("word", "match")
    put = each.join(found, "word", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("match", "word").alias("w")))).alias("ws"))
    return put.select(key, F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("text"))


def merge_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key (unique in each); where both have a key, right's."""
    return right.unionByName(left.join(right.select(*keys), keys, "left_anti").select(right.columns))


def pivot_verify(pairs: DataFrame, units: DataFrame, a: str, b: str, least: int = 1, key: str = "unit") -> DataFrame:
    """pairs (a, b) that stand together in at least so many units (unit, word), with that number."""
    left = units.select(key, F.col("word").alias(a)).distinct()
    right = units.select(key, F.col("word").alias(b)).distinct()
    return pairs.select(a, b).distinct().join(left, a).join(right, [key, b]).groupBy(a, b).agg(F.count("*").alias("evidence")).where(F.col("evidence") >= least)


def missing_words(counts: DataFrame, word: str, maps: list[DataFrame], top: int) -> DataFrame:
    """Of the top words by count those that no map has."""
    first = counts.orderBy(F.desc("n"), word).limit(top)
    return reduce(lambda df, m: df.join(m.select(word).distinct(), word, "left_anti"), maps, first)


def residual(pairs: DataFrame, left: str, right: str, known: DataFrame, key: str) -> DataFrame:
    """key, left_word, right_word of pairs (unique key) with exactly one word on each side that is in no known pair (known: left_word, right_word) of the two sides.

    The two sides of a pair, a few words each, are crossed where they are and looked up; pairs are read once.
    """
    sides = pairs.where(F.col(key).isNotNull()).select(key, F.array_distinct(left).alias("_l"), F.array_distinct(right).alias("_r"))
    each = sides.withColumn("left_word", F.explode("_l")).withColumn("right_word", F.explode("_r"))
    met = each.join(known.select("left_word", "right_word", F.lit(True).alias("_k")).distinct(), ["left_word", "right_word"], "left")
    hit = lambda w: F.collect_set(F.when(F.col("_k"), F.col(w)))  # noqa: E731 - of one pair
    out = met.groupBy(key).agg(F.first("_l").alias("_l"), F.first("_r").alias("_r"), hit("left_word").alias("_hl"), hit("right_word").alias("_hr"))
    rest = lambda side, hits: F.filter(side, lambda w: w.isNull() | ~F.array_contains(hits, w))
    left_over = out.select(key, rest("_l", "_hl").alias("_l"), rest("_r", "_hr").alias("_r")).where((F.size("_l") == 1) & (F.size("_r") == 1))
    return left_over.select(key, F.col("_l")[0].alias("left_word"), F.col("_r")[0].alias("right_word"))


def without_conflicts(rows: DataFrame, verified: DataFrame, key: str, value: str, source: str, low: list[str] = vocab.LOW_SOURCES) -> DataFrame:
    """rows without those of a low source whose verified value (folded) is another."""
    v = verified.select(F.lower(key).alias("_k"), F.lower(F.trim(value)).alias("_v"))
    bad = (F.lower(rows[key]) == F.col("_k")) & (F.lower(F.trim(rows[value])) != F.col("_v")) & rows[source].isin(low)
    return rows.join(v, bad, "left_anti")


def priority_merge(parts: list[DataFrame], key: str, fields: list[str], source: str = "source") -> DataFrame:
    """One row per folded key: each field from the first part that has it, and the sources in order. A key's rows are as many as the parts hold of it."""
    rows = reduce(DataFrame.unionByName, (p.select(key, *fields, source).withColumn("_p", F.lit(i)) for i, p in enumerate(parts)))
    first = lambda f: F.min_by(F.col(f), F.struct("_p", key)).alias(f)
    filled = [F.expr(f"min_by(`{f}`, struct(_p, `{key}`)) FILTER (WHERE `{f}` IS NOT NULL AND `{f}` <> '')").alias(f) for f in fields]
    sources = F.transform(F.array_sort(F.collect_set(F.struct("_p", source))), lambda x: x[source])
    return rows.groupBy(F.lower(key).alias("_key")).agg(first(key), *filled, F.array_distinct(sources).alias("sources")).drop("_key")


def group_pairs(members: DataFrame, group: str, member: str) -> DataFrame:
    """word, synonym in both directions for every two members of a group; repeated members are one."""
    members = members.select(group, member).distinct()
    a, b = members.select(group, F.col(member).alias("word")), members.select(group, F.col(member).alias("synonym"))
    return a.join(b, group).where("word <> synonym").select("word", "synonym").distinct()


def merge_passes(passes: list[DataFrame], key: str, quality) -> DataFrame:
    """key, line_no, line: texts of several passes over a page, each line from the pass of best quality, ties to the earlier pass. A pass may lack pages or lines."""
    rows = reduce(DataFrame.unionByName, (p.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("_p", F.lit(i)) for i, p in enumerate(passes)))
    return pick(rows.withColumn("_q", -quality(F.col("line"))), [key, "line_no"], ["_q", "_p"]).select(key, "line_no", "line")


def nearest(targets: DataFrame, points: DataFrame, key: str, target: str, point: str, band: float | None = None, width: float | None = None) -> DataFrame:
    """Each target with the nearest point of its key, ties to the smaller; null if none is within band. Found by two as-of windows over targets and points together, not by pairing them.

    width: a key's rows are cut into stretches of that width, each a partition of its own, for keys with very many rows.
    The points next to a stretch come from the first and last points of all stretches, of which there are few.
    """
    stretch = (lambda c: F.floor(c / width)) if width else (lambda c: F.lit(0).cast("long"))
    spots = points.select(key, F.col(point).alias("_at"), F.col(point).alias("_p"), F.lit(0).alias("_t"), stretch(F.col(point)).alias("_b"))
    rows = targets.select(key, F.col(target).alias("_at"), F.lit(None).cast(points.schema[point].dataType).alias("_p"), F.lit(1).alias("_t"), stretch(F.col(target)).alias("_b")).unionByName(spots)
    w = Window.partitionBy(key, "_b").orderBy("_at", "_t")
    both = rows.withColumn("_before", F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    if width:
        over = Window.partitionBy(key).orderBy("_b")
        edges = rows.groupBy(key, "_b").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
        edges = edges.select(key, "_b", F.last("_high", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"), F.first("_low", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_right"))
        both = both.join(edges, [key, "_b"]).withColumn("_before", F.coalesce("_before", "_left")).withColumn("_after", F.coalesce("_after", "_right"))
    far = F.lit(float("inf"))
    left, right = F.coalesce(F.col("_at") - F.col("_before"), far), F.coalesce(F.col("_after") - F.col("_at"), far)
    found = F.when(left <= right, F.col("_before")).otherwise(F.col("_after"))
    if band is not None:
        found = F.when(F.least(left, right) <= band, found)
    return both.where("_t = 1").select(key, F.col("_at").alias(target), found.alias(point))


def positional(spans: DataFrame, words: DataFrame, key: str, order: str, n: str) -> DataFrame:
    """Words (key, pos from 0) with the span they lie in, by the running sum of the spans' sizes."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = spans.withColumn("_end", F.sum(n).over(w))
    each = ends.select(*spans.columns, F.explode(F.when(F.col(n) > 0, F.sequence(F.col("_end") - F.col(n), F.col("_end") - 1))).alias("pos"))
    return each.join(words, [key, "pos"])


def positional_arrays(spans: DataFrame, rows: DataFrame, key: str, order: str, n: str, words: str) -> DataFrame:
    """spans' columns, pos, word: as positional, for rows (unique key) that hold their words as an array.

    A row's words and its spans meet by the key as arrays, and each span takes its slice, so words are not shuffled one by one.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    others = [c for c in spans.columns if c != key]
    held = spans.withColumn("_at", F.sum(n).over(w) - F.col(n)).where(F.col(n) > 0).groupBy(key).agg(F.collect_list(F.struct(*others, "_at")).alias("_spans"))  # of one row
    part = lambda s: F.slice(words, (s["_at"] + 1).cast("int"), s[n].cast("int"))
    cut = F.transform("_spans", lambda s: F.struct(*(s[c].alias(c) for c in others), s["_at"].alias("_at"), part(s).alias("_w")))
    return rows.join(held, key).select(key, F.inline(cut)).select(key, *others, "_at", F.posexplode("_w").alias("_i", "word")).select(key, *others, (F.col("_at") + F.col("_i")).alias("pos"), "word")


def salvage(new: DataFrame, old: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """new, and the old rows whose keys are not in it and that are valid."""
    return new.unionByName(old.where(valid).join(new.select(*keys).distinct(), keys, "left_anti"))


def label_sets(expected: Column, actual: Column) -> dict[str, Column]:
    """Words that are in both, missing and surplus, sorted."""
    return {"hits": F.array_sort(F.array_intersect(expected, actual)), "misses": F.array_sort(F.array_except(expected, actual)), "extra": F.array_sort(F.array_except(actual, expected))}
