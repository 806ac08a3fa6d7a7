"""Joins, upserts, picks, sequences, alignments, sources and streams on small cases."""

import functools
import gzip
import itertools
import random
import re
import wave
from difflib import SequenceMatcher
from math import ceil

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexmill.operators.buckets import Buckets
from lexmill.operators import em, joins, merge, picks, sequences as S, stats
from lexmill.plans import evaluate, serve
from lexmill.sources import files, html, sinks
from lexmill.streaming import logs


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_chain_takes_the_first_match(spark):
    first = spark.createDataFrame([("big", "gordo", 1), ("big", "grande", 2)], "key string, via string, seq int")
    second = spark.createDataFrame([("grande", "pu")], "via string, value string")
    assert rows(joins.chain_first(first, second)) == [("big", "grande", "pu")]


def test_synonyms(spark):
    known = spark.createDataFrame([("fire", "uu")], "word string, target string")
    edges = spark.createDataFrame([("fire", "blaze"), ("flame", "fire")], "word string, synonym string")
    assert rows(joins.expand_synonyms(known, edges), "source_word", "target", "confidence") == [("blaze", "uu", 0.8), ("flame", "uu", 0.8)]


def test_first_and_last_wins_whatever_the_order(spark):
    df = spark.createDataFrame([("agua", "t1", 1), ("agua", "t2", 2)], "k string, v string, seq int")
    for d in (df, df.repartition(3), df.orderBy(F.desc("seq"))):
        assert picks.pick(d, ["k"], ["seq"]).first().v == "t1" and picks.pick(d, ["k"], ["seq"], "last").first().v == "t2"


def test_rank_dedupe(spark):
    df = spark.createDataFrame([(1, "X", "y", "full_nt_align"), (2, "x", "Y", "SIL_Dictionary_OCR"), (3, "x", "y", "SIL_Dictionary_OCR")], "id int, t string, s string, source string")
    assert rows(picks.best_source(df, [F.lower("t"), F.lower("s")], picks.source_rank(F.col("source")), "id"), "id") == [(2,)]


def test_fuzzy(spark):
    words = spark.createDataFrame([("qjuisin",), ("phat",), ("zzz",)], "w string")
    known = spark.createDataFrame([("qjuisim",), ("pjat",)], "v string")
    assert rows(joins.fuzzy(words, "w", known), "word", "match", "step") == [("phat", "pjat", "variant"), ("qjuisin", "qjuisim", "similar")]
    assert rows(joins.fuzzy(words, "w", known, 0.88, 2), "word") == [("phat",)]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", "x", 0.5, "dictionary_direct"), ("b", "y", 0.5, "ibm")], "en string, tol string, confidence double, source string")
    new = spark.createDataFrame([("a", "x", 0.8, "ibm"), ("b", "y", 0.9, "new"), ("c", "z", 0.7, "new")], old.schema)
    k = ["en", "tol"]
    guarded = merge.upsert_guarded(old, new, k, "confidence", "source", ["dictionary_direct"], ["source"])
    assert rows(guarded, "en", "confidence") == [("a", 0.5), ("b", 0.9), ("c", 0.7)]
    for f in (lambda o: merge.upsert_max(o, new, k, "confidence", ["source"]), lambda o: merge.insert_ignore(o, new, k, ["source"]), lambda o: merge.boost(o, new, k, "confidence", "source", ["source"]), lambda o: merge.insert_or_replace(o, new, k, ["confidence", "source"], ["source"])):
        assert rows(f(f(old))) == rows(f(old))
    assert rows(merge.purge(old, F.col("confidence") < 0.6, F.lit(None).cast("boolean"))) == []


def test_conflicts(spark):
    verified = spark.createDataFrame([("Fire", "uu")], "english string, tol string")
    df = spark.createDataFrame([("fire", "zz", "inferred_promotion"), ("fire", "zz", "dictionary_direct"), ("fire", " UU", "inferred_promotion")], "english string, tol string, source string")
    assert rows(joins.without_conflicts(df, verified, "english", "tol", "source"), "tol", "source") == [(" UU", "inferred_promotion"), ("zz", "dictionary_direct")]


def test_relations_on_empty_tables(spark):
    e = spark.createDataFrame([], "word string, synonym string, target string, value string, seq int")
    assert joins.expand_synonyms(e.select("word", "target"), e.select("word", "synonym")).count() == 0
    assert joins.fuzzy(e.select("word"), "word", e.select("word")).count() == 0
    assert picks.pick(e, ["word"], ["seq"]).count() == 0 and picks.number_rows(e, ["word"]).count() == 0


def test_em(spark):
    df = spark.createDataFrame([(1, ["water", "fire"], ["uu", "vv"]), (2, ["water"], ["uu"])], "id int, en array<string>, tol array<string>")
    p = {(r.tol, r.en): round(r.p, 6) for r in em.model1(df, "id", "en", "tol", 1).collect()}
    assert p == {("uu", "water"): 0.75, ("vv", "water"): 0.25, ("uu", "fire"): 0.5, ("vv", "fire"): 0.5}
    two = em.model1(df, "id", "en", "tol", 2)
    assert {(r.tol, r.en): round(r.p, 6) for r in two.collect()} == {("uu", "water"): 0.827586, ("vv", "water"): 0.172414, ("uu", "fire"): 0.375, ("vv", "fire"): 0.625}
    assert all(abs(r.s - 1) < 1e-9 for r in two.groupBy("en").agg(F.sum("p").alias("s")).collect())
    assert rows(em.best_pairs(two), "en", "tol") == [("fire", "vv"), ("water", "uu")]


def test_silences(spark):
    f = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([500, 100, 100, 100, 500, 100])], "path int, frame int, rms double")
    assert rows(S.silences(f, ["path"], 400, 20), "start_ms", "end_ms", "mid_ms") == [(10, 40, 25)]
    assert len(rows(S.silences(f, ["path"], 400, 10))) == 2 and len(rows(S.silences(f, ["path"], 400, 10, keep_open=False))) == 1


def test_longest_run_and_upper_median(spark):
    runs = spark.createDataFrame([(1, 30, 40, 11), (1, 50, 60, 11), (1, 5, 19, 15)], "k int, first int, last int, n int")
    assert rows(S.longest_run(runs, ["k"], F.lit(100)), "first") == [(30,)]
    assert stats.upper_median(spark.createDataFrame([(1, v) for v in (1, 2, 3, 4)], "k int, v int"), ["k"], "v").first().upper_median == 3


def test_dictionary_page(spark):
    got = spark.sql("SELECT 1 AS one").lateralJoin(S.DictionaryPage(F.lit("tsji (s) dog\nbig one\nuu\n(v: x) burn\nwood"))).collect()
    assert [(r.headword, r.pos, r.definition) for r in got] == [("tsji", "s", "dog big one"), ("uu", "v", "burn wood")]


def test_verses(spark):
    page = '<span class="verse" id="V1">1&#160;</span>aa <span class="verse" id="V2">2-3&#160;</span>bb <span class="verse" id="V4">4&#160;</span>cc <ul class=\'tnav\'>'
    df = spark.createDataFrame([(1, page)], "k int, value string")
    assert rows(html.verses(df, ["k"]), "verse", "text") == [(1, "aa"), (4, "cc")]
    assert rows(html.verses(df, ["k"], merged="replicate"), "verse", "text") == [(1, "aa"), (2, "bb"), (3, "bb"), (4, "cc")]
    assert rows(html.first_verses(df, ["k"], least=1), "text") == [("aa",), ("bb",), ("cc",)]


def test_files(spark, tmp_path):
    (tmp_path / "MAT01.htm").write_text('<span class="verse" id="V1">1&#160;</span>In <span class="popup">x</span>time<ul>')
    assert rows(html.read_corpus(spark, {"en": f"{tmp_path}/*.htm"})) == [("en", "MAT", 1, 1, "In time")]
    (tmp_path / "e.json").write_text('[{"tol": "a", "spanish": "b"}, {"tol": "c"}]')
    assert rows(files.json_entries(spark, f"{tmp_path}/e.json", "tol string, spanish string, category string"), "tol", "spanish") == [("a", "b"), ("c", None)]
    (tmp_path / "p.json").write_text('{"3": "x", "4": "y"}')
    assert rows(files.page_map(spark, f"{tmp_path}/p.json")) == [(3, "x"), (4, "y")]
    (tmp_path / "d.json").write_text('{"dictionary": [{"tol": "a", "spanish": "b"}]}')
    a, b = files.parsed_dictionary(spark, f"{tmp_path}/d.json")
    assert a.count() == 1 and b.count() == 0
    (tmp_path / "pairs.txt").write_text("a b\tc\nx y\nbad\n")
    assert rows(files.word_pairs(spark, f"{tmp_path}/pairs.txt", ("s", "t"))) == [("a b", "c"), ("x", "y")]
    (tmp_path / "moby.txt").write_text("fire,Blaze, flame\nsun\n")
    assert rows(files.adjacency(spark.read.text(f"{tmp_path}/moby.txt"))) == [("fire", "blaze"), ("fire", "flame")]
    (tmp_path / "rec.txt").write_text("dog\npos: n\ngloss: perro\ngloss: can\n_____\nrun\ngloss: correr\npos: v\ngloss: huir\n_____\n")
    assert rows(files.records(spark, f"{tmp_path}/rec.txt"), "headword", "pos", "gloss") == sorted([("dog", "n", "can"), ("dog", "n", "perro"), ("run", None, "correr"), ("run", "v", "huir")], key=str)
    groups = spark.createDataFrame([(1, ["a, b", "a", "c"])], "group_id int, g array<string>")
    assert rows(files.group_members(groups, "g"), "word") == [("a",), ("b",), ("c",)]
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(1000), w.writeframes(b"\x03\x00\x04\x00" * 10)
    f = files.frames(files.pcm(spark, f"{tmp_path}/x.wav"))
    assert [round(r.rms, 4) for r in f.orderBy("frame").collect()] == [3.5355, 3.5355]
    arts = spark.createDataFrame([("d1/ckpt", 1, 5), ("d1/best_model", 1, 4), ("d0/x", 2, 9)], "name string, dir_rank int, mtime int")
    assert files.latest(arts, "dir_rank", "mtime", "name").first().name == "d1/best_model"
    assert files.not_done(spark.createDataFrame([("a",), ("b",)], "stem string"), spark.createDataFrame([("a",)], "stem string")).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([('a "q"|b', 1.5)], "text string, duration_s double")
    sinks.write_pipe(df, f"{tmp_path}/p")
    assert files.csv_rows(spark, f"{tmp_path}/p", "|").first().text == 'a "q"|b'
    assert sinks.document(df, "vocabulary", ["text"]).first().value.startswith('{"vocabulary":[{')
    sinks.append_jsonl(df, f"{tmp_path}/j"), sinks.append_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.rebuild(df, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 1


def test_evaluation(spark):
    df = spark.createDataFrame([("huph nt'a la", "huph la nt'a"), ("a", "a b")], "g string, w string").select(F.split("g", " ").alias("g"), F.split("w", " ").alias("w"))
    got = evaluate.scores(df, "g", "w").select("lcs", "bow").collect()
    assert [(round(r.lcs, 4), r.bow) for r in got] == [(0.6667, 1.0), (0.0, 0.0)]
    assert evaluate.template_sentences(spark, {"t": ("I _ it", ["see", "hold"], 5)}).count() == 5


def test_translate(spark):
    words = spark.createDataFrame([("fire",), ("blaze",), ("x",)], "w string")
    a = spark.createDataFrame([("fire", "uu")], "word string, value string")
    b = spark.createDataFrame([("blaze", "uu"), ("fire", "zz")], "word string, value string")
    assert rows(serve.translate_words(words, "w", a, b)) == [("blaze", "uu", "inferred"), ("fire", "uu", "dictionary"), ("x", None, "not_found")]


def test_stream_upsert(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 2.0, 3)], "k string, v double, seq int")
    df.write.parquet(f"{tmp_path}/in")
    kept = Buckets(spark, f"{tmp_path}/out", ["k"], 4, df.schema).create(df.limit(0))
    logs.upsert_stream(logs.file_stream(spark, f"{tmp_path}/in", df.schema), kept, f"{tmp_path}/cp", "v", ["seq"])
    assert rows(kept.read(), "k", "v") == [("a", 1.0), ("b", 2.0)]
    steps = spark.createDataFrame([(i,) for i in (1, 250, 500)], "global_step int")
    assert logs.every_step(steps).count() == 2


def test_missing_groups_and_passes(spark):
    a = spark.createDataFrame([(1, "aa\nb"), (2, "c")], "page int, text string")
    b = spark.createDataFrame([(1, "a\nbbb\nd")], "page int, text string")
    assert rows(joins.merge_passes([a, b], "page", F.length)) == [(1, 0, "aa"), (1, 1, "bbb"), (1, 2, "d"), (2, 0, "c")]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_number_rows(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 5).alias("a"), "id")
    got = picks.number_rows(df, ["a", "id"], "no").collect()
    assert [(r.a, r.id) for r in sorted(got, key=lambda r: r.no)] == sorted((r.a, r.id) for r in got) and sorted(r.no for r in got) == list(range(1, n + 1))


def test_upserts_with_null_keys(spark):
    old = spark.createDataFrame([(None, 2, "y"), ("a", 1, "z")], "word string, n int, source string")
    new = spark.createDataFrame([(None, 3, "p"), (None, 1, "q"), ("b", 5, "w")], "word string, n int, source string")
    kept = merge.upsert_max(old, old, ["word"], "n", ["n"])
    assert rows(kept, "word", "n", "source") == rows(old, "word", "n", "source")
    assert rows(merge.upsert_max(old, new, ["word"], "n", ["source"]), "word", "n", "source") == sorted([(None, 3, "y"), ("a", 1, "z"), ("b", 5, "w")], key=str)
    once = merge.insert_ignore(old, new, ["word"], ["n"])
    assert rows(once, "word", "n") == sorted([(None, 2), ("a", 1), ("b", 5)], key=str)
    assert rows(merge.insert_ignore(once, new, ["word"], ["n"]), "word", "n") == rows(once, "word", "n")


def test_nearest_within_a_band(spark):
    targets = spark.createDataFrame([("k", 0.0), ("k", 10.0)], "key string, t double")
    points = spark.createDataFrame([("k", 0.5), ("k", 1000.0)], "key string, p double")
    assert rows(joins.nearest(targets, points, "key", "t", "p", band=1), "t", "p") == sorted([(0.0, 0.5), (10.0, None)], key=str)
    assert rows(joins.nearest(targets, points, "key", "t", "p"), "t", "p") == sorted([(0.0, 0.5), (10.0, 0.5)], key=str)


def test_counts_of_a_long_row(spark):
    words = [f"w{i % 7}" for i in range(20_000)]
    df = spark.createDataFrame([(words,), (["w1", "w1", "z"],), ([],), (None,)], "w array<string>")
    got = {r.term: (r.tf, r.df) for r in stats.document_counts(df, "w").collect()}
    assert got["w1"] == (words.count("w1") + 2, 2) and got["z"] == (1, 1) and len(got) == 8
    grams = {(r.n, r.gram): r.cnt for r in stats.ngram_counts(df, "w").collect()}
    assert grams[2, "w1 z"] == 1 and grams[3, "w1 w1 z"] == 1 and grams[1, "z"] == 1 and sum(c for (n, _), c in grams.items() if n == 3) == 20_000 - 2 + 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12), st.lists(st.integers(0, 60), max_size=8), st.sampled_from([None, 1, 7, 25]))
def test_nearest_against_all_pairs(spark, at, spots, width):
    targets = spark.createDataFrame([("k", t) for t in sorted(set(at))], "key string, t long")
    points = spark.createDataFrame([("k", p) for p in spots], "key string, p long")
    want = [(t, min(spots, key=lambda p, t=t: (abs(p - t), p), default=None)) for t in sorted(set(at))]
    assert rows(joins.nearest(targets, points, "key", "t", "p", width=width), "t", "p") == sorted(want, key=str)


def test_respelled_phrases_against_all_pairs(spark):
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("cjpkshtau") for _ in range(rng.randrange(2, 7))) for _ in range(60)} | {"pjaa", "cjua"})
    phrases = [(i, " ".join("".join(w[:k] + rng.choice("cjpkshtau") + w[k + 1 :]) + rng.choice(["", ".", "!"]) for w in rng.choices(known, k=3) for k in [rng.randrange(len(w))])) for i in range(20)] + [(99, "Phaa, khua ZZZ")]
    got = {r.id: r.text for r in joins.respelled(spark.createDataFrame(phrases, "id int, text string"), "id", "text", spark.createDataFrame([(k,) for k in known], "w string")).collect()}

    def spelled(w):
        w = re.sub("[.,;:!?]", "", w.lower())
        tried = [w, *(w.replace(a, b) for a, b in (("ph", "pj"), ("kh", "cj"), ("th", "tj"), ("sh", "sj"), ("ch", "cj")))]
        if same := [v for v in tried if v in known]:
            return same[0]
        near = sorted((-SequenceMatcher(None, w, k).ratio(), k) for k in known if k[0] == w[0] and abs(len(k) - len(w)) <= 2)
        return near[0][1] if near and -near[0][0] >= 0.88 else w

    assert got == {i: " ".join(map(spelled, t.split())) for i, t in phrases} and got[99] == "pjaa cjua zzz"


def test_segments_are_cut_and_read_back(spark, tmp_path):
    samples = [(i * 37) % 30_000 - 15_000 for i in range(4000)]
    audio = spark.createDataFrame([("a", 8000, samples), ("b", 8000, [])], "path string, rate int, samples array<int>")
    cuts = [("a", "one", 0, 100), ("a", "two", 400, 900), ("a", "none", 300, 300), ("a", "late", 9000, 9500), ("b", "empty", 0, 10)]
    out = sinks.cut_segments(audio, spark.createDataFrame(cuts, "path string, name string, start_ms long, end_ms long")).collect()
    assert {r.name for r in out} == {"one", "two"}
    (tmp_path / "wav").mkdir()
    for r in out:
        (tmp_path / "wav" / f"{r.name}.wav").write_bytes(r.content)
    back = {r.path.rsplit("/", 1)[1]: r for r in files.pcm(spark, f"{tmp_path}/wav").collect()}
    assert back["one.wav"].samples == samples[:800] and back["two.wav"].samples == samples[3200:4000] and back["one.wav"].rate == 8000


def test_split_gzip(spark, tmp_path):
    data = b"".join(b"%d," % i for i in range(200_000))
    packed = gzip.compress(data[:500_000]) + gzip.compress(data[500_000:])
    (tmp_path / "parts").mkdir()
    for k in range(0, len(packed), 100_000):
        (tmp_path / "parts" / f"x.part{k // 100_000:02d}").write_bytes(packed[k : k + 100_000])
    got = files.split_gzip(spark, f"{tmp_path}/parts", 1 << 16).orderBy("pos").collect()
    assert b"".join(r.chunk for r in got) == data and len(got) > 3


def test_word_list(spark, tmp_path):
    (tmp_path / "words.txt").write_text("fire\n\n water \n")
    assert rows(files.word_list(spark, f"file://{tmp_path}/words.txt")) == [("fire",), ("water",)]
    assert files.word_list(spark, f"file://{tmp_path}/none.txt").count() == 0 and files.word_list(spark, "no address").count() == 0


def test_dictionary_pages_that_were_written_from_entries(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeü'") for _ in range(rng.randrange(2, 7))).strip("'") or "x"
    pages = []
    for p in range(30):
        entries, lines = [], []
        for _ in range(rng.randrange(1, 8)):
            head, pos, first = " ".join(word() for _ in range(rng.randrange(1, 3))), rng.choice(["s", "vt", "adj"]), " ".join(word() for _ in range(3))
            more = [" ".join(word() for _ in range(2)) for _ in range(rng.randrange(3))]
            entries.append((head, pos, " ".join([first, *more]), len(lines)))
            tag = pos + rng.choice(["", ": x", ", y"])
            lines += ([f"{head} ({tag}) {first}"] if rng.random() < 0.6 else [head, f"({tag}) {first}"]) + [x + rng.choice(["", "\n"]) for x in more]
            lines = "\n".join(lines).split("\n")
        pages.append((p, "\n".join(lines), entries))
    df = spark.createDataFrame([(p, t) for p, t, _ in pages], "p int, text string")
    got = df.lateralJoin(S.DictionaryPage(F.col("text").outer())).collect()
    for p, _, entries in pages:
        assert [(r.headword, r.pos, r.definition, r.line_no) for r in sorted((r for r in got if r.p == p), key=lambda r: r.line_no)] == entries
