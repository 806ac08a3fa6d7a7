"""Tables of buckets, streams with late rows and restarts, draws, substrings, the full-text index, and sound by ranges."""

import math
import os
import random
import re
import wave
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import draws, fulltext, joins, merge, substrings
from lexmill.operators.buckets import Buckets
from lexmill.sources import ranges
from lexmill.streaming import logs


def stamps(folder):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    old = spark.createDataFrame([(i, float(i)) for i in range(200)] + [(None, 1.0)], "k int, v double")
    kept = Buckets(spark, f"{tmp_path}/t", ["k"], 8, old.schema).create(old)
    before = stamps(f"{tmp_path}/t/data")
    batch = spark.createDataFrame([(7, 99.0)], old.schema)
    up = lambda a, b: merge.upsert_max(a, b, ["k"], "v", ["v"])
    assert len(kept.apply(batch, up)) == 1
    new = {f for f in stamps(f"{tmp_path}/t/data") if f not in before}
    assert {f: t for f, t in stamps(f"{tmp_path}/t/data").items() if f in before} == before and len({re.search(r"b=(\d+)", f)[1] for f in new}) == 1
    state = sorted(map(str, kept.read().collect()))
    assert kept.read().where("k = 7").first().v == 99.0 and kept.read().count() == 201 and kept.read(0).where("k = 7").first().v == 7.0
    assert kept.apply(batch, up, version=1) == [] and sorted(map(str, kept.read().collect())) == state  # the version is there
    kept.apply(batch, up)
    assert sorted(map(str, kept.read().collect())) == state and kept.apply(batch.limit(0), up) == []
    again = spark.createDataFrame([(None, 5.0), (1000, 1.0)], old.schema)
    kept.apply(again, up)
    assert kept.read().where("k IS NULL").first().v == 5.0 and kept.read().count() == 202


def test_files_that_no_version_lists_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    kept = Buckets(spark, f"{tmp_path}/t", ["k"], 4, rows.schema).create(rows)
    broken = lambda old, new: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        kept.apply(rows, broken)
    rows.withColumn("b", F.lit(0)).write.partitionBy("b").parquet(f"{tmp_path}/t/data/v=1")  # a batch that died before its version was listed
    assert kept.read().count() == 2
    kept.apply(spark.createDataFrame([(1, 9.0)], rows.schema), lambda a, b: merge.upsert_max(a, b, ["k"], "v", ["v"]))
    assert sorted((r.k, r.v) for r in kept.read().collect()) == [(1, 9.0), (2, 2.0)]


START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, v double, id int"


def put(spark, folder, n, rows):
    spark.createDataFrame([(k, START + timedelta(minutes=m), v, i) for k, m, v, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_sessions_of_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    """What a stream gives out over several calls is what a batch query gives, without rows later than the watermark."""
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    make = lambda s: logs.sessions(s, "ts", "v", ["k"], "30 minutes", "2 hours")
    put(spark, source, 0, [("a", 0, 1.0, 1), ("a", 20, 2.0, 2), ("b", 5, 1.0, 3), ("a", 90, 4.0, 4)])
    assert logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check).count() == 0  # the watermark has passed no end
    put(spark, source, 1, [("a", 40, 8.0, 5), ("b", 300, 1.0, 6)])  # late, but within two hours
    logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check)
    put(spark, source, 2, [("a", 1, 100.0, 7), ("c", 2000, 1.0, 8)])  # too late: its session is given out
    logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check)
    put(spark, source, 3, [("c", 4000, 1.0, 9)])
    got = sorted((r.k, r.n, r.total) for r in logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check).collect())
    batch = make(spark.read.parquet(source).where("id <> 7")).where(F.col("end_ts") < F.lit(START + timedelta(minutes=4000 - 120)))
    assert got == sorted((r.k, r.n, r.total) for r in batch.collect()) == [("a", 1, 4.0), ("a", 3, 11.0), ("b", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)]
    again = logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check)
    assert again.count() == len(got)  # nothing new


def test_runs_of_a_stream_in_any_order_with_late_rows_and_a_restart(spark, tmp_path):
    """Closed runs equal the batch operator's over the rows that were in time and have been passed."""
    rng = random.Random(8)
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    make = lambda s: logs.closed_runs(s, "ts", "id", F.col("v") < 5, ["k"], 2, "1 hour")
    rows = [(rng.choice(["a", "b", None]), m // 2, rng.choice([1.0, 2.0, 9.0, None]), m) for m in range(600)]  # two rows a minute, so there are ties
    for n in range(5):
        part = rows[n * 120 : (n + 1) * 120]
        rng.shuffle(part)
        if n == 3:
            part += [("a", 0, 9.0, 9000), ("late", 1, 1.0, 9001)]  # later than the watermark
        put(spark, source, n, part)
        logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check)
    put(spark, source, 5, [("idle", 299 + 90, 9.0, 9999)])  # keys without new rows wake by their timers
    got = sorted((str(r.k), r.first_ts, r.last_ts, r.n) for r in logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check).collect())
    want = []
    for k in ("a", "b", None):
        run = []
        for _, m, v, _ in [r for r in rows if r[0] == k]:
            if v is not None and v < 5:
                run.append(START + timedelta(minutes=m))
            else:
                want += [(str(k), run[0], run[-1], len(run))] if len(run) >= 2 else []
                run = []
    assert got == sorted(want) and len(got) > 50
    assert logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check).count() == len(got)  # nothing new


def test_ratings_count_once_within_the_watermark(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    make = lambda s: logs.once_each(s, "ts", ["k", "id"], "1 hour")
    put(spark, source, 0, [("a", 0, 1.0, 1), ("a", 1, 1.0, 1), ("b", 2, 1.0, 1)])
    logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check)
    put(spark, source, 1, [("a", 30, 1.0, 1), ("a", 31, 1.0, 2)])
    got = logs.follow(spark, source, spark.read.parquet(source).schema, make, out, check).collect()
    assert sorted((r.k, r.id) for r in got) == [("a", 1), ("a", 2), ("b", 1)]


def test_draws_are_exact_and_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    got = [r.k for r in draws.draw(df.repartition(9), "k", 60).collect()]
    assert got == [r.k for r in draws.draw(df.coalesce(1), "k", 60).collect()] and len(set(got)) == 60
    assert [r.k for r in draws.draw(df, "k", 60, seed=1).collect()] != got and draws.draw(df, "k", 900).count() == 500
    odd = draws.draw_accepted(df, "k", 40, lambda p: p.where("k % 7 = 1"))
    order = [r.k for r in draws.draw(df, "k", 500).collect()]
    assert [r.k for r in odd.collect()] == [k for k in order if k % 7 == 1][:40]
    assert [r.k for r in draws.draw_accepted(df, "k", 4, lambda p: p.where("k = 3"), attempts=5).collect()] == [k for k in order[:20] if k == 3]


def test_substring_evidence(spark, monkeypatch):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abAB é%_") for _ in range(rng.randrange(30))) if i % 9 else None) for i in range(200)]
    pairs = [("".join(rng.choice("abB%_") for _ in range(rng.randrange(4))), "".join(rng.choice("ab é") for _ in range(rng.randrange(1, 4)))) for _ in range(80)] + [(None, "a"), ("a", None), ("", "a")]
    low = lambda s: s.lower()
    terms = {(low(a), low(b)) for a, b in pairs if a and b}
    want = {p: n for p in terms if (n := sum(p[0] in low(t) and p[1] in low(t) for _, t in texts if t is not None)) >= 2}
    df, asked = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(pairs, "a string, b string")
    for most in (1000, 20):  # in one block and in several
        monkeypatch.setattr(substrings, "BLOCK_PAIRS", most)
        got = substrings.evidence(asked, df, "a", "b", "t", "t", 2)
        assert {(r.a, r.b): r.evidence for r in got.collect()} == want
        held = {(r.id, r.a) for r in substrings.holding(asked, "a", df, "id", "t").collect()}
        assert held == {(i, low(a)) for i, t in texts if t is not None for a, _ in pairs if a and low(a) in low(t)}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert substrings.evidence(asked.limit(0), df, "a", "b", "t", "t").count() == 0


def corpus(rng, n=300):
    words = [f"w{i}" for i in range(60)]
    return {i: rng.choices(words, weights=[60 / (k + 1) for k in range(60)], k=rng.randrange(0, 40)) for i in range(n)}


def test_index_against_scoring_everything(spark, monkeypatch):
    rng = random.Random(1)
    docs = corpus(rng)
    index = fulltext.build(spark.createDataFrame(list(docs.items()), "id int, w array<string>"), "id", "w", ranges=7)
    assert index.postings.where("token = 'w0'").count() == 7  # a hot token is cut
    asked = {q: rng.choices([f"w{i}" for i in range(70)], k=rng.randrange(1, 6)) for q in range(30)}
    got = {}
    for r in fulltext.ranked(index, spark.createDataFrame(list(asked.items()), "q int, w array<string>"), "q", "w", 5).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.doc, r.score)
    df = Counter(w for d in docs.values() for w in set(d))
    mean = sum(map(len, docs.values())) / len(docs)
    for q, words in asked.items():
        scores = {}
        for i, d in docs.items():
            hit = [w for w in set(words) if w in d]
            if hit:
                scores[i] = sum(math.floor(1e6 * (math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * (d.count(w) * 2.2) / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean)))) for w in hit)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [got.get(q, {}).get(k + 1, (None, -1))[0] for k in range(len(want))] == [i for i, _ in want] and len(got.get(q, {})) == len(want)
    phrases = {q: rng.choices([f"w{i}" for i in range(8)], k=rng.randrange(1, 4)) for q in range(40)}
    found = {(r.q, r.doc): (r.n, r["first"]) for r in fulltext.phrases(index, spark.createDataFrame(list(phrases.items()), "q int, w array<string>"), "q", "w").collect()}
    want = {(q, i): (len(at), at[0]) for q, p in phrases.items() for i, d in docs.items() if (at := [k for k in range(len(d) - len(p) + 1) if d[k : k + len(p)] == p])}
    assert found == want
    pre = {(r.q, r.token) for r in fulltext.prefixes(index, spark.createDataFrame([(1, "w1"), (2, "w"), (3, "zz"), (4, None)], "q int, p string"), "q", "p").collect()}
    assert pre == {(1, w) for w in df if w.startswith("w1")}


def test_an_empty_index(spark):
    index = fulltext.build(spark.createDataFrame([(1, None), (None, ["a"])], "id int, w array<string>"), "id", "w")
    q = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "q int, w array<string>")
    assert fulltext.ranked(index, q, "q", "w").count() == 0 and fulltext.phrases(index, q, "q", "w").count() == 0


def wav(path, samples, channels=1, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())


def test_sound_is_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "s").mkdir()
    sounds = {"one.wav": (rng.integers(-9000, 9000, 80_033), 1), "two.wav": (rng.integers(-9000, 9000, 2 * 8000), 2), "none.wav": (np.zeros(0), 1)}
    for name, (s, c) in sounds.items():
        wav(tmp_path / "s" / name, s, c)
    df = ranges.wav_frames(spark, f"{tmp_path}/s", 10, 300)
    assert df.rdd.getNumPartitions() == 4 + 1  # 1,000 frames and 100, by 300
    got = {(r.path, r.frame): r.rms for r in df.collect()}
    want = {(n, i): math.sqrt((f * f).sum() / 80) for n, (s, c) in sounds.items() for i in range(len(s) // c // 80) for f in [np.asarray(s[::c], float)[i * 80 : i * 80 + 80]]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = ranges.wav_frames(spark, f"{tmp_path}/s", 10, 300).where("path = 'one.wav' AND frame >= 250 AND frame < 600")
        assert part.rdd.getNumPartitions() == 2 and sorted(r.frame for r in part.collect()) == list(range(250, 600))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}.bin", bytes([i] * i)) for i in range(20)], "name string, content binary")
    ranges.write_files(rows.repartition(3), f"{tmp_path}/out")
    assert {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out") if not f.startswith(".")} == {f"f{i}.bin": bytes([i] * i) for i in range(20)}


def test_steps(spark):
    glosses, known = spark.createDataFrame([("red ring", "RR")], "gloss string, value string"), spark.createDataFrame([("red", "R")], "word string, value string")
    got = joins.whole_or_words(spark.createDataFrame([(1, " Red Ring "), (2, "a RED one"), (3, "none"), (4, None)], "id int, t string"), "id", "t", glosses, known)
    assert sorted((r.id, r.text, r.how) for r in got.collect()) == [(1, "RR", "whole"), (2, "a R one", "words")]
    m = spark.createDataFrame([("x/a b.wav",), ("c.wav",)], "file string")
    s = spark.createDataFrame([("q/a_b.flac",), ("p/a b.flac",)], "path string")
    assert [(r.file, r.path) for r in joins.by_file(m, s, "file", "path").collect()] == [("x/a b.wav", "p/a b.flac")]
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    steps = [("direct", spark.createDataFrame([(1, "x"), (1, None)], "k int, value string"), 0.9), ("chain", spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, value string"), 0.6)]
    assert [tuple(r) for r in joins.candidates(keys, "k", steps).orderBy("rank").collect()] == [(1, 1, "x", "direct", 90), (1, 2, "y", "chain", 60)]
