"""What queries shuffle, make and open, by their plans, and results on inputs with many copies."""

import re
import time
from collections import Counter

import numpy as np
from conftest import SF, duck, same_rows
from pyspark.sql import functions as F

from lexmill.operators import joins, matching as M, stats
from lexmill.queries import ORACLES, QUERIES
from lexmill.queries.corpus import WORDS as ORACLE_WORDS
from lexmill.sources import ranges


def nodes(df, kinds):
    """Input columns of the plan's nodes of these kinds."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"(\w+)#", m.group(1))) for m in re.finditer(rf"\(\d+\) (?:{kinds})\nInput \[\d+\]: \[(.*)\]", text)]


def test_whole_contexts_are_not_shuffled(spark):
    moved = nodes(QUERIES["a23_whole_contexts"](spark, SF), "Exchange")
    assert moved and not any("context" in m for m in moved)


def test_grams_are_counted_before_they_are_rows(spark, monkeypatch):
    """Grams are dealt as arrays; stretches, groups, nulls and words with spaces don't change their numbers."""
    moved = nodes(QUERIES["a05_ngrams"](spark, SF), "Exchange")
    assert moved and not any("gram" in m for m in moved)
    assert same_rows([r.asDict() for r in QUERIES["a05_ngrams"](spark, SF).collect()], duck(ORACLES["a05_ngrams"]))
    monkeypatch.setattr(stats, "GRAM_WORDS", 5)
    monkeypatch.setattr(stats, "GROUP_WORDS", 3)
    texts = [["a", "b", "a", "b"], ["a b", "ä"], [], None, ["a", None, "b", "ä"], ["x" * 50_000], ["a", "b", "ä", ""]] * 4
    rows = spark.createDataFrame([(t,) for t in texts], "w array<string>").repartition(3)
    want = Counter((n, " ".join(t[i : i + n])) for t in texts if t for n in (1, 3) for i in range(len(t) - n + 1) if None not in t[i : i + n])
    assert {(r.n, r.gram): r.cnt for r in stats.ngram_counts(rows, "w", (1, 3)).collect()} == want
    assert stats.ngram_counts(rows.limit(0), "w").collect() == []


def test_samples_are_neither_shuffled_nor_sorted(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": spark.conf.get("spark.sql.autoBroadcastJoinThreshold")}
    for limit in ("-1", held["spark.sql.autoBroadcastJoinThreshold"]):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        moved = nodes(QUERIES["k12_segments"](spark, SF), "Exchange|BroadcastExchange|Sort")
        assert moved and not any("samples" in m for m in moved)


def test_equal_names_are_aligned_once(spark, tmp_path):
    rows = [(i, ("red ring", "hot bolt", " odd  one")[i % 3], ("TIN", "LARGE")[i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["g03_dtw"](spark, str(tmp_path))
    assert not nodes(df, "ArrowEvalPython")  # done for the distinct pairs, and kept
    want = set()
    for k, name, kind in rows:
        at, pairs = 0, M.warp(f"{kind} {name}".lower(), "".join(name.split(" ")))
        for i, w in enumerate(name.split(" ")):
            s = [s for t, s in pairs if at <= t < at + len(w)]
            want.add((k, i, w, min(s, default=None), max(s, default=None)))
            at += len(w)
    got = [tuple(r[c] for c in ("p_partkey", "word_no", "word", "first_char", "last_char")) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want


def test_short_sounds_share_partitions(spark, tmp_path):
    import wave

    for i in range(300):
        with wave.open(str(tmp_path / f"{i}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(1000)
            w.writeframes(np.full(i % 40, i, "<i2").tobytes())
    (tmp_path / ".7-new.wav").write_bytes(b"RIFF")  # being written
    df = ranges.wav_frames(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= 2
    assert sorted((r.path, r.frame, r.rate, r.rms) for r in df.collect()) == sorted((f"{i}.wav", k, 1000, float(i)) for i in range(300) for k in range(i % 40 // 10))


def test_planned_sounds_are_not_named(spark, tmp_path):
    """What the driver plans grows with folders and long sounds, not with the number of files; each frame is read once."""
    import pickle
    import wave

    want = set()
    for name, n in [*((f"{'many' if i % 3 else f'few/{i % 7}'}/{i}.wav", 10 + i % 20) for i in range(2000)), ("few/3/long.wav", 3000), ("many/long.wav", 650), ("none/0.wav", 0), ("top.wav", 40)]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(1000)
            w.writeframes(np.full(n, n, "<i2").tobytes())
        want |= {(name, k, 1000, float(n)) for k in range(n // 10)}
    (tmp_path / "many" / ".7-new.wav").write_bytes(b"RIFF")  # being written
    (tmp_path / "many" / "gone.wav").symlink_to(tmp_path / "none.wav")
    parts = ranges.WavFramesReader(str(tmp_path), 10, 300).partitions()
    assert {x for p in parts for x in p.paths} == {"few/3/long.wav", "many/long.wav"} and not any(b".wav" in pickle.dumps(p) for p in parts if not p.paths)
    assert sum(p.slices[:1] == [("many", k, ranges.SLICES)] for k in range(ranges.SLICES) for p in parts) == ranges.SLICES
    got = [tuple(r) for r in ranges.wav_frames(spark, str(tmp_path), partition_frames=300).collect()]
    assert len(got) == len(want) and set(got) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = ranges.wav_frames(spark, str(tmp_path), partition_frames=300).where("path = 'many/19.wav' AND frame >= 1").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert [tuple(r) for r in got] == [("many/19.wav", 1, 1000, 29.0)]


def test_repeated_members_of_a_group(spark):
    rows = spark.range(60_000).selectExpr("1 AS g", "'m' || id % 3 AS m")
    began = time.time()
    got = {tuple(r) for r in joins.group_pairs(rows, "g", "m").collect()}
    assert got == {(f"m{a}", f"m{b}") for a in range(3) for b in range(3) if a != b} and time.time() - began < 30


def test_residual_reads_pairs_once(spark):
    df = QUERIES["j22_residual_align"](spark, SF)
    text = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert text.count("lineitem.parquet") == 1
    pairs = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, ["a"], ["x"]), (3, ["c"], ["z"]), (4, ["a", "c", None], ["x", "q"]), (5, [], ["x"]), (None, ["c"], ["z"])], "k int, l array<string>, r array<string>")
    known = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "q")], "left_word string, right_word string")
    assert {tuple(r) for r in joins.residual(pairs, "l", "r", known, "k").collect()} == {(1, "b", "y"), (3, "c", "z")}


def test_prefixes_need_no_postings(spark):
    from lexmill.operators import fulltext

    assert not any("places" in m or "at" in m for m in nodes(QUERIES["g08_prefix"](spark, SF), "Exchange|Scan ExistingRDD"))
    rows = spark.createDataFrame([(1, ["ab", "ab", "b"]), (1, ["ab"]), (2, ["ab", "abc"]), (3, None), (None, ["ab"])], "k int, w array<string>")
    assert {tuple(r) for r in fulltext.vocabulary(rows, "k", "w").collect()} == {("ab", 2), ("b", 1), ("abc", 1)}
    assert {tuple(r) for r in fulltext.vocabulary(rows.where("k = 2"), "k", "w").collect()} == {("ab", 1), ("abc", 1)}


def test_words_of_lines_are_shuffled_as_arrays(spark):
    assert not any("word" in m for m in nodes(QUERIES["j30_positional"](spark, SF), "Exchange"))


def test_languages_of_a_corpus_are_one_read(spark, tmp_path):
    from lexmill.sources import html

    for lang in ("aa", "bb", "cc"):
        (tmp_path / lang).mkdir()
        for book in ("MAT01", "GEN01"):
            (tmp_path / lang / f"{book}.htm").write_text(f'<span class="verse" id="V">1&#160;</span>{lang} {book} <span class="verse" id="V">2&#160;</span>more <ul class="tnav">')
    df = html.read_corpus(spark, {f"l-{x}": f"{tmp_path}/{x}" for x in ("aa", "bb", "cc")}, books=["MAT"])
    assert len(nodes(df, "Union")) == 0 and "Union" not in df._jdf.queryExecution().toString()
    assert {tuple(r) for r in df.collect()} == {(f"l-{x}", "MAT", 1, v, t) for x in ("aa", "bb", "cc") for v, t in ((1, f"{x} MAT01"), (2, "more"))}


def test_many_chapters_are_few_partitions(spark, tmp_path):
    """Chapters are dealt by bytes, not each as four megabytes; the writer's setting is put back."""
    from lexmill.sources import html

    rows = [(f"{lang}/{book}{c:03d}.htm", f'<span class="verse" id="V">1&#160;</span>{lang} {book} {c} \u00e9<ul>'.encode()) for lang in ("aa", "bb", "cc") for book in ("MAT", "GEN", "PSA") for c in range(1, 61)]
    rows += [("dd/MAT001.htm", b"x"), ("aa/deep/MAT001.htm", b"x"), ("aa/.MAT001.htm", b"x"), ("aa/MAT001.txt", b"x")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ranges.write_files(spark.createDataFrame(rows, "name string, content binary").coalesce(2), str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    df = html.read_corpus(spark, {f"l-{x}": f"{tmp_path}/{x}" for x in ("aa", "bb", "cc")}, books=["MAT", "PSA"], most=50)
    assert df.rdd.getNumPartitions() == 1
    got = [tuple(r) for r in df.collect()]
    want = {(f"l-{x}", b, c, 1, f"{x} {b} {c} \u00e9") for x in ("aa", "bb", "cc") for b in ("MAT", "PSA") for c in range(1, 51)}
    assert len(got) == len(want) and set(got) == want
    parts = ranges.FilesReader(str(tmp_path), ["aa", "bb"], ["MAT"], ".htm")
    ranges.PART, whole = 64 << 10, ranges.PART
    try:
        planned = parts.partitions()
        names = [n for p in planned for b in parts.read(p) for n in b.column(0).to_pylist()]
    finally:
        ranges.PART = whole
    assert len(planned) > 20 and sorted(names) == sorted(n for n, _ in rows if n[:3] in ("aa/", "bb/") and n[3:6] == "MAT" and n.endswith("htm"))


def test_pairs_of_words_are_not_stored(spark, monkeypatch):
    from lexmill.operators import em
    from lexmill.operators.durable import durable

    rng = np.random.default_rng(3)
    words = lambda c, n: [f"{c}{int(i)}" for i in rng.zipf(1.5, n) % 25]
    data = [(int(i % 70), words("e", 3 + i % 5), words("t", 4 + i % 7)) for i in range(80)]  # ten keys have two rows
    units = {}
    for k, a, b in data:
        units.setdefault(k, ([], []))[0].extend(a)
        units[k][1].extend(b)
    p = {}
    for r in range(5):
        c, n = {}, {}
        for a, b in units.values():
            for t in b:
                z = sum(p.get((e, t), 0.0) if r else 1.0 for e in a)
                for e in a:
                    c[e, t] = c.get((e, t), 0) + (p[e, t] if r else 1.0) / z
        for (e, _), v in c.items():
            n[e] = n.get(e, 0) + v
        p = {(e, t): v / n[e] for (e, t), v in c.items()}
    df = spark.createDataFrame([*data, (None, ["e1"], ["t1"])], "k int, a array<string>, b array<string>")
    kept = []
    monkeypatch.setattr(em, "durable", lambda x: kept.append(set(x.columns)) or durable(x))
    for part, hot in ((4_000_000, 8_000_000), (300, 500), (100, 10**9)):
        monkeypatch.setattr(em, "PAIRS", part)
        monkeypatch.setattr(em, "HOT", hot)
        kept.clear()
        got = {(x.en, x.tol): x.p for x in em.model1(df, "k", "a", "b", least=0.0).collect()}
        assert got.keys() == p.keys() and all(abs(got[x] - p[x]) < 1e-9 for x in p)
        assert hot == 500 or not any({"en", "tol"} <= c or {"e", "t"} <= c and "me" not in c or {"me", "k"} <= c for c in kept)
    assert {(x.en, x.tol) for x in em.model1(df, "k", "a", "b", least=0.2).collect()} == {x for x, v in p.items() if v >= 0.2}


def test_an_index_of_what_is_asked(spark, monkeypatch):
    from lexmill.operators import fulltext

    rng = np.random.default_rng(5)
    docs = [(i, [f"w{int(j)}" for j in rng.zipf(1.4, i % 30) % 40]) for i in range(300)]
    rows = spark.createDataFrame([*docs, (7, ["w1", "w2"]), (400, None)], "k int, w array<string>")
    asked = spark.createDataFrame([(1, ["w1", "w2"]), (2, ["w3", "w1", "w1"]), (3, ["zz"]), (4, ["w5"]), (5, None)], "q int, w array<string>")
    among = asked.selectExpr("explode(w) AS token")
    full, some, bare = (fulltext.build(rows, "k", "w", 5, **x) for x in ({}, {"among": among}, {"among": among, "places": False}))
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(fulltext.ranked(full, asked, "q", "w", 4)) == plain(fulltext.ranked(bare, asked, "q", "w", 4))
    assert plain(fulltext.phrases(full, asked, "q", "w")) == plain(fulltext.phrases(some, asked, "q", "w"))
    assert {r.token for r in some.postings.collect()} == {"w1", "w2", "w3", "w5"} and (bare.n, bare.mean) == (full.n, full.mean)
    made, build = [], fulltext.build
    monkeypatch.setattr(fulltext, "build", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    for name, longest in (("g08_phrase", 3), ("g08_ranked", 8)):
        QUERIES[name](spark, SF)
        known = {w for r in duck(f"SELECT ({ORACLE_WORDS.format('text')})[1:{longest}] AS w FROM benchmark") for w in r["w"]}
        assert {r.token for r in made[-1].terms.collect()} <= known and ("places" in str(made[-1].postings.schema)) == (name == "g08_phrase")


def test_runs_are_sought_once(spark, monkeypatch):
    from lexmill.operators import substrings

    monkeypatch.setattr(substrings, "RUNS", 3)  # so that all are let go once
    find = substrings.Finder(["a", "ab", "b c", "]^-", "\\"])
    scans = []
    real = find.automaton
    find.automaton = type("Counted", (), {"iter": lambda self, t: scans.append(t) or real.iter(t)})()
    terms = ["a", "ab", "b c", "]^-", "\\"]
    for text in ("xab", "ab", "zab!", "", None, "b c]^-\\", "bxc", "b" * 50 + " c", "ab"):
        assert find(text) == {i for i, t in enumerate(terms) if text and t in text}
    assert scans.count("ab") == 2 and scans[0] == "ab" != scans[1] and len(find.known) <= 3 and substrings.Finder([])("a") == set()


def test_texts_are_moved_once_to_their_cuts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        moved = nodes(QUERIES["g04_sub_split"](spark, SF), "Exchange")
    finally:
        spark.conf.set(name, before)
    assert moved and not any("_w" in m for m in moved) and sum("text" in m for m in moved) == 1


def test_pairs_that_cannot_pass_are_not_made(spark):
    from lexmill.operators import stats
    from lexmill.plans import phrases

    rows = spark.createDataFrame([(i, [f"g{i % 40}", "often"], ["all", f"w{i % 40}"]) for i in range(200)], "k int, a array<string>, b array<string>")
    got = {tuple(r)[:5] for r in phrases.phrase_pairs(rows, "k", "a", "b", least=2).collect()}
    assert got == {(f"g{i}", f"w{i}", 5, 5, 5) for i in range(40)} | {("often", "all", 200, 200, 200)}
    met = phrases.phrase_pairs(rows, "k", "a", "b", least=2)._jdf.queryExecution().optimizedPlan().toString()
    joins_ = [line for line in met.splitlines() if "Join Inner" in line and "least(" in line]
    assert len(joins_) == 1  # where pairs are made
    for marginal in ("doc", "pair"):
        every = {tuple(r) for r in stats.cooccurrence(rows, "k", "a", "b", 2, marginal).collect()}
        assert {p for p in every if p[3] == p[4]} == {tuple(r) for r in stats.cooccurrence(rows, "k", "a", "b", 2, marginal, F.expr("a_n = b_n")).collect()}
