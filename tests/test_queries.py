"""Every query with SQL against DuckDB; the others run and keep their columns."""

import duckdb
import pytest
from conftest import SF, duck, same_rows

from lexmill.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    wanted = duck(ORACLES[name])
    assert got == [] or sorted(got[0]) == sorted(wanted[0])
    assert same_rows(got, wanted)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["gram", "word", "together", "a_n", "b_n", "score"]
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_fuzzy_match_knows_rare_words(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexmill.operators import joins

    texts = ["The river bends northward", "lanterns glow softly; lantern makers sleep", "harbours and harbour walls", "river river river"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "lanternz glow rivers"), (2, "northwards harboor zzz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = sorted({w for t in texts for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() if len(w) >= 2})
    words = ["lanternz", "glow", "rivers", "northwards", "harboor", "zzz"]
    every = spark.createDataFrame([(w, k) for w in words for k in known], "word string, match string")
    ratio = {(r.word, r.match): r.r for r in every.select("word", "match", joins.similarity("word", "match").alias("r")).collect()}
    want = set()
    for w, spelled in [(r.word, r.s) for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", joins.spellings(F.col("word")).alias("s")).collect()]:
        same = [x for x in spelled if x in known]
        near = sorted((-ratio[w, k], k) for k in known if k[0] == w[0] and abs(len(k) - len(w)) <= 3 and ratio[w, k] >= 0.85)
        if same or near:
            want.add((w, same[0] if same else near[0][1]))
    assert ("glow", "glow") in want and len(want) >= 4
    assert {(r.word, r.match) for r in QUERIES["f32_fuzzy_match"](spark, str(tmp_path)).collect()} == want


def turns(spark, folder, pairs):
    rows = [(i, t, "user" if t == 0 else "assistant", x) for i, pair in enumerate(pairs) for t, x in enumerate(pair)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")


def test_whole_contexts_of_long_turns(spark, tmp_path):
    from hashlib import sha256

    shared = ["apple", "banana", "cherry"]
    more = ["word" + c for c in "defghijklmnopq"]
    sides = [[*shared, "zebra", "yellow"], [*shared, "zebra", "xylophone"], [*shared, "zebra", *more]]
    turns(spark, tmp_path, [(" ".join(w), "answer") for w in sides])
    got = {(r.context, r.cnt) for r in QUERIES["a23_whole_contexts"](spark, str(tmp_path)).collect() if r.a_word == "zebra"}
    assert got == {(sha256(" ".join(sorted(set(w) - {"zebra"})).encode()).hexdigest(), 1) for w in sides}


def test_em_over_all_words_against_brute_force(spark, tmp_path):
    pairs = [("red dog", "ko ta the"), ("red cat", "ko mi the"), ("big dog", "su ta"), ("big red ox", "su ko na ko")]
    turns(spark, tmp_path, pairs)
    split = [(a.split(), b.split()) for a, b in pairs]
    words = {w for _, b in split for w in b}
    p = {(e, t): 1 / len(words) for a, b in split for e in a for t in b}
    for _ in range(5):
        count, total = dict.fromkeys(p, 0.0), {}
        for a, b in split:
            for t in b:
                z = sum(p[e, t] for e in a)
                for e in a:
                    count[e, t] += p[e, t] / z
                    total[e] = total.get(e, 0.0) + p[e, t] / z
        p = {(e, t): c / total[e] for (e, t), c in count.items()}
    want = {k: round(v * 1_000_000) for k, v in p.items() if round(v * 1_000_000) > 100_000}
    got = {(r.en, r.tol): r.p_millionths for r in QUERIES["g01_em_all_words"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_extrema_of_large_ids(spark, tmp_path):
    """Ids that outweigh the price and the length in the scores, and values that are null."""
    rows = [(5, "a", "B1", "LARGE", 1, 900.1), (20_000, "a", "B2", "SMALL", 1, 900.0), (3_000_000, "a", "B3", "TIN", 1, 900.0), (1, "a", None, None, 1, 999.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["a17_arg_extrema"](spark, str(tmp_path)).collect()
    assert [tuple(r[c] for c in ("n", "dearest", "first_brand", "last_brand", "shortest")) for r in got] == [(4, "B3", "B1", "B3", "LARGE")]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert same_rows([r.asDict() for r in got], [dict(zip(("p_name", "n", "dearest", "first_brand", "last_brand", "shortest"), r, strict=True)) for r in c.execute(ORACLES["a17_arg_extrema"]).fetchall()])


def test_nearest_unused_without_broadcasts(spark):
    """Targets and points that both come out of joins on the key, whose partitions Spark merges differently."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = [r.asDict() for r in QUERIES["j28_nearest_unused"](spark, "/root/testdata/sf0.01").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert same_rows(got, duck(ORACLES["j28_nearest_unused"], "/root/testdata/sf0.01"))
