"""Inputs on which operators once lost rows: each named case gives its whole result."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ann, decontaminate, secrets, toxicity

# --- toxicity


def talk(rng, toxic, n):
    calm, rude = "the river runs by old stones and quiet fields under a pale sky".split(), "vile rotten awful nasty".split()
    return " ".join(rng.choices(calm + (rude * 2 if toxic else []), k=n))


def labelled(spark, sizes, others=0):
    rng = random.Random(6)
    rows = [(i, talk(rng, i % 2, n)) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(10**6 + i, i % 2) for i in range(others)], "doc_id long, toxic int")
    return docs, labels


@pytest.mark.parametrize(("sizes", "others"), [([4600] * 60, 0), ([40] * 200, 20_000)])
def test_long_texts_and_labels_of_no_document(spark, sizes, others):
    """Texts of 23,000 characters alone are learned from; labels of others don't use up the draw."""
    docs, labels = labelled(spark, sizes, others)
    model = toxicity.fit_toxicity(docs, labels, F.lit(True), per_label=100, max_chars=20_000)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((s >= 0.3) == (i % 2 == 1) for i, s in got.items())


def test_the_draw(spark):
    docs, labels = labelled(spark, [3] * 10 + [30] * 10, 50)
    extra = docs.unionByName(spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "again", "en"), (None, "x", "en")], docs.schema))
    more = labels.unionByName(spark.createDataFrame([(4, 1), (None, 1), (5, 7), (6, None)], labels.schema))
    rows, counts = toxicity.labelled_texts(extra, more, F.lit(True), 8, 60)
    assert counts == {0: 9, 1: 11} and [v for _, v in rows].count(0) == 8 and [v for _, v in rows].count(1) == 8
    assert all(len(t) <= 60 for t, _ in rows)
    short = {r.text for r in extra.where("length(text) <= 60").collect()}
    assert sum(t in short for t, v in rows if v == 0) == 4  # all short ones before any long one
    assert toxicity.labelled_texts(extra.repartition(7), more.repartition(3), F.lit(True), 8, 60) == (rows, counts)


def test_all_labelled_texts_are_learned_from(spark):
    """25 rude words in eight texts each: a draw of five texts a label holds hardly any of them."""
    rng = random.Random(3)
    rows = [(i, f"{talk(rng, False, 20)} mark{i // 3 % 25 if i % 3 == 0 else 'less'} {talk(rng, False, 20)}", "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True), per_label=5)
    assert zlib.crc32(b"mark24") in model.rows
    new = spark.createDataFrame([(i, f"{talk(rng, False, 15)} mark{i} {talk(rng, False, 15)}") for i in range(25)] + [(100 + i, talk(rng, False, 30)) for i in range(25)], "doc_id long, text string")
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score_toxicity(new, model).collect()}
    assert sum(got[i] for i in range(25)) >= 24 and sum(got[100 + i] for i in range(25)) <= 1
    again = toxicity.fit_toxicity(docs.repartition(7), labels.repartition(3), F.lit(True), per_label=5)
    assert again.cuts == model.cuts and all(np.array_equal(a, b) for x, y in zip(again.tables, model.tables, strict=True) for a, b in zip(x, y, strict=True))


def test_held_out_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op3_toxicity(docs, labels).join(labels, "doc_id").join(docs.where("length(text) > 0").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    for lang in ("en", "de", "fr", "es"):
        of = [r for r in out if r.lang == lang]
        hit = sum(r.toxic and r.predicted for r in of)
        assert hit >= 0.85 * sum(r.toxic for r in of) and hit >= 0.75 * sum(r.predicted for r in of), lang


# --- decontamination


def within_budget(item, text, k):
    """All (start, end) of parts of text within k edits of item, by whole tables."""
    out = set()
    for a in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for e in range(a, min(len(text), a + len(item) + k) + 1):
            if e > a:
                new = [e - a]
                for j, c in enumerate(item, 1):
                    new.append(min(row[j - 1] + (c != text[e - 1]), row[j] + 1, new[-1] + 1))
                row = new
            if row[-1] <= k:
                out.add((a, e))
    return out


def damaged(rng, s, edits):
    s = list(s)
    for p in rng.sample(range(len(s)), edits):
        s[p] = rng.choice("xyz")
    return "".join(s)


def test_repeated_items_lose_no_place():
    """Every place within the budget is a row or overlaps one; rows are within it and apart."""
    rng = random.Random(12)
    for n in range(25):
        item = "".join(rng.choice("abcde") for _ in range(rng.randrange(14, 60)))
        if n % 3 == 0:
            item = (item[:6] * 12)[:60]  # a repeating item
        gap = lambda: rng.choice(["", "q", " and ", "w" * rng.randrange(1, 90)])
        index = decontaminate.Items([(1, item)])
        k = index.budget[0]
        assert k == int(0.08 * len(item))
        text = "".join(gap() + damaged(rng, item, rng.randrange(0, k + 2)) for _ in range(rng.randrange(1, 8))) + gap()
        s = "".join(map(chr, decontaminate.normalised(text)[0]))
        rows = sorted(index.find(np.array([ord(c) for c in s], np.uint32)))
        places = within_budget("".join(map(chr, index.texts[0])), s, k)
        assert all(a[2] <= b[1] for a, b in zip(rows, rows[1:], strict=False))
        assert all((a, e) in places for _, a, e, _ in rows)
        assert all(any(a < e2 and a2 < e for _, a2, e2, _ in rows) for a, e in places if e > a), (item, text)


def test_the_named_text_has_its_row():
    item = ("abcdefghijklmnopqrst " * 5)[:96].strip()
    bad = lambda t, at: t[:at] + "#" + t[at + 1 :]
    text = item + " " + bad(item, 40) + " " + bad(item, 7)
    rows = decontaminate.Items([(1, item)]).scan(text)
    covered = {i for _, a, z, _, _ in rows for i in range(a, z)}
    assert len(rows) == 3 and len(covered) > len(text) - 12


def test_short_items_have_their_whole_budget():
    item = "fifteen letters"
    index = decontaminate.Items([(1, item)])
    assert len(index.texts[0]) == 15 and index.budget == [1]
    assert [r[3] for r in index.scan("some fifteem letters here")] == [1] and index.scan("some fifteem lettars here") == []
    for m in range(1, 400):
        index = decontaminate.Items([(1, "a" * m)])
        q = index.grams[0].q if index.grams else None
        assert index.budget == [int(0.08 * m)] and (q is None or index.bound[0] >= 1 and q >= 5)


def test_a_long_repeating_text_takes_linear_time():
    import time

    item = " ".join(f"word{i % 7}" for i in range(60))
    index, began = decontaminate.Items([(1, item)]), time.process_time()
    rows = index.scan((item + " ") * 300 + (item.replace("word3", "wird3", 1) + " ") * 300)
    assert len(rows) >= 500 and time.process_time() - began < 60


def test_places_across_pieces(monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    text = "z " * 40 + (item + " ") * 6 + "z " * 40
    index = decontaminate.Items([(1, item)])
    whole = index.scan(text)
    for size in (150, 333, 401):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        assert index.scan(text) == whole and len(whole) == 6


# --- secrets

KEY = "4eC39HqLyjWDarjtT1zdp7dc9KqZ"


def hidden(text):
    spans = [x for part in secrets.Scanner().scan(text) for x in part]
    return "".join(c for i, c in enumerate(text) if not any(s <= i < e for s, e, _ in spans))


@pytest.mark.parametrize("text", [f"see https://api.x.com/example/sk_live_{KEY} there", f"key=abcdefghij/{KEY}", f"{KEY}/0123456789", f"placeholder-{KEY}", "a" * 50 + "example" + "/" + KEY])
def test_an_allowed_word_beside_a_key_does_not_free_it(spark, text):
    assert KEY[4:] not in hidden(text) and KEY[:-8] not in hidden(text)
    (row,) = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert "[SECRET]" in row.text and KEY[6:-6] not in row.text


def test_placeholders_stay():
    for text in ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "xxxxxxxxxxxxxxxxxxxxxxxx", "your-placeholder-goes-here-please", "a1b2EXAMPLEc3d4e5f6g"):
        assert secrets.Scanner().entropy(text) == []


# --- nearest


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3 if i % 3 else 5)]) for i in range(200)]
    got = {}
    for r in ann.op7_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 200, 20))
    for q, found in got.items():
        mine = dict(rows)[q]
        want = sorted(((float(np.dot(mine, v)), -i) for i, v in rows if i != q and len(v) == len(mine)), reverse=True)[:20]
        assert np.allclose([s for _, s in found], [s for s, _ in want]) and [i for i, _ in found] == [-i for _, i in want]


def test_many_parts_and_blocks(spark, monkeypatch):
    """Every part sees every block of queries, each query's rows are merged over parts, and repartitioned input gives the same rows."""
    for name, held in (("CHUNK_BYTES", 8 * 8 * 16), ("BLOCK_BYTES", 8 * 8 * 3), ("PART_BYTES", 8 * 8 * 64)):
        monkeypatch.setattr(ann, name, held)  # chunks of 16 rows, blocks of 3 queries, parts of 64 rows
    x = np.random.default_rng(5).integers(-9, 9, (700, 8)).astype(float) + 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plan = ann.op7_nearest(df)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in plan.orderBy("query_id", "rank").collect()]
    assert got == [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op7_nearest(df.repartition(7)).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 700, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want += [(q, n + 1, int(v), float(s[v])) for n, v in enumerate(np.lexsort((np.arange(700), -s))[:20])]
    assert got == want  # chunks of 16 rows are reranked whole


# --- language identification


def test_a_hundred_languages_in_bounded_memory():
    """Landmarks of all languages together are bounded, and presence rows are made a block at a time."""
    import tracemalloc

    from lexmill.llm import langid

    rng = random.Random(3)
    langs = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(40)] for k in range(100)}
    sample = [(" ".join(rng.choices(words, k=30)), lang) for lang, words in langs.items() for _ in range(12)]
    tracemalloc.start()
    model = langid.fit(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    texts = [(" ".join(rng.choices(words, k=30)), lang) for lang, words in langs.items() for _ in range(2)]
    got, _ = model.predict([t for t, _ in texts])
    assert sum(a == b for a, (_, b) in zip(got, texts, strict=True)) > 0.95 * len(texts) and peak < 200e6
