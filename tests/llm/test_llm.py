"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest import SF, duck, same_rows
from pyspark.sql import functions as F

from lexmill.llm import ann, components, decontaminate, jaccard, langid, licenses, packing, queries, secrets, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 40_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t", "en", "s", 5), (4, "A.", "en", "s", 2), (5, LONG, "en", "s", len(LONG)),
    (6, "same text here for all of us to read", "en", "s", 1), (6, "same text here for all of us to read", "en", "s", 1), (7, "same text here for all of us to read", None, "s", 1),
    (8, "123 456 !!", "fr", "s", 1), (None, "no id but some words in it", "de", "s", 1), (9, "token = \"abcdefghij0123456789\" é\U0001F600", "en", "s", 1),
]


def docs(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that the operators use themselves
        for c in ("_key", "_text", "score", "node", "n", "h", "value", "labels", "tokens", "spans", "digest", "slot", "shard"):
            df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    got = [r.asDict() for r in queries.queries()[name](spark, SF).collect()]
    assert same_rows(got, duck(queries.oracle_sql()[name]))


# --- language identification


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op1_language_id(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_presence_kernel():
    p, n = langid.presence(["The cat", "the  CAT!", "", None, "123"])
    assert (p[0] == p[1]).all() and n[0] > 0 and not n[2:].any()
    a = langid.presence(["abcab"])[0][0]
    assert a.max() == 1 and a[: langid.BUCKETS].sum() <= 5  # _a ab bc ca b_


def test_margins_against_the_plain_kernel():
    d = {"en": "the cat and the dog sat on that mat with them", "fr": "le chat et le chien sont sur ce tapis avec eux", "de": "die Katze und der Hund sind auf der Matte mit ihnen"}
    rng = random.Random(1)
    sample = [(" ".join(rng.choices(t.split(), k=12)), lang) for lang, t in d.items() for _ in range(12)]
    rng.shuffle(sample)
    model = langid.fit(sample, landmarks=5, ridge=0.02)
    grams = lambda t: set(langid.gram_buckets(t).tolist())
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    langs = sorted(d)
    marks = [grams(t) for lang in langs for t in [t for t, y in sample if y == lang][:5]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6 * values.max()
    phi = lambda t: np.append(np.array([kernel(grams(t), b) for b in marks]) @ (vectors[:, keep] / np.sqrt(values[keep])), 1)
    x = np.array([phi(t) for t, _ in sample])
    reg = 0.02 * len(sample) / x.shape[1] * np.eye(x.shape[1])
    reg[-1, -1] = 1e-9
    weights = [np.linalg.solve(x.T @ x + reg, x.T @ np.array([1.0 if y == lang else -1.0 for _, y in sample])) for lang in langs]
    texts = ["the dog and le chat", "der Hund", *d.values()]
    want = np.array([[phi(t) @ w for w in weights] for t in texts])
    got, _ = model.margins(texts)
    assert np.allclose(got, want, atol=1e-3) and model.predict(texts)[0] == [langs[i] for i in want.argmax(1)]


def test_rejection(spark):
    rng = random.Random(2)
    words = {"en": "the cat and dog sat on that mat with them all day long".split(), "fr": "le chat et chien sont sur ce tapis avec eux tous les jours".split()}
    sample = [(" ".join(rng.choices(w, k=60)), lang) for lang, w in words.items() for _ in range(40)]
    model = langid.fit(sample)
    rows = [(1, " ".join(rng.choices(words["en"], k=60)), None, "s", 1), (2, "".join(rng.choices("qxzjkvwbp ", k=600)), "en", "s", 1), (7, "Съешь же ещё этих мягких французских булок " * 5, None, "s", 1), (3, "12 34 5x " * 40, "en", "s", 1), (4, "the mat", None, "s", 1), (5, " ".join(rng.choices(words["fr"], k=60)), "xx", "s", 1), (6, None, None, "s", 1)]
    kept = {r.doc_id: r.lang for r in langid.accepted(docs(spark, rows), model).collect()}
    assert kept == {1: "en", 4: "en", 5: "xx"}
    assert langid.accepted(empty(spark), model).count() == 0


def test_language_on_odd_tables(spark):
    model = langid.fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 3)
    out = langid.predict_languages(docs(spark), model).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 8)) and by[4].lang_pred in ("en", "fr")
    assert langid.op1_language_id(empty(spark)).count() == 0
    nothing = langid.op1_language_id(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    kept = langid.accepted(docs(spark, extra=False), model)
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 9, None} and kept.columns == docs(spark, extra=False).columns


# --- archives

PAGES = [(1, "http://a/\r\nX: y", "x" * 200), (2, None, "x" * 200), (3, "http://c", None), (4, "http://d", ""), (5, "u", "é" * 60), (6, "u", "é" * 60), (7, "u", "short"), (8, "u", "short"), (9, "u", LONG), (None, "u", "x" * 200)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("value", F.lit(2))
    out = {r.page_id: r for r in warc.op2_warc(pages).collect()}
    assert len(out) == len(PAGES)
    for i, _, h in PAGES:
        raw = (h or "").encode()
        assert out[i].payload_bytes == len(raw) and out[i].payload_digest == hashlib.sha256(raw).hexdigest()
    assert {i: r.refers_to for i, r in out.items() if r.record_type == "revisit"} == {2: 1, 6: 5}
    assert warc.op2_warc(pages.limit(0)).count() == 0
    twice = warc.op2_warc(pages.union(pages)).collect()
    assert len(twice) == 2 * len(PAGES) and sum(r.record_type == "revisit" for r in twice) == 4


def test_archive_with_dictionary_and_damage(spark):
    import zstandard

    d = zstandard.train_dictionary(2048, [f"<html><body>{random.Random(i).random()} some page {i}</body></html>".encode() * 5 for i in range(200)]).as_bytes()
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), write_checksum=True)
    record = warc.encode_record(7, "http://a", b"<html>hi</html>" * 9, None)
    frame, sep = c.compress(record), warc.SEPARATOR.encode()
    for lead in (warc.dictionary_frame(d), warc.dictionary_frame(zstandard.ZstdCompressor().compress(d))):
        data = lead + sep + frame + sep + c.compress(warc.encode_record(8, None, b"<html>hi</html>" * 9, 7))
        got = list(warc.read_archive(data))
        assert [r.headers["warc-type"] for r in got] == ["response", "revisit"] and got[0].payload == b"<html>hi</html>" * 9
    whole = zstandard.ZstdCompressor().compress
    for bad in (data[:-3], frame + warc.dictionary_frame(d), b"junkjunk", whole(record[:-1]), whole(record.replace(b"hi", b"ho", 1)), whole(record.replace(b"WARC/1.1", b"WARC/9")), whole(record.replace(b"WARC-Date", b"X-Date")), whole(record.replace(b"Content-Length: 1", b"Content-Length: 2", 1))):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))


def test_archives_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 8)
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"), F.lit(None).cast("long").alias("refers_to")).coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("part*"))) == 8  # seven records a file
    assert sorted(r.page_id for r in warc.read_archives(spark, f"{tmp_path}/w").collect()) == list(range(50))


# --- toxicity


def test_toxicity_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op3_toxicity(d, lab).join(lab, "doc_id").join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang = 'en'").collect()
    hit = sum(r.predicted and r.toxic for r in out)
    assert hit / sum(r.predicted for r in out) > 0.9 and hit / sum(r.toxic for r in out) > 0.85
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)


def test_logits_against_plain_convolution():
    rng = np.random.default_rng(4)
    words = [f"w{i}".encode() for i in range(40)]
    texts = [b" ".join(rng.choice(words, n)) for n in rng.integers(1, 30, 120)]
    y = np.array([int(b"w3 " in t or b"w7" in t) for t in texts])
    model = toxicity.train(texts, y, langid.fit([]), 0.3, epochs=2)
    cache = toxicity.WordRows(model.rows)
    for t in [*texts[:30], None, b"", b"nothing known here", b"w1", b"w1 zz w2"]:
        rows = cache.of(t).tolist() + [0] * 4  # any text is followed by unknown words
        pooled = []
        for w, tables, b in zip(toxicity.WIDTHS, model.tables, model.biases, strict=True):
            every = [sum(tables[j][rows[i + j]] for j in range(w)) + b for i in range(len(rows) - w + 1)]
            pooled += np.maximum(np.max(every, axis=0), 0).tolist()
        assert abs(model.logits([t], cache)[0] - (np.array(pooled) @ model.out + model.bias)) < 1e-4
    long = b"zz " * 50_000 + b"w3 w7 " + b"zz " * 50_000
    assert abs(model.logits([long], cache)[0] - model.logits([b"zz zz zz w3 w7 zz zz zz"], cache)[0]) < 1e-4


def test_toxicity_on_odd_tables(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=20) + ["vile"] * (i % 4 == 0)), "en", "s", 1) for i in range(400)]
    d = docs(spark, rows).unionByName(docs(spark, [(1000 + (r[0] or 0), *r[1:]) for r in ODD]))
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic long")
    out = {r.doc_id: r for r in toxicity.op3_toxicity(d, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i].predicted == (i % 4 == 0) for i in held]) > 0.95 and 0 <= out[1002].score <= 1
    assert {r.score for r in toxicity.op3_toxicity(d, lab.limit(0)).collect()} == {0.0}
    assert toxicity.op3_toxicity(empty(spark), lab).count() == 0


# --- secrets

PATTERN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)


def base_by_hand(t):
    found = [(m.start(), 0, m.end(), "assign") for m in PATTERN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_base_spans():
    rng = random.Random(4)
    bits = ["token", "PassWord", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "deadbeef01234567", "abc", "token=secret=", "é", "\U0001F600", "-", "K"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert secrets.joined(secrets.Scanner().base(t)) == base_by_hand(t)


def test_windows_against_counting():
    rng, s = random.Random(5), secrets.Scanner()
    for _ in range(300):
        run = "".join(rng.choice("abcdefghijklmnop"[: rng.randrange(2, 16)]) for _ in range(rng.randrange(5, 60)))
        width, least = rng.randrange(4, 12), rng.uniform(1, 3.2)
        entropy = lambda w: -sum(w.count(c) / len(w) * np.log2(w.count(c) / len(w)) for c in set(w))
        covered = {i for a in range(len(run) - width + 1) if entropy(run[a : a + width]) >= least - 1e-9 for i in range(a, a + width)}
        assert {i for a, b in s.windows(run, width, least) for i in range(a, b)} == covered


def test_added_spans_and_allow_list():
    s = secrets.Scanner()
    key = "Zx9Qw7Lm2Rt5Yp8Vb3Nk6Hj1Gd4"
    assert [x[2] for x in s.scan(f"use {key} now")[1]] and not s.scan("internationalisation-of-everything-else")[1] and not s.scan("12345678901234567890")[1] and not s.scan("xyxyxyxyxyxyxyxyxyxyxyxy")[1]
    base, extra = s.scan(f'token = "{key}"')
    assert len(base) == 1 and not extra  # nothing within a base span


def test_secrets_on_odd_tables(spark):
    out = secrets.op4_secret_scans(docs(spark)).collect()
    assert len(out) == len(ODD)
    for r in out:
        text = next(x[1] for x in ODD if x[0] == r.doc_id) or ""
        assert r.base_sha256 == hashlib.sha256(base_by_hand(text).encode()).hexdigest() == secrets.base_digest(text)
    assert secrets.op4_secret_scans(empty(spark)).count() == 0
    clean = {r.doc_id: r for r in secrets.redact(docs(spark, extra=False)).collect()}
    assert clean[9].text == "[SECRET]\" é\U0001F600" and clean[9].n_chars == len(clean[9].text) and clean[5].text == LONG and clean[1].text is None and clean[1].n_chars is None


def test_base64_key_is_covered_to_its_end():
    key = "q7RtZ2mXw9LpB4vKs8HdY3nC" + "/" + "Jf6GaT1oUeN5xQ0"
    assert len(key) == 40
    text = f"key {key} end"
    spans = secrets.Scanner().entropy(text)
    assert {i for s, e, _ in spans for i in range(s, e)} == set(range(4, 44))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert secrets.uncovered([(2, 20)], [(0, 3, ""), (5, 8, ""), (8, 12, "")]) == [(3, 5), (12, 20)]
    assert secrets.uncovered([(0, 4), (6, 9), (10, 30)], [(20, 21, ""), (2, 7, "")]) == [(0, 2), (7, 9), (10, 20), (21, 30)]


def test_parts_left_uncovered_by_hand():
    rng = random.Random(8)
    for _ in range(500):
        cut = sorted(rng.sample(range(40), 8))
        spans, places = [(cut[0], cut[1], ""), (cut[4], cut[5], "")], [(a, a + 3) for a in range(0, 40, 4)]
        covered = {i for s, e, _ in spans for i in range(s, e)}
        want = {i for s, e in places for i in range(s, e)} - covered
        assert {i for s, e in secrets.uncovered(places, spans) for i in range(s, e)} == want


def test_long_runs_take_linear_time():
    scanner, began = secrets.Scanner(), time.process_time()
    for text in ("abcdefghijklmnopqrstuvwxyz1", "a" * 1_000_000 + "1", "aB" * 500_000 + "1", "ab-" * 300_000 + "!1", "A" * 500_000 + "b1", "1-" * 300_000 + "x", "=" * 300_000 + "1", ("x" * 30 + "1 ") * 10_000):
        scanner.scan(text)
    assert time.process_time() - began < 30
    began = time.process_time()
    scanner.scan("q7RtZ2mXw9LpB4vKs8HdY3nC/Jf6GaT1oUeN5xQ0+aaaaaaaaaaaaaaaaaaaaaaaaa/" * 6_000)
    scanner.scan("0123456789abcdef0 Zx9Qw7Lm2Rt5Yp8Vb3Nk6Hj1Gd4 " * 6_000)
    assert time.process_time() - began < 30
    begun = time.process_time()
    assert secrets.Scanner().entropy("internationalizationofeverythingelse" * 5 + "1") == [] and time.process_time() - begun < 0.5


def test_base64_key_leaves_nothing_in_the_text(spark):
    text = "key q7RtZ2mXw9LpB4vKs8HdY3nC/Jf6GaT1oUeN5xQ0 end"
    (row,) = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == "key [SECRET] end"


# --- sharding


def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    t = sharding.fill_table(names, 1009)
    counts = [t.count(n) for n in names]
    assert max(counts) - min(counts) <= 1 and t == sharding.fill_table(names[::-1], 1009)
    less = sharding.fill_table(names[1:], 1009)
    assert sum(a != b for a, b in zip(t, less, strict=True)) < 1009 * 0.35
    heavy = sharding.fill_table(names, 1009, {"n0": 3})
    assert 2.5 < heavy.count("n0") / heavy.count("n1") < 3.5
    for bad in (([], 1009), (names, 1000), (names, 5)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_preference_order_by_hand():
    names, slots = ["a", "b", "c"], 31
    pref = {n: [(int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") + j * (int.from_bytes(hashlib.sha256(n.encode()).digest()[8:16], "big") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names}
    table, turn = {}, 0
    while len(table) < slots:
        n = names[turn % 3]
        table[next(s for s in pref[n] if s not in table)] = n
        turn += 1
    assert sharding.fill_table(names, slots) == [table[i] for i in range(slots)]


def test_sharding_on_odd_tables(spark):
    out = sharding.op5_sharding(docs(spark)).collect()
    assert len(out) == len(ODD) and len({r.shard for r in out if r.doc_id == 6}) == 1 and all(r.shard and r.shard_after_loss for r in out)
    assert all(r.moved == (r.shard != r.shard_after_loss) and (r.moved is False or r.shard is not None) for r in out)
    assert sharding.op5_sharding(empty(spark)).count() == 0
    placed = sharding.place(docs(spark), "doc_id", ["a", "b"])
    assert sorted(placed.columns) == sorted(docs(spark).columns)


# --- packing

VOCABULARY = __import__("public_tokenizers").path("word_bpe_49k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_ids_are_those_of_tokenizers():
    rng, t, w = random.Random(6), tokenizer(), packing.Words(VOCABULARY)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZéèñüößÀÉİẞσςΣ０１á \n\t\x1c '.,!<|>#123"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["don't I'LL <|endoftext|> x", "''s's", "", "   "]
    for x in texts:
        assert np.frombuffer(w.ids(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


def check_packed(rows, texts):
    t = tokenizer()
    ids = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for rs in seqs.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        size = sum(r.length for r in rs)
        assert size <= 4096 and size & (size - 1) == 0  # full or a power of two: no padding
    return ids


def test_packing_round_trip(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = packing.op6_packing(df).collect()
    ids = dict(zip(texts, check_packed(rows, texts.values()), strict=True))
    for i, want in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)


def test_packing_on_odd_tables(spark):
    rows = packing.op6_packing(docs(spark)).collect()
    check_packed(rows, [r[1] for r in ODD])
    assert [r.length for r in rows if r.doc_id == 1] == [1] and packing.op6_packing(empty(spark)).count() == 0


def test_bm25_by_hand():
    rng = np.random.default_rng(1)
    toks = [rng.integers(0, 30, rng.integers(5, 40)).astype("<u2") for _ in range(20)]
    df = np.zeros(1 << 16, np.int64)
    for t in toks:
        df[np.unique(t)] += 1
    idf, mean = np.log1p((20 - df + 0.5) / (df + 0.5)).astype(np.float32), np.mean([len(t) for t in toks])
    shard = packing.Shard(toks, idf, mean)
    weight = lambda d, w: idf[w] * (tf := (toks[d] == w).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[d]) / mean))
    top = np.unique(toks[0])
    free = np.ones(20, bool)
    free[[0, 3]] = False
    want = sorted((d for d in range(20) if free[d]), key=lambda d: (-sum(weight(d, w) for w in top), d))
    assert list(shard.neighbours(0, free))[:5] == want[:5]


def weights_of(toks):
    df = np.zeros(1 << 16, np.int64)
    for t in toks:
        df[np.unique(t)] += 1
    n, mean = len(toks), np.mean([len(t) for t in toks])
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    return idf, mean, lambda d, w: idf[w] * (tf := (toks[d] == w).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[d]) / mean))


def test_neighbours_by_all_terms_and_to_the_last():
    rng = np.random.default_rng(2)
    toks = [rng.integers(0, 90, rng.integers(60, 90)).astype("<u2") for _ in range(70)]
    idf, mean, weight = weights_of(toks)
    free = np.ones(70, bool)
    free[0] = False
    want = sorted(range(1, 70), key=lambda d: (-sum(weight(d, w) for w in np.unique(toks[0])), d))
    assert list(packing.Shard(toks, idf, mean).neighbours(0, free)) == want


def test_routes_by_hand():
    rng = np.random.default_rng(3)
    toks = [rng.integers(0, 60, n).astype("<u2") for n in [0, 1, 3, *rng.integers(20, 60, 90)]]
    idf, mean, weight = weights_of(toks[1:])
    usual = np.zeros(1 << 16, bool)
    usual[5:50] = True
    got = packing.routes(toks, idf, usual, mean)
    for t, r in zip(toks, got.tolist(), strict=True):
        own = lambda w, t=t: idf[w] * (tf := (t == w).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        want = sorted((w for w in np.unique(t) if usual[w]), key=lambda w: (-np.float32(own(w)), w))[:4]
        have = [(r >> 48 - 16 * k) & 0xFFFF for k in range(4)]
        assert [w for w in have if w != 0xFFFF] == want or np.allclose([own(w) for w in want], [own(w) for w in have[: len(want)]], rtol=1e-5)


def test_levels_and_many_short_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 9_000)
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", "a", " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(1, 400)))])) for i in range(400)]
    rows += [(1000, "the same again " * 5000), (1000, "the same again " * 5000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = packing.op6_packing(df).collect()
    check_packed(out, [t for _, t in rows])
    sizes = {}
    for r in out:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    short = [n for n in sizes.values() if n < 4096]
    assert len(short) == len(set(short)) and len(sizes) > 20  # one rest for the whole table, whatever the number of tasks


def test_related_documents_meet_from_far_files(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    rng = random.Random(4)
    topics = [["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)] for _ in range(2)]
    texts = [(i, " ".join(rng.choice(topics[i % 2]) for _ in range(300))) for i in range(160)]
    order = sorted(texts, key=lambda x: (x[0] // 2 % 4, x[0]))
    rows = packing.op6_packing(spark.createDataFrame(order, "doc_id long, text string").repartition(4, "doc_id")).collect()
    check_packed(rows, [x[1] for x in texts])
    parts, windows = {}, {}
    for r in spark.createDataFrame(order, "doc_id long, text string").repartition(4, "doc_id").select("doc_id", __import__("pyspark").sql.functions.spark_partition_id().alias("p")).collect():
        parts[r.doc_id] = r.p
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    full = [w for w in windows.values() if sum(r.length for r in w) == 4096]
    pure = sum(max(sum(r.length for r in w if r.doc_id % 2 == k) for k in (0, 1)) for w in full) / (4096 * len(full))
    assert pure > 0.8 and any(len({parts[r.doc_id] for r in w}) > 1 for w in full)


# --- nearest neighbours


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = df.collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], np.float64)
    got = {}
    for r in ann.op7_nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    shares = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        shares.append(len(set(best) & {v for v, _ in got[q].values()}) / 20)
        assert [got[q][i] for i in range(1, 21)] == sorted(got[q].values(), key=lambda p: (-p[1], p[0]))
        assert all(abs(sc - s[ids == v][0]) < 1e-9 for v, sc in got[q].values())
    assert np.mean(shares) >= 0.9


def test_neighbours_on_odd_tables(spark):
    rows = [(20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, None]), (6, []), (40, [2.0, 1.0]), (None, [1.0, 1.0]), *((100 + i, [1.0, 1.0]) for i in range(50))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("codes", F.lit(1))
    out = {}
    for r in ann.op7_nearest(df).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(out) == {20, 40, 100, 120, 140} and [v for _, v, _ in sorted(out[20])] == [40, *range(100, 119)]
    assert [v for _, v, _ in sorted(out[100])] == [40, *range(101, 120)]
    assert ann.op7_nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.op7_nearest(few).collect()] == [(20, 21)]


def test_recall_in_one_task_of_many_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100_000, 32)).astype(np.float32).astype(np.float64)
    q, ids = ann.fit(x[:4096]), np.arange(len(x))
    asked = ids[::2000]
    best = ann.Best(asked, x[asked], 20)
    tables = q.tables(x[asked])
    for at in range(0, len(x), ann.SCAN_ROWS):
        part = x[at : at + ann.SCAN_ROWS]
        best.scan(tables, ann.packed(q.encode(part, 1)), ids[at : at + ann.SCAN_ROWS], part, ann.RERANK)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(want, best.ids, strict=True)]) >= 0.9


def test_repeated_ids_are_one_row(spark):
    rows = [(20, [1.0, 0.0]), (20, [3.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [5.0, 0.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op7_nearest(df).orderBy("rank").collect()] == [(20, 1, 1, 2.0), (20, 2, 2, 0.5)]


# --- decontamination


def distance_within(item, text):
    """Least edits from item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_full_alignment():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(14, 30)))) for i in range(6)]
    index = decontaminate.Items(items)
    for n in range(60):
        item = list(items[n % 6][1])
        for _ in range(rng.randrange(0, 14)):
            p = rng.randrange(len(item))
            item[p : p + 1] = rng.choice([[], [rng.choice("abcde")], [item[p], rng.choice("abcde")]])
        text = " ".join(rng.choices(words, k=30)) + " " + "".join(item) + " " + " ".join(rng.choices(words, k=30))
        found = {r[0]: r for r in index.scan(text)}
        for k, t in enumerate(index.texts):
            d = distance_within("".join(map(chr, t)), "".join(map(chr, decontaminate.normalised(text)[0])))
            assert (k in found) == (d <= index.budget[k]) and (k not in found or found[k][3] == d)


def test_leaks_on_odd_tables(spark):
    items = spark.createDataFrame([(1, "same text here for all of us"), (1, "same text here for all of us"), (2, None), (3, "!!!"), (4, "ab")], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark), items).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(6, 1, 0), (6, 1, 0), (7, 1, 0)]
    assert decontaminate.find_leaks(empty(spark), items).count() == 0 and decontaminate.find_leaks(docs(spark), items.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in decontaminate.without_leaks(docs(spark), items.where("item_id = 1")).collect()) == sorted(str(r[0]) for r in ODD if r[0] not in (6, 7))


def test_short_items_are_whole_words(monkeypatch):
    index = decontaminate.Items([(1, "cat"), (2, "a"), (3, "Is a"), (4, "x x")])
    found = lambda t: [(r[0], t[r[1] : r[2]]) for r in index.scan(t)]
    assert found("education is about bananas") == []
    assert found("The cat, is  a CAT") == [(1, "cat"), (1, "CAT"), (2, "a"), (3, "is  a")]
    assert found("xx x x x xx") == [(4, "x x"), (4, "x x")]
    whole = index.scan("so cat " * 50)
    monkeypatch.setattr(decontaminate, "PIECE", 9)
    assert index.scan("so cat " * 50) == whole and len(whole) == 50


def test_leaks_in_pieces(monkeypatch):
    item = " ".join(f"word{i}" for i in range(20))
    index = decontaminate.Items([(1, item)])
    text = "x y " * 500 + item + " z" * 900
    whole = index.scan(text)
    for size in (100, 1000, 1990, 2050, 2101):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        assert index.scan(text) == whole == [(1, 2000, 2000 + len(item), 0, len(item))]


# --- n-gram Jaccard join


def components_by_hand(rows, k, num, den):
    sets, comp = {}, {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        comp[i] = i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_components_against_all_pairs(spark, k, num, den):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    for g in range(25):
        base = rng.choices(words, k=rng.randrange(1, 120)) + (passage if g % 3 == 0 else [])
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, k, num, den).collect()}
    assert got == components_by_hand(rows, k, num, den)


def test_word_hashes_part_words_as_split_does(monkeypatch):
    rng = random.Random(3)
    bits = [b" ", b"\t", b"\n\x0b", b"\x0c ", b"\r", b"a", b"B", b"b", b"Ab", b"aB", "é".encode(), "É".encode(), b"word", b"x" * 20, b"\xc2\xa0", b"\x1c", b"\x00"]
    texts = [b"".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)] + [b"", b" ", b"x" * 100, b" " * 100, b"y " * 90]
    for block in (jaccard.BLOCK, 16):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        of = {}
        for t in texts:
            words = t.lower().split()
            h = jaccard.word_hashes(t).tolist()
            assert len(h) == len(words)
            for w, x in zip(words, h, strict=True):
                assert of.setdefault(w, x) == x
        assert len(set(of.values())) == len(of) > 1000


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in (0, 1, 5, 40, 300, 900, 5000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 9 // 10], rng.integers(0, 1 << 62, len(s) // 10)))) for s in sets]
    r, c = np.triu_indices(len(sets))
    apart = jaccard.apart([jaccard.bitmap(s) for s in sets], r, c)
    for i, j, d in zip(r, c, apart, strict=True):
        assert d <= len(np.setxor1d(sets[i], sets[j])) and (i != j or d == 0)
    assert apart[(r == 6) & (c == 13)] > 0  # and is no empty bound


@pytest.mark.parametrize("split", [12, 1 << 18])
def test_hot_columns_are_split(spark, monkeypatch, split):
    monkeypatch.setattr(jaccard, "SPLIT", split)
    monkeypatch.setattr(jaccard, "PARTNERS", 4)
    monkeypatch.setattr(jaccard, "LARGE", 9)
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 37)
    rng = random.Random(9)
    base = [rng.choice(["w", "x", "y"]) + str(rng.randrange(300)) for _ in range(60)]
    rows = []
    for i in range(160):  # copies with up to five words changed, so that many are below the threshold, and some strangers
        words = base[:]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(words) if i % 8 else " ".join(rng.choices(base, k=50))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert (len(jaccard.set_rows(df, 4, 85, 100)[1]) > 20) == (split == 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, 4, 85, 100).collect()}
    want = components_by_hand(rows, 4, 85, 100)
    assert got == want and len({c for _, c in want.values()}) > 10


def test_components_on_odd_tables(spark):
    out = jaccard.op9_ngram_jaccard(docs(spark)).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[7].component_id == 6 and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1 and by[4].n_shingles == 1 and by[None].component_id is None
    assert jaccard.op9_ngram_jaccard(empty(spark)).count() == 0
    kept = jaccard.keep_first(docs(spark), jaccard.near_components(docs(spark), 5, 80, 100)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, (1, 2, 3, 4, 5, 6, 8, 9, None)))


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)]
    want = {i: i for e in edges for i in e}
    for a, b in edges:
        low, high = sorted((want[a], want[b]))
        want = {i: low if c == high else c for i, c in want.items()}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- licenses


def test_licenses_on_odd_tables(spark):
    rows = [*ODD, (20, "Under the MIT  License, mit-license. CC BY", "en", "s", 1), (21, "permission is hereby granted free of charge to any person obtaining a copy of this software and the documentation files", "en", "s", 1)]
    out = {r.doc_id: r for r in licenses.op10_license_scans(docs(spark, rows)).collect()}
    assert (out[20].n_words, out[20].n_base, out[20].first_word, out[20].last_word, out[20].base_labels, out[20].score) == (8, 3, 2, 6, "cc-by,mit", 1.0)
    assert out[21].base_labels == "" and out[21].labels == "mit" and 0.8 <= out[21].score < 1
    assert (out[1].n_words, out[1].first_word, out[1].labels, out[1].score) == (0, None, "", 0.0)
    assert licenses.op10_license_scans(empty(spark)).count() == 0


def test_filters_lose_nothing():
    rng = random.Random(10)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + [f"x{i}" for i in range(30)]
    index = licenses.TemplateIndex(frequency={w: rng.randrange(100) for w in vocabulary})
    for _ in range(400):
        _, t = rng.choice(licenses.TEMPLATES)
        words = [w for w in t.split() if rng.random() < 0.9] + rng.choices(vocabulary, k=rng.randrange(80))
        at = rng.randrange(len(words) + 1)
        words = words[at:] + words[:at]
        want = {}
        for b in range(0, max(1, len(words)), 32):
            block = set(words[b : b + 64])
            for label, text in licenses.TEMPLATES:
                c = len(block & set(text.split())) / len(set(text.split()))
                if c >= 0.8 - 1e-9:
                    want[label] = max(want.get(label, 0), c)
        raw = [w.encode() for w in words]
        assert index.matches(raw, b" " + b" ".join(raw) + b" ") == want


def test_every_language_is_drawn_and_none_drops_nothing(spark):
    from lexmill.llm.common import labelled_sample

    rows = [(i, f"l{i % 70}", "abc " * 3) for i in range(140)] + [(200, "long", "def " * 6000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = labelled_sample(df, "lang", 4)
    assert {y for _, y in got} == {f"l{i}" for i in range(70)} | {"long"} and max(len(t) for t, _ in got) == 20_000
    none = spark.createDataFrame([(1, None, "words"), (2, None, "123"), (3, None, None)], "doc_id long, lang string, text string")
    assert [r.doc_id for r in langid.accepted(none, langid.fit_documents(none)).collect()] == [1]


def test_many_phrases_take_linear_time():
    words = [b"mit", b"license", b"cc", b"by"] * 100_000
    began = time.process_time()
    places = licenses.phrase_places(words, b" " + b" ".join(words) + b" ")
    assert time.process_time() - began < 5 and len(places) == 200_000
    assert places[:4] == [(0, "mit"), (2, "cc-by"), (4, "mit"), (6, "cc-by")] and places[-1] == (399_998, "cc-by")
