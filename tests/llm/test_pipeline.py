"""The pipeline's stages, each on all that the one before kept, against plain computations."""

import math
import re

import corpus_pipeline as pipeline
from conftest import SF
from pyspark.sql import functions as F
from test_llm import LONG, ODD, base_by_hand, check_packed, components_by_hand, distance_within, docs

from lexmill.llm import secrets
from lexmill.llm.common import stored, table


def level(text):
    """Normalised text: lower case, runs of what is no letter or digit one space."""
    return re.sub(" +", " ", "".join(c.lower() if c.isalnum() else " " for c in text))


def holds(item, text, q=10):
    """Whether the text holds the item within its edit budget, by full alignment of all pairs that share a q-gram."""
    item, text = level(item).rstrip(" "), level(text)
    if len(item) < q:
        return bool(item) and f" {item.strip()} " in f" {text.strip()} "
    budget = max(0, min(int(0.08 * len(item)), (len(item) - q) // q))
    if not any(item[i : i + q] in text for i in range(len(item) - q + 1)):
        return False
    return item in text or distance_within(item, text) <= budget


def redacted(text):
    """The text with each run of characters that a base span or a window of high entropy covers replaced."""
    covered = set()
    for span in filter(None, base_by_hand(text).split(",")):
        _, s, e = span.split(":")
        covered.update(range(int(s), int(e)))
    allowed = lambda s: any(a.fullmatch(s) for a in secrets.ALLOW)
    for m in secrets.CANDIDATE.finditer(text):
        for _, runs, width, least in secrets.CLASSES if not allowed(m[0]) else ():
            for r in runs.finditer(m[0]):
                for a in range(len(r[0]) - width + 1) if not allowed(r[0]) else ():
                    w = r[0][a : a + width]
                    if -sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w)) >= least - 1e-9:
                        at = m.start() + r.start() + a
                        covered.update(range(at, at + width))
    marks = sorted(covered)
    out, at = [], 0
    for k, i in enumerate(marks):
        if not k or marks[k - 1] != i - 1:
            out += [text[at:i], "[SECRET]"]
        at = i + 1
    return "".join([*out, text[at:]])


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    names = [n for n, _ in pipeline.STAGES]
    before, after = kept[names[0]]
    assert set(before) - set(after) <= {i for i, t in before.items() if len(t) < 40 or not re.search(r"[^\W\d_]", t)}
    before, after = kept[names[1]]
    groups = components_by_hand(before.items(), 5, 80, 100)
    assert set(after) == {i for i, (_, c) in groups.items() if c == i}
    before, after = kept[names[2]]
    items = [r.text for r in table(spark, SF, "benchmark").collect() if r.text]
    dropped = {i for i, t in before.items() if any(holds(item, t) for item in items)}
    assert dropped and set(before) - set(after) == dropped
    before, after = kept[names[3]]
    want = {i: redacted(t) for i, t in before.items()}
    assert after == want and any(want[i] != before[i] for i in want)
    check_packed(pipeline.STAGES[-1][1](spark, docs, SF).collect(), after.values())


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_odd_tables(spark, tmp_path):
    """Null, empty and very long texts, repeated rows, null ids, clashing columns, empty tables: each stage has a defined result."""
    extra = docs(spark).unionByName(docs(spark, [(20, "a passage of the benchmark that is to be found in this text", "en", "s", 1), (21, None, "fr", None, None)]))
    bench = spark.createDataFrame([(1, "passage of the benchmark that is to be found"), (2, None), (3, ""), (None, "nothing like it in any text at all")], "item_id long, text string")
    for name, given, items in (("full", extra, bench), ("empty", extra.limit(0), bench), ("no-items", extra, bench.limit(0))):
        sf = str(tmp_path / name)
        given.write.parquet(f"{sf}/documents.parquet")
        items.write.parquet(f"{sf}/benchmark.parquet")
        now = table(spark, sf, "documents")
        for _, stage in pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, sf), "test-stage")
            assert sorted(now.columns) == sorted(given.columns)
        left = sorted((str(r.doc_id), r.text) for r in now.select("doc_id", "text").collect())
        if name == "empty":
            assert not left
        else:
            texts = dict(left)
            assert texts["5"] == LONG and "None" in texts and "7" not in texts and "1" not in texts and len(left) == len(texts)
            assert ("20" in texts) == (name == "no-items") and texts["9"] == '[SECRET]" é\U0001F600'
        packed = pipeline.run(spark, sf).collect()
        check_packed(packed, [t for _, t in left])
        assert {str(r.doc_id) for r in packed} == {i for i, _ in left}


def test_lang_is_filled_in(spark):
    rows = [(i, t * 20, lang, "s", 1) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("le chat et le chien ", "fr")] * 10 + [("the dog and the cat ", None)])]
    out = {r.doc_id: r.lang for r in pipeline.language(spark, docs(spark, rows, extra=False), SF).collect()}
    assert out[20] == "en" and len(out) == 21
    assert docs(spark, ODD).where(F.col("lang").isNull()).count() > 0
