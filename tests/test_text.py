"""Hand-checked cases of the text functions and checks."""

import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexmill.functions import checks, text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "wanted"),
    [
        (X.tokens, "Él qj'üs, öso a", ["él", "qj'üs", "so"]),
        (X.collapse, "  a  b\n c ", "a b c"),
        (X.null_if_blank, "   ", None),
        (X.phonetic, "Tsjipj qj'üs", "chip qjus"),
        (X.gloss_terms, "the house; to run (fast)", ["house", "to run", "run"]),
        (X.gloss_terms, 'obsolete form of "Colour"', ["colour"]),
        (X.keywords, "I sharpen", ["sharpen", "i sharpen"]),
        (X.keywords, "the big house", ["house"]),
        (X.keywords, "the house", ["the house"]),
        (X.keywords, "cut: I cut wood", ["cut"]),
        (X.comma_terms, "a, b ,,c", ["a", "b", "c"]),
        (X.sentences, 'He said. "Go!" Now', ["He said", "Go", "Now"]),
        (lambda c: X.carried_sentences(c), "Si. Go now friend", ["Si.", "Go now friend"]),
        (lambda c: X.carried_sentences(c), "Come here now. Go", ["Come here now. Go"]),
        (X.latin, "саsа ‘x’…", "casa 'x'..."),
        (X.without_accents, "ñandú", "nandu"),
        (X.unescape, "a &amp;lt; &quot;b&quot;", 'a &lt; "b"'),
        (X.unescape_any, "&eacute;&#169;", "é©"),
        (X.nfc, unicodedata.normalize("NFD", "é"), "é"),
        (X.clean_headword, " 12.  ab   c", "ab c"),
        (X.pos_name, "verbo transitivo", "verb"),
        (X.pos_name, "", "other"),
        (X.pos_name, "ady.", "adjective"),
        (X.file_stem, "a b.c.wav", "a_b_c"),
        (lambda c: X.ngrams(F.split(c, " "), 2), "a1 b1 c1", ["a1 b1", "b1 c1"]),
        (lambda c: X.ngrams(F.split(c, " "), 2), "a1", []),
        (lambda c: X.headword_entry(c)["definition"], "tsji (s: x) the dog", "the dog"),
        (lambda c: X.headword_entry(c)["pos"], "tsji (s: x) the dog", "s"),
        (lambda c: X.reverse_entry(c)["headword"], "dog = tsji", "tsji"),
        (lambda c: X.source_tag(c)["verse"], "bible_align:MAT01:3", 3),
        (checks.has_marked_letters, "qj'us", True),
        (checks.garbage_english, "a b", True),
        (checks.garbage_english, "house", False),
        (checks.garbage_headword, "12 .", True),
        (checks.garbage_gloss, "x", False),
        (checks.valid_headword, "el la los las casa", False),
        (checks.valid_headword, "tsji", True),
        (lambda c: checks.valid_word(c, F.lit("perro")), "(m) tsji", False),
        (lambda c: checks.valid_word(c, F.lit("perro")), "tsji", True),
        (lambda c: checks.valid_entry(c, F.lit("perro"), F.lit("verbo")), "tsji", True),
        (lambda c: checks.valid_entry(c, F.lit("perro"), F.lit("x")), "tsji", False),
        (lambda c: checks.valid_entry(c, F.lit("perro"), F.lit("")), "nosotros tsji", False),
        (lambda c: checks.valid_sentence(c, F.lit("el perro")), "tsji pü", True),
        (lambda c: checks.verb_form(c), "cantando", True),
        (lambda c: checks.verb_form(c), "ando", False),
        (lambda c: X.tagged_examples(c, {"arrow": r"\w+ -> \w+"}), "a -> b", [("arrow", "a -> b")]),
    ],
)
def test_cases(spark, f, value, wanted):
    got = one(spark, value, f)
    assert ([tuple(x) if isinstance(x, tuple) else x for x in got] if isinstance(got, list) else got) == wanted


def test_null_text_is_safe(spark):
    for f in (X.tokens, X.phonetic, X.gloss_terms, X.keywords, X.sentences, X.latin, X.collapse):
        assert not one(spark, None, f)
    for f in (checks.valid_headword, checks.has_marked_letters):
        assert one(spark, None, f) is False


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence(spark):
    import random

    rng = random.Random(1)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(8))], [rng.choice("abc") for _ in range(rng.randrange(8))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", X.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) <= min(len(r.a), len(r.b)) for r in got)


def test_similarity_and_dice(spark):
    r = spark.createDataFrame([("qjuisin", "qjuisim", 3.0, 4.0, 5.0)], "a string, b string, c double, x double, y double")
    d = X.dice(F.col("c"), F.col("x"), F.col("y"))
    got = r.select(X.similarity("a", "b").alias("s"), d["score"].alias("score"), d["dice"].alias("dice")).first()
    assert got.s == SequenceMatcher(None, "qjuisin", "qjuisim").ratio() and round(got.score, 4) == 0.72 and round(got.dice, 4) == 0.6667


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 50), st.integers(0, 50), st.integers(0, 50))
def test_dice_bounds(c, a, b):
    assert 0 < 2 * c / ((a + c) + (b + c)) <= 1


def test_categories(spark):
    got = spark.createDataFrame([(["red", "dog"],), (["stone"],)], "w array<string>").select(X.semantic_category(F.col("w"), {"animals": ["dog"], "colors": ["red"]}).alias("c")).collect()
    assert [r.c for r in got] == ["animals", "other"]
    cases = [("animals", "noun", 2, 1), ("animals", "noun", 3, 2), ("other", "verb", 1, 2), ("other", "noun", 4, 3)]
    out = spark.createDataFrame(cases, "c string, p string, n int, w int").select((X.difficulty(F.col("c"), F.col("p"), F.col("n")) == F.col("w")).alias("ok")).collect()
    assert all(r.ok for r in out)


def test_carried_sentences_by_hand(spark):
    import random
    import re

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["one", "two three", "four five six.", "seven!", "eight nine?", "ten"]) for _ in range(rng.randrange(8))) for _ in range(60)]

    def by_hand(t):
        done, carry = [], ""
        for s in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", t))):
            both = f"{carry} {s}".strip()
            if len(both.split()) < 3 and both[-1] not in ".!?":
                carry = both
            else:
                done.append(both)
                carry = ""
        if carry and done:
            done[-1] += " " + carry
        elif carry:
            done = [carry]
        return done

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", X.carried_sentences(df.t).alias("s")).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}
