"""Quality rules, ball k-means and collocations against brute force, on awkward tables and with hot keys."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ballkmeans, collocations, quality

SPACE = "[ \t\n\x0b\x0c\r]"
TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e a b c d e", "x " * 30, "a\x0bb\x0cc\rd\te f", "a|b #c $$ %%\n\na|b #c $$ %%\n \n", "é ü ñ" * 9,
    "the same line\nthe same line\nanother one here and there\nthe same line", " ".join(f"w{i}" for i in range(400)), "p q r s t " * 3 + " ".join(f"v{i}" for i in range(90)) + " p q r s t",
    "alpha beta gamma delta " * 40_000,
]


def frame(spark, rows, extra=True):
    """rows of (doc_id, text, lang, source), with columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("n_words", "value", "h", "_w", "rank", "cluster", "_group")}) if extra else df


def base_by_hand(text):
    words = [w for w in re.split(SPACE + "+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE.replace("[", "[^"), x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts_by_hand(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("abc", k=rng.randrange(60))) for _ in range(60)] + ["".join(rng.choices("ab |#\n\t", k=80)) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t", None])) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.op13_quality_rules(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        n, chars, symbols, lines, repeats = base_by_hand(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), (i, t)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.kept and r.base_failed)


def test_quality_of_no_rows_repeated_rows_and_null_ids(spark):
    assert quality.op13_quality_rules(frame(spark, [])).count() == 0
    t = " ".join(f"word{i}" for i in range(50))
    out = quality.op13_quality_rules(frame(spark, [(1, t, "en", "s"), (1, t, "en", "s"), (None, t, None, None)])).collect()
    assert sorted((str(r.doc_id), r.kept, r.reasons) for r in out) == [("1", True, ""), ("1", True, ""), ("None", True, "")]


def test_thresholds_follow_their_source(spark):
    """One source writes with symbols: its texts stay, and the same texts go where others do not; small groups take their language's fences, a hot source its own."""
    rng = random.Random(5)
    plain = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(60))
    marked = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) + "#" * rng.randrange(1, 3) for _ in range(60))
    rows = [(i, plain(), "en", "news") for i in range(900)] + [(1000 + i, marked(), "en", "code") for i in range(300)] + [(2000, marked(), "en", "news"), (2001, plain(), "en", "rare"), (2002, marked(), "en", "rare"), (2003, plain(), "xx", "rare"), (2004, plain(), "en", "code")]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(900)) and all(got[1000 + i].kept for i in range(300))
    assert not got[2000].kept and got[2000].reasons == "symbols_high" and got[2001].kept and got[2003].kept
    assert got[2002].kept  # the language's sketch holds both kinds
    again = {r.doc_id: r for r in quality.judge(frame(spark, rows).repartition(13)).collect()}
    assert again == got


def test_sketches_merge_and_bound_the_error(spark):
    rng = random.Random(1)
    values = [rng.randrange(1 << rng.randrange(1, 40)) for _ in range(500)] + [0]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.sketch_value(F.col("v")).alias("s")).collect()]
    assert all(s <= v < s + max(1, s / 31) for v, s in zip(values, got, strict=True))


def clusters_by_hand(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        named = [nearest(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), n in zip(kept, named, strict=True) if n == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in out:
        inertia[c] += d
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cluster", "v", "distance", "label")})


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_balls_against_plain_rounds(spark, spread):
    rng = random.Random(int(spread * 100))
    middle = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, spread) for x in middle[i % 9]]) for i in range(300)] + [(7, middle[0]), (7, middle[0]), (None, middle[1]), (900, None), (901, [1.0] * 5), (902, [float("nan")] * 6), (903, [None] * 6), (904, [float("inf")] * 6)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # a hot vector
    got = found(ballkmeans.cluster(vectors(spark, rows), k=12, rounds=4, dim=6, scale=64, seed=3))
    assert got == clusters_by_hand(rows, 12, 4, 6, 64, 3)


def test_ties_go_to_the_smaller_number_and_few_vectors_to_few_clusters(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 4, 3, 3])]
    for k in (2, 3, 50):
        assert found(ballkmeans.cluster(vectors(spark, rows), k=k, rounds=3, dim=2, scale=1)) == clusters_by_hand(rows, k, 3, 2, 1, 2)
    assert ballkmeans.op12_ball_kmeans(vectors(spark, [])).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        ballkmeans.cluster(vectors(spark, [(1, [1e30, 0.0])]), dim=2).collect()


def test_balls_compare_less_than_all_pairs_and_lose_nothing():
    rng = np.random.default_rng(2)
    middle = rng.integers(-2000, 2000, (20, 8))
    x = middle[rng.integers(0, 20, 4000)] + rng.integers(-60, 60, (4000, 8))
    held, d = ballkmeans.nearest_plain(x, middle)
    moved = middle + rng.integers(-30, 30, middle.shape)
    radius = [int(d[held == i].max() ** 0.5) + 2 + int(((middle[i] - moved[i]) ** 2).sum() ** 0.5) + 1 for i in range(20)]
    name, far, seen = ballkmeans.Balls.of(moved, radius).assign(x, held)
    plain, least = ballkmeans.nearest_plain(x, moved)
    assert (name == plain).all() and (far == least).all() and seen < 0.3 * len(x) * 20


def test_wide_components_are_exact():
    x = np.array([[ballkmeans.MOST - 1, -ballkmeans.MOST + 1] * 32], np.int64)
    assert ballkmeans.squared(x, -x)[0, 0] == 64 * (2 * (ballkmeans.MOST - 1)) ** 2


def collocations_by_hand(rows, least, top, sizes=4, cover=80):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, sizes + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, g), a in cands.items():
        score, _, l, r = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        inside = lambda b: any(b[i : i + len(g)] == g for i in range(len(b) - len(g) + 1))
        if not any(y == lang and len(b) > len(g) and inside(b) and 100 * c >= cover * a for (y, b), c in cands.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, i, g.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, g, l, r) in enumerate(sorted(v)[:top], 1))


def phrases(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def chatter(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "ON", "é t", "mat", "a", "ñandú", "of", "dog"]
    mark = lambda: rng.choices([" ", "  ", "\t", " \t ", ". ", ", ", "\n", "!?", "\x0b", "\r\n"], [30, 3, 3, 2, 4, 3, 2, 1, 1, 1])[0]
    return [(i if i % 7 else None, "".join(rng.choice(words) + mark() for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"]), "s") for i in range(n)] + [(1, None, "en", "s"), (2, "", "en", "s"), (3, "...", "zz", "s"), (4, "of of of of of of of of", "fr", "s")] * 2


@pytest.mark.parametrize(("seed", "bits"), [(1, 16), (2, 12), (3, None)])
def test_phrases_by_hand(spark, seed, bits):
    """Also with few buckets, where bitmaps let much through."""
    rows = chatter(seed)
    got = phrases(collocations.collocations(frame(spark, rows).repartition(5), least=4, top=40, bits=bits))
    assert got == collocations_by_hand(rows, 4, 40) and len(got) > 60


def test_long_texts_are_cut_at_pieces_alone(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 64)  # also for the tasks, which get the function with its globals
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc.", "dd", "E,"], [5, 5, 1, 5, 1], k=200)), "en", "s") for i in range(6)] + [(9, "aa bb " * 300, "en", "s"), (10, ". ." * 200, "en", "s")]
    raw = "".join(t for _, t, _, _ in rows).encode()
    off = np.cumsum([0] + [len(t) for _, t, _, _ in rows])
    cuts = list(collocations.slices(np.frombuffer(raw, np.uint8), off, 64))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert all(e in set(off.tolist()) or raw[e - 1 : e] in b".,;:!?\n\x0b\x0c\r" for _, e in cuts)
    assert phrases(collocations.collocations(frame(spark, rows), least=5, top=30, bits=14)) == collocations_by_hand(rows, 5, 30)


def test_no_phrases_in_empty_tables(spark):
    assert collocations.op11_collocations(frame(spark, [])).count() == 0
    assert collocations.op11_collocations(frame(spark, [(1, None, None, None), (2, "few words", "en", "s")])).count() == 0


def test_products_beyond_64_bits(spark):
    """Scores as the query computes them, for counts as large as a web of text has."""
    a, l, r = 9 * 10**15, 9 * 10**15 + 7, 10**16
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(collocations.score_of()).first()[0] == 2_000_000 * a // (l + r)


def test_buckets_add_up_and_saturate(spark):
    counts = np.zeros(1 << 13, np.uint8)
    counts[[3, 5000]] = 20, 29
    many = np.full(1 << 13, 9, np.uint8)
    rows = [r for c in (counts, counts, many) for r in collocations.chunk_rows(c)]
    got = np.unpackbits(collocations.bitmap_of(spark.createDataFrame(rows, "chunk long, payload binary"), 13, 30), bitorder="little")
    assert np.flatnonzero(got).tolist() == [3, 5000]
