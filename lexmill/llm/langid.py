"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 2, 3, 4) that both hold, presence only,
over the geometric mean of their own numbers: the normalised blended-spectrum presence kernel. N-grams are
hashed to BUCKETS places for each n. Landmark texts give a Nystroem map k(x, L) K_LL^(-1/2); on it one ridge
regression per language is solved in closed form (targets 1 and -1).

A text's margins are (P B) A / sqrt(|P|) + bias, with P its presence row, B the landmarks' normalised
presence columns and A the map times the weights. Matrix products associate, so B A is multiplied once,
and documents are scored in batches by one product P (B A).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import crc_mod, labelled_sample, small_batches

ORDERS = (2, 3, 4)
BUCKETS = 1 << 14
UND = "und"
#: Parameters of the fit: documents per language, landmarks per language, ridge.
PER_LANG, LANDMARKS, RIDGE = 400, 48, 1e-2
#: Landmarks of all languages together at most (each language has one at least), and how many have presence rows at once.
MOST_MARKS, MARK_BLOCK = 1024, 64
#: Rejection: least share of letters among visible characters; letters from which on a text is long, and the least share of
#: a language's landmarks that hold an n-gram of a long text, on average over its n-grams and for the language that has most.
#: With fewer than KNOWN n-grams in all landmarks, too little is known of the languages for that.
LETTERS, LONG, TYPICAL, KNOWN = 0.2, 100, 0.12, 2000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_buckets(text: str) -> np.ndarray | None:
    """Places of the n-grams of the whole text, letters in lower case, all else one kind of gap; None without a letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    if not is_letter.any():
        return None
    cp = np.concatenate(([0], np.where(is_letter, cp, 0), [0])).astype(np.uint32)
    cp = cp[np.concatenate(([True], (cp[1:] | cp[:-1]) != 0))]  # of neighbouring gaps one stays
    h, out = cp * np.uint32(0x9E3779B1), []
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append((mixed >> np.uint32(18)).astype(np.int64) + ORDERS.index(n) * BUCKETS)
    return np.concatenate(out)


def letter_counts(text: str | None) -> tuple[int, int]:
    """Letters and visible characters of the whole text."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(letters()[cp].sum()), int((cp > 32).sum())


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A presence row per text, and the numbers of n-grams (0: no letter)."""
    p = np.zeros((len(texts), len(ORDERS) * BUCKETS), np.float32)
    for row, t in zip(p, texts, strict=True):
        if t and (b := gram_buckets(t)) is not None:
            row[b] = 1
    return p, p.sum(1)


@dataclass
class LangModel:
    langs: list[str]
    folded: np.ndarray  # B A
    bias: np.ndarray
    usual: np.ndarray  # by language, the share of its landmarks that hold each n-gram
    typical: float = 0.0  # least share by which a long text is accepted

    def margins(self, texts: list[str | None], block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Each regression's margin for each text, and the texts' numbers of n-grams (0: no letter)."""
        return self.measured(texts, False, block)[:2]

    def measured(self, texts: list[str | None], typical: bool = True, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """margins, and for each text and language the mean share of landmarks that hold its n-grams, by the same product."""
        n = len(self.langs)
        margins, sizes, shares = np.zeros((len(texts), n)), np.zeros(len(texts)), np.zeros((len(texts), n))
        columns = np.hstack((self.folded, self.usual)) if typical else self.folded
        for i in range(0, len(texts), block):
            p, size = presence(texts[i : i + block])
            got = p @ columns
            margins[i : i + block] = got[:, :n] / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
            if typical:
                shares[i : i + block] = got[:, n:] / np.maximum(size, 1)[:, None]
            sizes[i : i + block] = size
        return margins, sizes, shares

    def chosen(self, margins: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UND] * len(sizes), np.zeros(len(sizes))
        e = np.exp(4.0 * (margins - margins.max(1, keepdims=True)))
        best = margins.argmax(1)
        got = e[np.arange(len(sizes)), best] / e.sum(1)
        return [self.langs[b] if n else UND for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, got, 0.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.chosen(*self.margins(texts))


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LangModel:
    """Fit on (text, lang) pairs. No pairs: a model that says und; one language: always that one."""
    langs = sorted({y for _, y in sample})
    if not langs:
        none = np.zeros((len(ORDERS) * BUCKETS, 0), np.float32)
        return LangModel([], none, np.zeros(0), none)
    landmarks = max(1, min(landmarks, MOST_MARKS // len(langs)))
    marks, owner = zip(*((t, k) for k, lang in enumerate(langs) for t in [t for t, y in sample if y == lang][:landmarks]), strict=True)
    found = [gram_buckets(t) if t else None for t in marks]  # an n-gram a text holds has its bucket; texts, not rows of all buckets, are kept
    size = np.array([0 if f is None else len(np.unique(f)) for f in found], np.float64)
    norm = np.sqrt(np.maximum(size, 1))
    starts = range(0, len(marks), MARK_BLOCK)

    def block(i: int) -> np.ndarray:
        """Presence rows of a block of landmarks, by their norms."""
        part = found[i : i + MARK_BLOCK]
        p = np.zeros((len(part), len(ORDERS) * BUCKETS), np.float32)
        for row, f in zip(p, part, strict=True):
            if f is not None:
                row[f] = 1
        return p / norm[i : i + MARK_BLOCK, None].astype(np.float32)

    kernel = np.zeros((len(marks), len(marks)))
    usual = np.zeros((len(ORDERS) * BUCKETS, len(langs)), np.float32)
    share = np.zeros((len(marks), len(langs)), np.float32)
    share[np.arange(len(marks)), list(owner)] = 1
    share /= share.sum(0)
    for i in starts:
        one = block(i)
        usual += (one * norm[i : i + MARK_BLOCK, None].astype(np.float32)).T @ share[i : i + MARK_BLOCK]
        for j in range(i, len(marks), MARK_BLOCK):
            kernel[i : i + MARK_BLOCK, j : j + MARK_BLOCK] = one @ (one if i == j else block(j)).T
            kernel[j : j + MARK_BLOCK, i : i + MARK_BLOCK] = kernel[i : i + MARK_BLOCK, j : j + MARK_BLOCK].T
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values.max(initial=1e-12)
    to_map = vectors[:, keep] / np.sqrt(values[keep])
    raw = np.zeros((len(sample), len(marks)), np.float32)
    for k in starts:
        one = block(k).T
        for i in range(0, len(sample), 64):
            q, n = presence([t for t, _ in sample[i : i + 64]])
            raw[i : i + 64, k : k + MARK_BLOCK] = (q @ one) / np.sqrt(np.maximum(n, 1))[:, None]
    feats = [raw @ to_map]
    phi = np.hstack([np.vstack(feats), np.ones((len(sample), 1))])
    y = np.where(np.array([[lang == got for lang in langs] for _, got in sample]), 1.0, -1.0)
    reg = ridge * len(sample) / max(1, phi.shape[1]) * np.eye(phi.shape[1])
    reg[-1, -1] = 1e-9
    weights = np.linalg.solve(phi.T @ phi + reg, phi.T @ y)
    fold = (to_map @ weights[:-1]).astype(np.float32)
    folded = sum(block(i).T @ fold[i : i + MARK_BLOCK] for i in starts)
    return LangModel(langs, folded, weights[-1], usual, TYPICAL if size.sum() >= KNOWN else 0.0)


def fit_documents(docs: DataFrame, per_lang: int = PER_LANG, *, lang: str = "lang") -> LangModel:
    """Fit on at most per_lang documents of each language (a documented bound; see labelled_sample)."""
    return fit(labelled_sample(docs, lang, per_lang))


def predict_languages(docs: DataFrame, model: LangModel, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, lang_pred, score for every row; the text is the only input of a prediction.

    Null texts and texts without a letter: und, 0.0. Repeated rows give repeated rows; an empty table an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [key, *keep]
    rows = docs.select(*names, F.col(text).alias("_text"))
    shared = spark.sparkContext.broadcast(model)  # of a size fixed by BUCKETS and max_labels

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    return rows.mapInArrow(score, ", ".join([*kinds, "lang_pred string", "score double"]))


def accepted(docs: DataFrame, model: LangModel, least: float = 0.3, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that are rejected; where a kept row's lang is null, it becomes the predicted language.

    Rejected are null texts and texts without a letter (und); texts of which less than LETTERS is letters; long texts whose
    n-grams are hardly found in the landmarks of any language (TYPICAL), such as random letters and scripts that were not
    learned, if the landmarks hold enough to tell (KNOWN); and those that score below least. If no language could be learned, the first two rules hold. Other columns stay
    as they are; an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, model = b.column(text).to_pylist(), shared.value
            margins, sizes, shares = model.measured(texts)
            langs, scores = model.chosen(margins, sizes)
            counts = np.array([letter_counts(t) for t in texts], np.int64).reshape(-1, 2)
            ok = (sizes > 0) & (counts[:, 0] >= LETTERS * counts[:, 1])
            if model.langs:
                ok &= (scores >= least) & ((counts[:, 0] < LONG) | (shares.max(1) >= model.typical))
                if lang in b.schema.names:
                    at = b.schema.get_field_index(lang)
                    known = b.column(at)
                    filled = [v if v is not None else n for v, n in zip(known.to_pylist(), langs, strict=True)]
                    b = b.set_column(at, b.schema.field(at), pa.array(filled, known.type))
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_language_id(docs: DataFrame) -> DataFrame:
    """Every document's language, learned from the documents whose crc32 remainder by 3 is not 1. Awkward rows as in predict_languages."""
    model = fit_documents(docs.where(crc_mod("doc_id", 3) != 1))
    out = predict_languages(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
