"""Secret scans: entropy of sliding windows per character class, with an allow-list.

Three patterns give the base spans. The method adds spans: candidate strings are runs of token characters;
within each, for every character class (hex, alphanumeric, base64) a window of fixed width slides over the
runs of that class while its Shannon entropy is kept by incremental counts (one character enters, one
leaves). Windows at or above the class's threshold are merged to spans. The allow-list suppresses whole candidates and runs
that are no secrets in full, and of other runs only the windows that hold a placeholder word: what stands beside such a
word is scanned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import small_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is long enough starts at the same place as any run
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
WORDS = ("passw", "secret", "token", "api_key", "apikey")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character class: pattern of its runs, window width, least entropy in bits.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.1),
)
#: Candidates and runs that are no secrets as a whole: one repeated unit, plain words joined, digits alone, a key that public manuals print, UUIDs.
ALLOW = (
    re.compile(r"(.{1,4})\1{4,}"),
    re.compile(r"[0-9]+(?:[-_/][0-9]+)*"),
    re.compile(r"[A-Z]?[a-z]+(?:[-_/=+]+[A-Z]?[a-z]+|[A-Z][a-z]+)*[-_/=+]*"),  # a piece begins with a separator or a capital, so there is one way to match
    re.compile(r"[A-Z]+(?:[-_/=+][A-Z]+)*"),
    re.compile(r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
)
#: Words that make a placeholder of the window that holds them.
PLACEHOLDER = re.compile(r"EXAMPLE|example|placeholder|xxxx|XXXX|0123456789|abcdefghij")
KINDS = ("assign", "access", "hex")


def uncovered(places: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of the places (in order, apart from each other) that no span covers; one pass over both."""
    out, at, spans = [], 0, sorted(spans)
    for start, end in places:
        while at < len(spans) and spans[at][1] <= start:  # spans don't overlap each other
            at += 1
        k = at
        while k < len(spans) and spans[k][0] < end:
            if start < spans[k][0]:
                out.append((start, spans[k][0]))
            start = max(start, spans[k][1])
            k += 1
        if start < end:
            out.append((start, end))
    return out


@dataclass
class Scanner:
    classes: tuple = CLASSES
    allow: tuple = ALLOW
    terms: list[float] = field(default_factory=lambda: [0.0] + [n * log2(n) for n in range(1, 257)])

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        low = text.lower()
        if any(w in low for w in WORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))

    def windows(self, run: str, width: int, least: float) -> Iterator[tuple[int, int]]:
        """Merged places of the windows of the run whose entropy is at least least and that hold no placeholder word."""
        words = [(m.start(), m.end()) for m in PLACEHOLDER.finditer(run)]
        w = 0  # the first word that starts no earlier than the window
        counts: dict[str, int] = {}
        total, open_at, end = 0.0, -1, -1  # total: sum of n log2 n over the window's counts
        bound = log2(width) - least
        for i, ch in enumerate(run):
            n = counts.get(ch, 0)
            counts[ch] = n + 1
            total += self.terms[n + 1] - self.terms[n]
            if i >= width:
                gone = run[i - width]
                n = counts[gone]
                counts[gone] = n - 1
                total += self.terms[n - 1] - self.terms[n]
            start = i - width + 1
            while w < len(words) and words[w][0] < start:
                w += 1
            if start >= 0 and total / width <= bound + 1e-9 and not (w < len(words) and words[w][1] <= i + 1):
                if open_at < 0:
                    open_at = start
                elif start > end:
                    yield open_at, end
                    open_at = start
                end = i + 1
        if open_at >= 0:
            yield open_at, end

    def entropy(self, text: str) -> list[tuple[int, int, str]]:
        """Spans of high entropy; where those of several classes overlap, a later class has what earlier ones leave uncovered."""
        found: list[tuple[int, int, str]] = []
        for m in CANDIDATE.finditer(text):
            if any(a.fullmatch(m[0]) for a in self.allow):
                continue
            mine: list[tuple[int, int, str]] = []
            for name, runs, width, least in self.classes:
                places = []
                for r in runs.finditer(m[0]):
                    if any(a.fullmatch(r[0]) for a in self.allow):
                        continue
                    at = m.start() + r.start()
                    places += [(at + s, at + e) for s, e in self.windows(r[0], width, least)]
                mine += [(*part, f"entropy_{name}") for part in uncovered(places, mine)]
            found += mine
        return sorted(found)

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and those that the method adds (none that lies within a base span)."""
        if not text:
            return [], []
        base = self.base(text)
        starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
        within = lambda s, e: (i := bisect_right(starts, s)) > 0 and e <= ends[i - 1]  # noqa: E731 - the furthest end of the base spans that start no later
        return base, [x for x in self.entropy(text) if not within(x[0], x[1])]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def scan_secrets(docs: DataFrame, scanner: Scanner | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of base spans, base and all spans as text. Code points, end exclusive.

    Null and empty texts have no spans. Whole texts are scanned, whatever their length, in time linear in it; rows stay as
    they are repeated, null keys too. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    scanner = scanner or Scanner()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, bases, spans = {k: [] for k in KINDS}, [], []
            for t in b.column("_text").to_pylist():
                base, extra = scanner.scan(t)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                bases.append(joined(base))
                order = {k: i for i, k in enumerate(KINDS)}
                spans.append(joined(sorted(base + extra, key=lambda s: (s[0], order.get(s[2], 9), s[2]))))
            yield pa.RecordBatch.from_arrays([b.column("_key"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(bases, pa.string()), pa.array(spans, pa.string())], ["_key", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(scan, f"_key {kind}, n_assign long, n_access long, n_hex long, base string, spans string").withColumnRenamed("_key", key)


def redact(docs: DataFrame, scanner: Scanner | None = None, mark: str = "[SECRET]", *, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with each base or added span replaced by mark; texts without spans stay as they are.

    Spans that overlap or touch are replaced as one. If there is a column chars, it holds the new length of changed texts.
    """
    small_batches(docs.sparkSession)
    scanner = scanner or Scanner()
    names, schema = docs.columns, docs.schema

    def clean(t: str | None) -> str | None:
        base, extra = scanner.scan(t)
        out, at = [], 0
        merged: list[list[int]] = []
        for s, e, _ in sorted(base + extra):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in merged:
            out += [t[at:s], mark]
            at = e
        return "".join([*out, t[at:]]) if merged else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(text).to_pylist()
            new = [clean(t) for t in old]
            cols = {c: b.column(c) for c in names}
            cols[text] = pa.array(new, pa.string())
            if chars in cols:
                cols[chars] = pa.array([v if o is n or o == n else len(n) for o, n, v in zip(old, new, cols[chars].to_pylist(), strict=True)], cols[chars].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return docs.mapInArrow(run, schema)


def op4_secret_scans(docs: DataFrame) -> DataFrame:
    """The digest columns of scan_secrets over every document."""
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def base_digest(text: str | None) -> str:
    """What base_sha256 holds for one text; for tests."""
    return hashlib.sha256(joined(Scanner().base(text or "")).encode()).hexdigest()
