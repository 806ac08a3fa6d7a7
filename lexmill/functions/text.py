"""Text functions on Columns: built-in expressions only, but for nfc, unescape_any, similarity and common_subsequence, which need Python."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lexmill import vocab

# Patterns of glosses, source tags and dictionary lines.
QUALIFIERS = r"\([^)]*\)|\{[^}]*\}|\[[^\]]*\]"
FORM_OF = r'(?:form|spelling|variant) of "([^"]+)"'
COLON = r"^(.+?):\s+(.+)$"
FIRST_PERSON = r"^I\s+(\w+)"
OTHER_PERSON = r"(?i)^(?:he|she|it|they)\s+(\w+)"
POSSESSIVE = r"(?i)^(?:my|his|her|its|our|their)\s+(\w+)"
IT_IS = r"^It'?s\s+(\S+)"
SOURCE_TAG = r":([A-Z0-9]{3})(\d{2,3}):(\d+)$"
HEADWORD_LINE = r"^\s*([^()\d][^()]*?)\s*\(([^)]+)\)\s*(.+)$"
REVERSE_LINES = (r"^([^:=()]+):\s*(.+)$", r"^([^:=()]+)=\s*(.+)$", r"^([^()]+)\([^)]*\)\s*(.+)$")

WORD_CHARS = r"[a-záéíóúüñ']+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def null_if_blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def unescape(c: Column, entities=vocab.ENTITIES) -> Column:
    """The corpus's own entities; see unescape_any for all of HTML's."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), entities, c)


@F.pandas_udf(T.StringType())
def unescape_any(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def strip_tags(c: Column, put: str = " ") -> Column:
    return F.regexp_replace(c, "<[^>]+>", put)


def drop_blocks(c: Column, *names: str) -> Column:
    return F.regexp_replace(c, "(?is)<(" + "|".join(names) + r")\b.*?</\1>", "")


def tokens(c: Column, pattern: str = WORD_CHARS, least: int = 2) -> Column:
    """Lower-case words of the pattern with at least so many characters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)), lambda w: F.length(w) >= least)


def split_words(c: Column) -> Column:
    """Parted by white space, punctuation kept."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def bare_words(c: Column, put: str = ".,;:!?") -> Column:
    return F.filter(F.transform(split_words(F.lower(c)), lambda w: F.btrim(w, F.lit(put))), lambda w: w != "")


def normalise(c: Column) -> Column:
    """Lower case; what is no word character, white space, apostrophe or hyphen is a space; white space collapsed."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s'-]", " "))


def normalise_phrase(c: Column) -> Column:
    """As for scoring: punctuation, hyphen and equals sign are spaces."""
    return collapse(F.regexp_replace(F.lower(c), r"[.,;:!?\"()\[\]{}¿¡«»\-=]", " "))


def split_compounds(c: Column) -> Column:
    return F.translate(c, "-=", "  ")


def ngrams(words: Column, n: int) -> Column:
    """Joined runs of n words; none if there are fewer."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def keep_words(words: Column, stop: list[str], least: int = 3) -> Column:
    """Words that are no stop words and have at least so many characters."""
    return F.filter(words, lambda w: ~w.isin(stop) & (F.length(w) >= least))


def latin(c: Column) -> Column:
    """Cyrillic look-alikes to Latin; quotes and dots made plain; ends stripped."""
    c = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), vocab.CYRILLIC_MANY, F.translate(c, *vocab.CYRILLIC_ONE))
    return strip(F.replace(F.replace(F.translate(c, "‘’ʼ", "'''"), F.lit("…"), F.lit("...")), F.lit("­"), F.lit("")))


def without_accents(c: Column) -> Column:
    return F.translate(c, *vocab.ACCENTS)


def phonetic(c: Column) -> Column:
    """Digraphs rewritten in order, then apostrophes, accents and punctuation dropped."""
    c = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), vocab.PHONETIC, F.lower(c))
    c = without_accents(F.translate(c, "'’‘′", ""))
    return F.regexp_replace(c, r"[.,;:!?¿¡\"\-—()\[\]{}«»“”]", "")


def spellings(c: Column, variants: int | None = None) -> Column:
    """The word and its variants (or the first so many of them), in the order in which they are tried."""
    return F.array_distinct(F.array(c, *(F.replace(c, F.lit(a), F.lit(b)) for a, b in vocab.SPELLINGS[:variants])))


def clean_headword(c: Column) -> Column:
    return F.regexp_replace(collapse(c), r"^[\d.)\-]+\s*", "")


def trim_headword(c: Column) -> Column:
    """Without punctuation at the end and without equals signs, stars, bullets and quotes at either end."""
    c = F.rtrim(strip(c), F.lit(".,:;!?"))
    return strip(F.regexp_replace(F.regexp_replace(c, r'^[\s=*•"]+', ""), r'[\s=*•"]+$', ""))


def trim_definition(c: Column) -> Column:
    """Without a number and marks that a scan put before it, and without full stops at the end."""
    return F.rtrim(strip(F.regexp_replace(F.regexp_replace(strip(c), r"^\d+\s+", ""), r'^[=*•"]+\s*', "")), F.lit("."))


def gloss_terms(c: Column) -> Column:
    """Terms of a gloss: qualifiers dropped, 'form of "X"' is X alone, parts at semicolons without article, verbs also bare."""
    c = F.regexp_replace(c, QUALIFIERS, "")
    form = F.regexp_extract(c, FORM_OF, 1)
    parts = F.filter(F.transform(F.split(c, ";"), lambda p: F.lower(strip(p))), lambda p: (p != "") & (F.length(p) <= 60))
    each = F.transform(parts, lambda p: F.filter(F.array(strip(F.regexp_replace(p, "^(the |an? )", "")), F.when(p.startswith("to "), strip(F.substring(p, 4, 60)))), lambda t: t.isNotNull() & (t != "")))
    return F.when(form != "", F.array(F.lower(strip(form)))).otherwise(F.array_distinct(F.filter(F.flatten(each), lambda t: F.length(t) >= 2)))


def keywords(c: Column) -> Column:
    """Keywords of a gloss: before a colon, the verb after a pronoun, the noun after a possessive, what "it's" names, glosses of two words, article and noun."""
    gloss = F.rtrim(strip(F.regexp_replace(strip(c), r"\s*\([^)]*\)\s*", " ")), F.lit(".,;:!?"))
    before, after = F.regexp_extract(gloss, COLON, 1), F.regexp_extract(gloss, COLON, 2)
    pick = lambda x, p: F.lower(F.nullif(F.regexp_extract(x, p, 1), F.lit("")))
    words = split_words(gloss)
    head = F.rtrim(strip(before), F.lit(".,;:"))
    colon = F.array(F.when((head != "") & (F.size(split_words(head)) <= 3), F.lower(head)), pick(after, FIRST_PERSON), pick(after, OTHER_PERSON), pick(after, POSSESSIVE))
    its = F.rtrim(pick(gloss, IT_IS), F.lit(".,;:"))
    other = F.array(
        pick(gloss, FIRST_PERSON),
        F.when(F.length(its) > 2, its),
        F.when(F.size(words) <= 2, F.rtrim(F.lower(gloss), F.lit(".,;:"))).when((F.size(words) == 3) & F.lower(F.get(words, F.lit(0))).isin("the", "a", "an"), F.lower(F.get(words, F.lit(2)))),
    )
    found = F.transform(F.when(before != "", colon).otherwise(other), lambda k: F.rtrim(strip(k), F.lit(".,;:!?")))
    good = lambda k: k.isNotNull() & (F.length(k) >= 2) & ~k.isin(vocab.STOP_KEYWORDS) & ~k.rlike("^[0-9]+$") & (F.size(split_words(k)) <= 3)
    return F.array_distinct(F.filter(found, good))


def comma_terms(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def sentences(c: Column) -> Column:
    """Parts at full stops, exclamation and question marks, without quotes at the ends."""
    return F.filter(F.transform(F.split(c, "[.!?]"), lambda s: F.btrim(strip(s), F.lit("\"'“”‘’ "))), lambda s: s != "")


def carried_sentences(c: Column, least: int = 3) -> Column:
    """Sentences at white space after an end mark; a fragment of fewer words without end mark joins the sentence before it.

    All parts but the last end with a mark, so only the last can be such a fragment: nothing needs to be carried through the others.
    """
    raw = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    last, n = F.element_at(raw, -1), F.size(raw)
    short = (F.size(split_words(last)) < least) & ~last.rlike("[.!?]$")
    joined = F.concat(F.slice(raw, F.lit(1), n - 2), F.array(F.concat(F.element_at(raw, -2), F.lit(" "), last)))
    return F.when(n < 2, raw).when(short, joined).otherwise(raw)


def source_tag(c: Column) -> dict[str, Column]:
    """book, chapter and verse of a tag such as bible_align:MAT01:3; null where it is no such tag."""
    pattern = SOURCE_TAG
    get = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return {"book": get(1), "chapter": get(2).cast("int"), "verse": get(3).cast("int")}


def headword_entry(c: Column) -> dict[str, Column]:
    """headword, pos and definition of a line 'headword (pos) definition'."""
    pattern = HEADWORD_LINE
    get = lambda i: F.nullif(strip(F.regexp_extract(c, pattern, i)), F.lit(""))
    return {"headword": get(1), "pos": F.substring_index(F.substring_index(get(2), ":", 1), ",", 1), "definition": get(3)}


def reverse_entry(c: Column) -> dict[str, Column]:
    """term and headword of a line of the reverse section: at a colon, else at an equals sign, else around a bracketed pos."""
    patterns = REVERSE_LINES
    get = lambda i: F.coalesce(*(F.nullif(strip(F.regexp_extract(c, p, i)), F.lit("")) for p in patterns))
    return {"term": get(1), "headword": get(2)}


def tagged_examples(c: Column, patterns: dict[str, str] | tuple[tuple[str, str], ...] = vocab.GRAMMAR_RULES, clip: int = 200) -> Column:
    """Array of (kind, text) for every match of each pattern, clipped, in the order of the patterns."""
    found = lambda kind, p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.substring(strip(m), 1, clip).alias("text")))
    return F.flatten(F.array(*(found(k, p) for k, p in (patterns.items() if isinstance(patterns, dict) else patterns))))


def bilingual_examples(c: Column) -> Column:
    """Array of (kind, tol, translation): numbered lines with a quoted line below, two quoted texts, texts parted by a slash or an equals sign."""

    def found(kind: str, pattern: str) -> Column:
        first = 2 if kind == "numbered" else 1
        both = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(first)).alias("a"), F.regexp_extract_all(c, F.lit(pattern), F.lit(first + 1)).alias("b"))
        return F.transform(both, lambda m: F.struct(F.lit(kind).alias("kind"), strip(m["a"]).alias("tol"), strip(m["b"]).alias("translation")))

    return F.flatten(F.array(*(found(k, p) for k, p in vocab.GRAMMAR_EXAMPLES)))


def conjugation(c: Column, persons: dict[str, str], markers: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """person, base and tense of a verb phrase: the first person word, in their order, that begins it, then the first marker that the rest holds.

    Without a marker it is an infinitive if it begins with "to " or names no person, else present.
    """
    low = strip(F.lower(c))
    begins = lambda p: low.startswith(p + " ")
    first = lambda cases, last: reduce(lambda w, kv: w.when(*kv), cases[1:], F.when(*cases[0])).otherwise(last)
    person = first([(begins(p), F.lit(code)) for p, code in persons.items()], F.lit(""))
    rest = first([(begins(p), strip(F.substring(low, len(p) + 2, 1 << 30))) for p in persons], low)
    base = first([(rest.contains(m), F.lit(v)) for m, (v, _) in markers.items()], F.lit(""))
    tense = first([(rest.contains(m), F.lit(t)) for m, (_, t) in markers.items()], F.when(rest.startswith("to ") | (person == ""), "infinitive").otherwise("present"))
    return {"person": person, "base": base, "tense": tense}


def pcm16(c: Column) -> Column:
    """A sample of -1 to 1, clamped, as a 16-bit integer cut towards zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) * 32767).cast("short")


def plain_quotes(c: Column) -> Column:
    """Typographic quotes and apostrophes as their plain forms, then composed letters."""
    return nfc(F.translate(c, "‘’ʼ′“”«»", "'" * 4 + '"' * 4))


def pos_name(c: Column) -> Column:
    """Canonical part of speech of a raw category: exact name, then parts of names, else noun; other without a category."""
    raw = F.lower(strip(c))
    exact = reduce(lambda w, kv: w.when(raw == kv[0], kv[1]), list(vocab.POS.items())[1:], F.when(raw == "sustantivo", "noun"))
    return F.when(F.coalesce(c, F.lit("")) == "", "other").otherwise(F.coalesce(exact, F.when(raw.contains("verb") | raw.startswith("v"), "verb").when(raw.contains("adj") | raw.startswith("ady"), "adjective").when(raw.contains("adv"), "adverb").when(raw.contains("pron"), "pronoun").otherwise("noun")))


def semantic_category(words: Column, categories: dict[str, list[str]]) -> Column:
    """The first category, in their order, of which a keyword is among the words; else other."""
    found = F.when(F.lit(False), "")
    for name, keys in categories.items():
        found = found.when(F.arrays_overlap(words, F.array(*map(F.lit, keys))), name)
    return found.otherwise("other")


def difficulty(category: Column, pos: Column, n_words: Column) -> Column:
    easy = category.isin("numbers", "colors", "greetings", "family") | (category.isin("body", "animals", "food") & (n_words <= 2))
    middle = category.isin("body", "animals", "food", "nature", "house") | (pos == "verb")
    return F.when(easy, 1).when(middle, 2).when(n_words > 3, 3).otherwise(2)


def dice(together: Column, a: Column, b: Column) -> dict[str, Column]:
    """dice, ratio of the smaller to the larger marginal, and their weighted score, unrounded."""
    d, r = 2.0 * together / (a + b), F.least(a, b) / F.greatest(a, b)
    return {"dice": d, "ratio": r, "score": 0.6 * d + 0.4 * r}


def count_confidence(n: Column) -> Column:
    return F.least(F.lit(0.8), 0.5 + 0.05 * n)


def probability_confidence(p: Column) -> Column:
    return F.least(F.lit(0.85), 0.4 + 0.5 * p)


def line_quality(c: Column) -> Column:
    """Share of letters and common marks, times length."""
    valid = F.length(F.regexp_replace(c, r"(?U)[^\w\s.,;:'()-]", ""))
    return F.when(F.length(c) > 0, valid / F.length(c) * F.length(c)).otherwise(0.0)


def bag_overlap(a: Column, b: Column) -> Column:
    """Share of a's words (with their multiplicity) that b holds; null without words."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w))) / F.nullif(F.size(a), F.lit(0))


def tolerant_hits(expected: Column, actual: Column) -> Column:
    """Number of expected words that are among the actual ones, or from three letters on contain one or are contained in one."""
    near = lambda e: F.exists(actual, lambda w: (w == e) | ((F.length(e) >= 3) & (w.contains(e) | e.contains(w))))
    return F.size(F.filter(expected, near))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: each word of the shorter list is one step over bits of the longer one's places, 64 and more at a time."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    places: dict[str, list[int]] = {w: [] for w in a}
    for i, w in enumerate(b):
        if w in places:
            places[w].append(i)
    # masks of words with many places are kept, of which there are few; others are made when needed, so memory stays far below the square
    mask_of = lambda of: sum(1 << i for i in of) if len(of) < 16 else int("".join("1" if i in marks else "0" for marks in [set(of)] for i in range(len(b) - 1, -1, -1)), 2)
    kept = {w: mask_of(of) for w, of in places.items() if len(of) >= 64}
    full = (1 << len(b)) - 1
    open_places = full  # a bit is cleared where the length grows
    for w in a:
        if places[w]:
            hit = open_places & (kept[w] if w in kept else mask_of(places[w]))
            open_places = ((open_places + hit) | (open_places - hit)) & full
    return len(b) - open_places.bit_count()


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays of words; null if either is null."""
    return pd.Series([None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, as difflib has it."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.[^.]+$", ""), r"[^A-Za-z0-9_-]+", "_")


def segment_name(book: Column, chapter: Column, verse: Column) -> Column:
    return F.format_string("%s_%02d_v%03d.wav", book, chapter, verse)


def to_samples(ms: Column, rate: int | Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Milliseconds to a sample number, cut to an integer and clamped."""
    n = (ms * rate / 1000).cast("long")
    n = F.greatest(n, low) if low is not None else n
    return F.least(n, high) if high is not None else n


def proportional_slice(words: Column, i: Column, parts: Column) -> Column:
    """The i-th (from 0) of so many parts of the words."""
    n = F.size(words)
    start = F.floor(n * i / parts).cast("int")
    return F.slice(words, start + 1, F.floor(n * (i + 1) / parts).cast("int") - start)
