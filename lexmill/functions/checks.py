"""Validity rules as boolean Columns; null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexmill import vocab
from lexmill.functions.text import split_words, strip

# Fixed value: part-of-speech tags of the dictionary.
POS_TAG = r"(?:s|vi|vt|adj|adv|pro|int|conj|prep|ve|vr|vc)"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def count_in(words: Column, known: list[str], trim: str = "") -> Column:
    """How many of the words, with their multiplicity, are known."""
    plain = lambda w: F.rtrim(F.lower(w), F.lit(trim)) if trim else F.lower(w)
    return F.size(F.filter(words, lambda w: plain(w).isin(known)))


def function_word_sentence(c: Column, known: list[str], words: int = 4, least: int = 2) -> Column:
    w = split_words(text_of(c))
    return (F.size(w) >= words) & (count_in(w, known, ".,;:!?") >= least)


def has_marked_letters(c: Column) -> Column:
    return text_of(c).rlike("[üïöëṽ'ʼ]")


def verb_form(w: Column, suffixes: list[str] = vocab.VERB_SUFFIXES_ES) -> Column:
    """Ends like a verb, with a stem of three letters or more."""
    low = F.lower(w)
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: low.endswith(s) & (F.length(low) > F.length(s) + 2))


def valid_word(tol: Column, spanish: Column) -> Column:
    t, s = text_of(tol), text_of(spanish)
    words = split_words(F.lower(t))
    marks = F.size(F.array_intersect(words, F.array(*map(F.lit, vocab.INDICATORS))))
    return (
        F.length(t).between(2, 60) & F.length(s).between(2, 80) & ~t.rlike("[0-9]{3,}")
        & ((F.lower(t) != F.lower(s)) | F.lower(t).isin("café", "animal"))
        & ~strip(t).rlike(r"^[()\[\]]+$") & ~(t.startswith("(") & t.endswith(")") & ~t.contains(" "))
        & (marks < 2) & ~((F.size(words) > 3) & (marks >= 1)) & ~strip(t).rlike(r"^\([mf]\)")
    )


def valid_headword(c: Column) -> Column:
    t = text_of(c)
    words = split_words(t)
    return F.length(t).between(2, 40) & ~t.rlike("^[0-9]+$") & (F.size(words) <= 5) & ~((F.size(words) > 3) & (count_in(words, vocab.HEADWORD_FUNCTION_WORDS) >= 2))


def valid_entry(tol: Column, spanish: Column, category: Column) -> Column:
    t, s = strip(text_of(tol)), strip(text_of(spanish))
    words = split_words(t)
    tail = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    return (
        (F.length(t) >= 2) & (F.length(s) >= 2) & ~t.rlike("^[0-9]+$") & ~s.rlike("^[0-9]+$")
        & ~function_word_sentence(t, vocab.STOP_ES) & (count_in(words, vocab.MIXED_LINE_WORDS) == 0)
        & ~((F.size(words) > 3) & (count_in(tail, vocab.STOP_ES) >= 1))
        & ~t.rlike(rf"(?i)^\({POS_TAG}\b") & ~(t.rlike(rf"(?i)^{POS_TAG}\s") & ~F.substring(t, 1, 6).contains("'"))
        & ~t.rlike(rf"(?i)\s\({POS_TAG}\)\s") & text_of(category).isin("", *vocab.ENTRY_POS)
    )


def valid_sentence(tol: Column, spanish: Column) -> Column:
    t, s = strip(text_of(tol)), strip(text_of(spanish))
    return (F.length(t) >= 5) & (F.length(s) >= 5) & ~(function_word_sentence(t, vocab.STOP_ES) & ~has_marked_letters(t)) & (F.lower(t) != F.lower(s)) & ~t.rlike(rf"(?i)\({POS_TAG}\)")


def garbage_english(c: Column) -> Column:
    t = text_of(c)
    letters = strip(F.regexp_replace(t, r"[^a-zA-Z\s]", ""))
    words = split_words(letters)
    return (F.length(strip(t)) < 2) | (F.length(letters) < 2) | (F.forall(words, lambda w: F.length(w) == 1) & (F.size(words) <= 2))


def garbage_headword(c: Column) -> Column:
    t = text_of(c)
    return (F.length(strip(t)) < 2) | (F.length(t) > 100) | t.rlike(r"^[\d\s.,;:!?]+$")


def garbage_gloss(c: Column) -> Column:
    t = text_of(c)
    return (F.length(strip(t)) < 1) | t.rlike(r"^[\d\s.,;:!?]+$")


def segment_quality(duration: Column, n_chars: Column, low: float = 5.0, high: float = 25.0) -> Column:
    """good where the characters a second are plausible, else suspect."""
    return F.when((n_chars / duration).between(low, high), "good").otherwise("suspect")
