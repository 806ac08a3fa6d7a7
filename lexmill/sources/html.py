"""Chapter files with verse markup, and paragraphs and links of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions.text import collapse, drop_blocks, strip_tags, unescape
from lexmill.sources import ranges

# Patterns of the corpus's markup.
VERSE = r"(?s)<span class=\"verse\"[^>]*>\s*(\d+(?:-\d+)?)(?:&#160;|&nbsp;|\s)*</span>(.*?)(?=<span class=\"verse\"|<ul|<div class=\"footnote|$)"
SINGLE, NAIVE = r"^\d+$", r"(?s)<span[^>]*class=\"verse\"[^>]*>(.*?)</span>"
NOTES = r"(?s)<span class=\"(?:popup|notemark)\"[^>]*>.*?</span>|<a[^>]*class=\"notemark\"[^>]*>.*?</a>"


def clean_markup(page: Column) -> Column:
    """Pop-ups and note marks dropped, added words unwrapped."""
    page = F.regexp_replace(page, NOTES, "")
    return F.regexp_replace(page, r"(?s)<span class=['\"]add['\"]>(.*?)</span>", "$1")


def verses(pages: DataFrame, keys: list[str], html: str = "value", merged: str = "drop") -> DataFrame:
    """keys, verse, text of each verse that has text. A label such as 15-16 is dropped, or its text is replicated to each verse."""
    page = clean_markup(F.col(html))
    pairs = F.arrays_zip(F.regexp_extract_all(page, F.lit(VERSE), F.lit(1)).alias("label"), F.regexp_extract_all(page, F.lit(VERSE), F.lit(2)).alias("body"))
    rows = pages.select(*keys, F.explode(pairs).alias("v")).select(*keys, F.col("v.label").alias("label"), collapse(unescape(strip_tags(F.col("v.body"), ""))).alias("text")).where("text <> ''")
    first = F.split("label", "-")[0].cast("int")
    if merged == "drop":
        return rows.where(F.col("label").rlike(SINGLE)).select(*keys, first.alias("verse"), "text")
    last = F.element_at(F.split("label", "-"), -1).cast("int")
    return rows.select(*keys, F.explode(F.sequence(first, F.greatest(first, last))).alias("verse"), "text")


def first_verses(pages: DataFrame, keys: list[str], html: str = "value", n: int = 3, least: int = 10) -> DataFrame:
    """The first n verse bodies of a page that are longer than so many characters."""
    body = F.slice(F.regexp_extract_all(clean_markup(F.col(html)), F.lit(VERSE), F.lit(2)), 1, n)
    return pages.select(*keys, F.posexplode(body).alias("pos", "body")).select(*keys, "pos", collapse(unescape(strip_tags(F.col("body"), ""))).alias("text")).where(F.length("text") > least)


def read_corpus(spark: SparkSession, paths: dict[str, str], merged: str = "drop", books: list[str] | None = None, most: int = 199) -> DataFrame:
    """lang, book, chapter, verse, text of chapter files named like MAT01.htm or PSA001.htm, from a path per language.

    books: only these are read: files of other names are not listed, let alone opened. Chapters beyond most are left out.
    """
    named = {p.rstrip("/").rpartition("/")[2]: lang for lang, p in paths.items()}
    glob = "{" + ",".join(f"{b}*.htm" for b in books) + "}" if books else "*.htm"
    if len(named) == len(paths) and all(re.fullmatch(r"[\w.-]+", n) for n in named):  # folders tell the languages: one read, whose plan does not grow with them
        parents = {p.rstrip("/").rpartition("/")[0] for p in paths.values()}
        if len(parents) == 1 and ranges.reachable(parent := parents.pop()):  # neither the driver nor a plan holds the files' names, and partitions go by bytes
            read, at = ranges.read_files(spark, parent, list(named), books, ".htm").select(F.col("content").cast("string").alias("value"), "name"), F.col("name")
        else:
            read, at = spark.read.option("pathGlobFilter", glob).text(list(paths.values()), wholetext=True), F.input_file_name()
        part = lambda i: F.regexp_extract(at, r"([^/]+)/([A-Z0-9]{3})(\d{2,3})\.htm[^/]*$", i)
        langs = spark.createDataFrame(list(named.items()), "_folder string, lang string")
        files = read.select("value", part(1).alias("_folder"), part(2).alias("book"), part(3).cast("int").alias("chapter")).where(f"book <> '' AND chapter BETWEEN 1 AND {most}")
        return verses(files, ["_folder", "book", "chapter"], merged=merged).join(F.broadcast(langs), "_folder").select("lang", "book", "chapter", "verse", "text")
    out = None
    for lang, path in paths.items():
        files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([A-Z0-9]{3})(\d{2,3})\.htm", 1).alias("book"), F.regexp_extract(F.input_file_name(), r"([A-Z0-9]{3})(\d{2,3})\.htm", 2).cast("int").alias("chapter"))
        part = verses(files.where(f"book <> '' AND chapter BETWEEN 1 AND {most}"), ["book", "chapter"], merged=merged).withColumn("lang", F.lit(lang))
        out = part if out is None else out.unionByName(part)
    return out.select("lang", "book", "chapter", "verse", "text")


def paragraphs(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, pos, text of each paragraph with text; scripts and styles are dropped first."""
    found = F.regexp_extract_all(drop_blocks(F.col(html), "script", "style"), F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return pages.select(*keys, F.posexplode(found).alias("pos", "p")).select(*keys, "pos", collapse(unescape(strip_tags(F.col("p"), ""))).alias("text")).where("text <> ''")


def links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, target, label of each list item's link."""
    pattern = F.lit(r"<li><a href=\"([^\"]*)\">(.*?)</a></li>")
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("target"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("label"))
    return pages.select(*keys, F.explode(pairs).alias("l")).select(*keys, "l.target", "l.label")
