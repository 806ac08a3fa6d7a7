"""Rules on text, connectors and reports: what the other modules' queries do not run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill import vocab
from lexmill.functions import checks, text as X
from lexmill.operators import joins, picks
from lexmill.operators.durable import shared_base
from lexmill.plans import evaluate, serve
from lexmill.queries.corpus import LINES, PAIRS, SPLIT, STOP, WORDS, lines, turn_pairs
from lexmill.queries.registry import query, table
from lexmill.sources import files, html, sinks

COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_base(spark).rstrip('/')}/lexmill/{name}-{uuid.uuid4().hex}"


# --- scans and writers


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {COLLAPSE.format('line')} AS text FROM {LINES} WHERE pos < 3 AND length({COLLAPSE.format('line')}) > 10")
def s03_first_verses(spark, sf_dir):
    """The first three bodies of a chapter, those of more than ten characters."""
    span = lambda line, i: F.concat(F.lit('<span class="verse" id="V">'), (i + 1).cast("string"), F.lit("&#160;</span>"), F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array_join(F.transform(F.split("text", "\n"), span), " "), F.lit('<ul class="tnav">')).alias("value"))
    return html.first_verses(pages, ["doc_id"])


@query("SELECT conv_id, turn, text FROM conversations")
def s05_json_entries(spark, sf_dir):
    """Turns appended to JSON lines in two batches, and entries read with a schema."""
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), folder(spark, "entries")
    sinks.append_jsonl(rows.where("conv_id % 2 = 0"), path)
    sinks.append_jsonl(rows.where("conv_id % 2 = 1 OR conv_id IS NULL"), path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return spark.read.schema(kinds).json(path)


@query("SELECT n_name AS tol, r_name AS spanish, 'noun' AS category, CAST(NULL AS VARCHAR) AS section FROM nation JOIN region ON n_regionkey = r_regionkey")
def s07_parsed_dictionary(spark, sf_dir):
    """One JSON document with a list of entries and without one of sentences, written and read with defaults."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries, path = rows.select(F.col("n_name").alias("tol"), F.col("r_name").alias("spanish"), F.lit("noun").alias("category")), folder(spark, "parsed")
    sinks.document(entries, "dictionary", ["tol"]).write.text(path)
    return files.parsed_dictionary(spark, path)[0]


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE starts_with(p_name, 'b')")
def s09_csv_rows(spark, sf_dir):
    """A file with a header and fields parted by pipes, rows chosen by the beginning of a field."""
    path = folder(spark, "csv")
    sinks.write_pipe(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path)
    rows = files.csv_rows(spark, path, "|")
    return files.prefixed(rows, "p_name", "b").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def s14_scan(spark, sf_dir):
    """Projection and predicate, both within the scan."""
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES ('lexmill_known', true), ('lexmill_unknown', false)) t(name, found)")
def s15_table_exists(spark, sf_dir):
    """Whether the catalog has a table."""
    table(spark, sf_dir, "region").createOrReplaceTempView("lexmill_known")
    found = [(n, files.table_exists(spark, n)) for n in ("lexmill_known", "lexmill_unknown")]
    spark.catalog.dropTempView("lexmill_known")
    return spark.createDataFrame(found, "name string, found boolean")


@query("SELECT unnest(['nation', 'part']) AS stem")
def s20_not_done(spark, sf_dir):
    """Files of a folder by name, without those that are done."""
    done = spark.createDataFrame([("region",), ("supplier",)], "stem string")
    found = files.listing(spark, sf_dir, "*.parquet").where("stem IN ('region', 'nation', 'supplier', 'part')")
    return files.not_done(found, done).select("stem")


@query("SELECT o_orderkey, o_clerk_rank, day FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS o_clerk_rank, CAST(o_orderdate AS VARCHAR) AS day, CAST(o_orderkey AS VARCHAR) || o_orderpriority AS name FROM orders) ORDER BY o_clerk_rank, CASE WHEN contains(name, 'URGENT') THEN 0 ELSE 1 END, day DESC, name LIMIT 1")
def s21_latest(spark, sf_dir):
    """The one artifact to use: best folder, preferred name, newest."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("o_clerk_rank"), F.col("o_orderdate").cast("string").alias("day"), F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("name"))
    return files.latest(rows, "o_clerk_rank", "day", "name", prefer="URGENT").select("o_orderkey", "o_clerk_rank", "day")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def k10_rebuild(spark, sf_dir):
    """A table truncated and built anew; rows are written in as many batches as partitions."""
    rows, path = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), folder(spark, "rebuilt")
    sinks.rebuild(rows, path)
    sinks.rebuild(rows.where("s_suppkey % 2 = 0"), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT lang, coalesce(lang, 'unknown') || ': ' || count(*) FILTER (s >= 0.5) || ' of ' || count(*) || ' (' || printf('%.1f', count(*) FILTER (s >= 0.5) * 100.0 / count(*)) || '%)' AS line FROM (SELECT lang, coalesce(quality, 0) * 0.5 + (1 - coalesce(toxic, 0)) * 0.5 AS s FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang")
def k13_report(spark, sf_dir):
    """A report of counts and percentages, a line for each group."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.report_lines(rows.select("lang", (F.coalesce("quality", F.lit(0)) * 0.5 + (1 - F.coalesce("toxic", F.lit(0))) * 0.5).alias("s")), "lang", "s")


# --- rules


_T = "trim(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_SPANISH = lambda t: f"len({SPLIT.format(t)}) >= 4 AND len(list_filter({SPLIT.format(t)}, lambda x: rtrim(lower(x), '.,;:!?') IN {STOP(vocab.STOP_ES)})) >= 2"
_TAG = checks.POS_TAG


@query(f"""
WITH t AS (SELECT pair_id, trim(a) AS t, trim(b) AS s, {SPLIT.format('trim(a)')} AS w FROM {PAIRS})
SELECT pair_id, length(t) >= 2 AND length(s) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(s, '^[0-9]+$') AND NOT ({_SPANISH('t')})
  AND len(list_filter(w, lambda x: lower(x) IN {STOP(vocab.MIXED_LINE_WORDS)})) = 0 AND NOT (len(w) > 3 AND len(list_filter(w[2:], lambda x: lower(x) IN {STOP(vocab.STOP_ES)})) >= 1)
  AND NOT regexp_matches(t, '(?i)^\\({_TAG}\\b') AND NOT (regexp_matches(t, '(?i)^{_TAG}\\s') AND NOT contains(t[1:6], '''')) AND NOT regexp_matches(t, '(?i)\\s\\({_TAG}\\)\\s') AS entry,
  length(t) >= 5 AND length(s) >= 5 AND NOT ({_SPANISH('t')} AND NOT regexp_matches(t, '[üïöëṽ''ʼ]')) AND lower(t) <> lower(s) AND NOT regexp_matches(t, '(?i)\\({_TAG}\\)') AS sentence
FROM t""".replace("\\\\", "\\"))
def p08_entry_checks(spark, sf_dir):
    """The batteries for entries and for sentences on a turn and its answer."""
    return turn_pairs(spark, sf_dir).select("pair_id", checks.valid_entry(F.col("a"), F.col("b"), F.lit("")).alias("entry"), checks.valid_sentence(F.col("a"), F.col("b")).alias("sentence"))


@query(rf"""
WITH t AS (SELECT doc_id, pos, line, {SPLIT.format('line')} AS w FROM {LINES})
SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(line) BETWEEN 2 AND 40 AND NOT regexp_matches(line, '^[0-9]+$') AND len(w) <= 5 AND NOT (len(w) > 3 AND len(list_filter(w, lambda x: lower(x) IN {STOP(vocab.HEADWORD_FUNCTION_WORDS)})) >= 2) AS headword,
  regexp_matches(line, '[üïöëṽ''ʼ]') AS marked FROM t""")
def p09_headword_checks(spark, sf_dir):
    """Headword battery and marked letters, on lines."""
    return lines(spark, sf_dir).select("doc_id", "pos", checks.valid_headword(F.col("line")).alias("headword"), checks.has_marked_letters(F.col("line")).alias("marked"))


PERSONS = {"of": "1s", "the": "3s", "and": "3p"}
MARKERS = {"ing": ("ing", "present"), "ed": ("ed", "past"), "will": ("will", "future")}


@query(f"""
WITH t AS (SELECT doc_id, pos, trim(lower(line)) AS low FROM {LINES}),
p AS (SELECT doc_id, pos, CASE {' '.join(f"WHEN starts_with(low, '{p} ') THEN '{c}'" for p, c in PERSONS.items())} ELSE '' END AS person,
  CASE {' '.join(f"WHEN starts_with(low, '{p} ') THEN trim(low[{len(p) + 2}:])" for p in PERSONS)} ELSE low END AS rest FROM t)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, person, CASE {' '.join(f"WHEN contains(rest, '{m}') THEN '{v}'" for m, (v, _) in MARKERS.items())} ELSE '' END AS base,
  CASE {' '.join(f"WHEN contains(rest, '{m}') THEN '{t}'" for m, (_, t) in MARKERS.items())} WHEN starts_with(rest, 'to ') OR person = '' THEN 'infinitive' ELSE 'present' END AS tense FROM p""")
def p16_conjugation(spark, sf_dir):
    """Person, base verb and tense by the first case that holds."""
    got = X.conjugation(F.col("line"), PERSONS, MARKERS)
    return lines(spark, sf_dir).select("doc_id", "pos", *(c.alias(n) for n, c in got.items()))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in vocab.GRAMMAR_PATTERNS) + ") t(english, tol, source, confidence)")
def p17_constant_rows(spark, sf_dir):
    """Rows that are entered as they are."""
    return spark.createDataFrame([*vocab.GRAMMAR_PATTERNS], "english string, tol string, source string, confidence double")


@query(rf"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, {COLLAPSE.format(r"regexp_replace(lower(line), '[^\p{L}\p{N}_\s''-]', ' ', 'g')")} AS words,
  {COLLAPSE.format(r"regexp_replace(lower(line), '[.,;:!?\x22()\[\]{}¿¡«»\-=]', ' ', 'g')")} AS phrase, translate(line, '-=', '  ') AS compounds FROM {LINES}""")
def f08_normalised(spark, sf_dir):
    """The three ways to level a line's punctuation."""
    c = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "pos", X.normalise(c).alias("words"), X.normalise_phrase(c).alias("phrase"), X.split_compounds(c).alias("compounds"))


_CYRILLIC = ("aeopcyx", "аеорсух")


def _latin_sql(c: str) -> str:
    c = f"translate({c}, '{vocab.CYRILLIC_ONE[0]}', '{vocab.CYRILLIC_ONE[1].replace(chr(39), chr(39) * 2)}')"
    for a, b in vocab.CYRILLIC_MANY:
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim({c})"


@query(f"SELECT p_partkey, {_latin_sql(f'''translate(p_name, '{_CYRILLIC[0]}', '{_CYRILLIC[1]}') || ' щука жюъ ' ''')} AS name FROM part")
def f12_latin(spark, sf_dir):
    """names with letters of another script read as Latin ones."""
    return table(spark, sf_dir, "part").select("p_partkey", X.latin(F.concat(F.translate("p_name", *_CYRILLIC), F.lit(" щука жюъ "))).alias("name"))


@query("SELECT doc_id, CAST(pos AS INTEGER) AS pos, nfc_normalize(translate('«' || replace(line, 'é', 'e' || chr(769)) || '’', '‘’ʼ′“”«»', '''''''''\"\"\"\"')) AS text FROM " + LINES)
def f13_plain_quotes(spark, sf_dir):
    """quotes made plain and letters composed."""
    given = F.concat(F.lit("«"), F.replace("line", F.lit("é"), F.lit("é")), F.lit("’"))
    return lines(spark, sf_dir).select("doc_id", "pos", X.plain_quotes(given).alias("text"))


_MARKED = "' *=' || p_partkey || ' ' || p_name || '.:' || CASE WHEN p_partkey % 2 = 0 THEN ' *' ELSE '' END"


@query(rf"""
WITH t AS (SELECT p_partkey, {_MARKED} AS c, p_partkey || '  = ' || p_name || '..' AS d FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(rtrim(trim(c), '.,:;!?'), '^[\s=*•\x22]+', ''), '[\s=*•\x22]+$', '')) AS headword,
  rtrim(trim(regexp_replace(regexp_replace(trim(d), '^\d+\s+', ''), '^[=*•\x22]+\s*', '')), '.') AS definition,
  regexp_replace({COLLAPSE.format('d')}, '^[\d.)\-]+\s*', '') AS plain FROM t""")
def f17_cleaned(spark, sf_dir):
    """headwords, definitions and plain words without what scans put around them."""
    p = table(spark, sf_dir, "part")
    c = F.concat(F.lit(" *="), "p_partkey", F.lit(" "), "p_name", F.lit(".:"), F.when(F.col("p_partkey") % 2 == 0, " *").otherwise(""))
    d = F.concat("p_partkey", F.lit("  = "), "p_name", F.lit(".."))
    return p.select("p_partkey", X.trim_headword(c).alias("headword"), X.trim_definition(d).alias("definition"), X.clean_headword(d).alias("plain"))


@query(r"""
WITH t AS (SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN ': ' WHEN 1 THEN ' = ' WHEN 2 THEN ' (s) ' ELSE ' ' END) AS c FROM part),
x AS (SELECT * FROM t)
SELECT p_partkey, coalesce(nullif(trim(regexp_extract(c, ps[1], 1)), ''), nullif(trim(regexp_extract(c, ps[2], 1)), ''), nullif(trim(regexp_extract(c, ps[3], 1)), '')) AS term,
  coalesce(nullif(trim(regexp_extract(c, ps[1], 2)), ''), nullif(trim(regexp_extract(c, ps[2], 2)), ''), nullif(trim(regexp_extract(c, ps[3], 2)), '')) AS headword FROM x""".replace("ps[1]", r"'^([^:=()]+):\s*(.+)$'").replace("ps[2]", r"'^([^:=()]+)=\s*(.+)$'").replace("ps[3]", r"'^([^()]+)\([^)]*\)\s*(.+)$'"))
def f24_reverse_entries(spark, sf_dir):
    """lines of the reverse section by three patterns in order."""
    put = F.when(F.col("p_partkey") % 4 == 0, ": ").when(F.col("p_partkey") % 4 == 1, " = ").when(F.col("p_partkey") % 4 == 2, " (s) ").otherwise(" ")
    got = X.reverse_entry(F.replace("p_name", F.lit(" "), put))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in got.items()))


_GRAMMAR = ["'The SVO order. Word order: '", "'Verb suffix '", "'Past tense: '", "'pronouns: '", "'The plural marker '", "'Negation: '"]
_GRAMMAR_TEXT = "list_extract([" + ", ".join(_GRAMMAR) + "], CAST(p_partkey % 6 AS INTEGER) + 1) || p_name || '. Possessive forms' || chr(10) || '(' || p_partkey || ') ' || p_type || chr(10) || ' \"' || p_brand || '\" ' || p_name || ' / ' || p_type"


@query(f"WITH t AS (SELECT p_partkey, {_GRAMMAR_TEXT} AS c FROM part), x AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, unnest(regexp_extract_all(c, '{p}')) AS text FROM t" for k, p in vocab.GRAMMAR_RULES) + ") SELECT p_partkey, kind, trim(text)[:200] AS text FROM x")
def f25_grammar_rules(spark, sf_dir):
    """statements of grammar texts, tagged by what they are about."""
    return _grammar(spark, sf_dir).select("p_partkey", F.inline(X.tagged_examples(F.col("c"))))


@query(f"WITH t AS (SELECT p_partkey, {_GRAMMAR_TEXT} AS c FROM part), x AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, unnest(regexp_extract_all(c, '{p.replace(chr(39), chr(39) * 2)}', {2 if k == 'numbered' else 1})) AS tol, unnest(regexp_extract_all(c, '{p.replace(chr(39), chr(39) * 2)}', {3 if k == 'numbered' else 2})) AS translation FROM t" for k, p in vocab.GRAMMAR_EXAMPLES) + ") SELECT p_partkey, kind, trim(tol) AS tol, trim(translation) AS translation FROM x")
def f25_grammar_examples(spark, sf_dir):
    """bilingual examples of grammar texts, of three forms."""
    return _grammar(spark, sf_dir).select("p_partkey", F.inline(X.bilingual_examples(F.col("c"))))


def _grammar(spark, sf_dir) -> DataFrame:
    lead = F.element_at(F.array(*(F.lit(g.strip("'")) for g in _GRAMMAR)), (F.col("p_partkey") % 6 + 1).cast("int"))
    c = F.concat(lead, "p_name", F.lit(". Possessive forms\n("), "p_partkey", F.lit(") "), "p_type", F.lit('\n "'), "p_brand", F.lit('" '), "p_name", F.lit(" / "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c"))


@query("SELECT p_partkey, least(0.8, 0.5 + 0.05 * p_size)::DOUBLE AS by_count, least(0.85, 0.4 + 0.5 * (p_size / 50.0::DOUBLE))::DOUBLE AS by_probability FROM part")
def f30_confidence(spark, sf_dir):
    """confidence by number and by probability."""
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", X.count_confidence(n).cast("double").alias("by_count"), X.probability_confidence(n / F.lit(50.0)).alias("by_probability"))


@query("SELECT event_id, CAST(trunc(greatest(-1.0, least(1.0, (value - 50) / 40)) * 32767) AS SMALLINT) AS sample FROM events")
def f44_pcm16(spark, sf_dir):
    """samples clamped and made 16-bit integers."""
    return table(spark, sf_dir, "events").select("event_id", X.pcm16((F.col("value") - 50) / 40).alias("sample"))


@query("SELECT count(*) AS n, true AS stamped FROM region")
def f43_stamped(spark, sf_dir):
    """rows stamped with the time of the query; the same for all rows, so that it can be checked."""
    rows = table(spark, sf_dir, "region").withColumn("created_at", F.current_timestamp())
    return rows.agg(F.count("*").alias("n"), (F.count_distinct("created_at") == 1).alias("stamped"))


# --- joins, counts, serving


@query("""
WITH known AS (SELECT ps AS k, s AS source, max(v) AS v FROM (SELECT l_partkey AS ps, l_returnflag AS s, l_quantity AS v FROM lineitem) WHERE s = 'R' GROUP BY ALL)
SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) ELSE v END AS filled FROM part LEFT JOIN known ON k = p_partkey""")
def j15_backfill_of_source(spark, sf_dir):
    """Empty columns filled by key from the rows of one source, of several the highest scored."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("filled"))
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("double").alias("filled"), (-F.col("l_quantity")).alias("rank"))
    return joins.backfill(rows, known, ["p_partkey"], "filled", ["rank"])


@query()
def j18_respelled(spark, sf_dir):
    """Benchmark texts word by word in the spelling of the documents' vocabulary, by the stricter rule; held against brute force in the tests."""
    known = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return joins.respelled(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text", known)


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'colors' WHEN contains(p_name, 'ring') THEN 'house' ELSE 'other' END AS category FROM part)
SELECT 'category' AS kind, category AS name, count(*) AS n FROM t GROUP BY category UNION ALL SELECT 'difficulty', CASE category WHEN 'colors' THEN '1' WHEN 'house' THEN '2' ELSE '3' END, count(*) FROM t GROUP BY 2""")
def a26_counts(spark, sf_dir):
    """Entries by difficulty and by category."""
    category = F.when(F.col("p_name").contains("red"), "colors").when(F.col("p_name").contains("ring"), "house").otherwise("other")
    rows = table(spark, sf_dir, "part").select(category.alias("category"))
    level = rows.select("category", X.difficulty(F.col("category"), F.lit("noun"), F.lit(4)).cast("string").alias("difficulty"))
    each = level.select(F.inline(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")), F.struct(F.lit("difficulty").alias("kind"), F.col("difficulty").alias("name")))))
    return each.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) AS segments FROM lineitem GROUP BY l_orderkey")
def a30_segments(spark, sf_dir):
    """The segments of a verse in the order of their names; a verse has few."""
    s = F.struct("l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(s)).alias("s"))
    return rows.select("l_orderkey", F.array_join(F.transform("s", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), " ").alias("segments"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_type), p_type, p_partkey) AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS p_type FROM part)")
def o04_folded_order(spark, sf_dir):
    """Entries numbered in the order of their folded heads."""
    head = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", head.alias("head")).withColumn("folded", F.lower("head"))
    return picks.number_rows(rows, ["folded", "head", "p_partkey"]).select("p_partkey", F.col("id").cast("long").alias("id"))


TEMPLATES = {"see": ("I see _", ["fire", "water"], 300), "hold": ("you hold _ now", ["stone"], 150), "go": ("we go to _", ["house", "river", "field"], 50)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}::BIGINT, true)" for k, (_, _, n) in TEMPLATES.items()) + ") t(template, n, filled)")
def o09_templates(spark, sf_dir):
    """So many sentences of each template, all blanks filled with one of its words."""
    rows = evaluate.template_sentences(spark, TEMPLATES)
    good = F.lit(False)
    for k, (form, words, _) in TEMPLATES.items():
        good = good | ((F.col("template") == k) & F.col("sentence").isin([form.replace("_", w) for w in words]))
    return rows.groupBy("template").agg(F.count("*").alias("n"), F.every(good).alias("filled"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' UNION SELECT conv_id, turn FROM conversations WHERE turn < 2")
def u04_pages(spark, sf_dir):
    """Pages that any pass has, each once."""
    c = table(spark, sf_dir, "conversations")
    return c.where("role = 'user'").select("conv_id", "turn").union(c.where("turn < 2").select("conv_id", "turn")).distinct()


@query("SELECT coalesce(r.k, l.k) AS k, coalesce(r.v, l.v) AS v FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size < 30) l FULL JOIN (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_size > 20) r ON l.k = r.k")
def u05_merge_right(spark, sf_dir):
    """Two maps merged, the right one wins."""
    p = table(spark, sf_dir, "part")
    return joins.merge_right(p.where("p_size < 30").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), p.where("p_size > 20").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v")), ["k"])


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), a AS (SELECT string_split(p_name, ' ')[1] AS w, min(p_type) AS v FROM part WHERE p_size > 25 GROUP BY 1), b AS (SELECT string_split(p_name, ' ')[2] AS w, min(p_brand) AS v FROM part GROUP BY 1)
SELECT w.w, coalesce(a.v, b.v) AS translation, CASE WHEN a.v IS NOT NULL THEN 'dictionary' WHEN b.v IS NOT NULL THEN 'inferred' ELSE 'not_found' END AS method FROM w LEFT JOIN a ON a.w = w.w LEFT JOIN b ON b.w = w.w""")
def t01_translate(spark, sf_dir):
    """Words looked up in a dictionary, then among inferred entries."""
    p = table(spark, sf_dir, "part").withColumn("w", F.split("p_name", " "))
    words = p.select(F.explode("w").alias("w")).distinct()
    return serve.translate_words(words, "w", p.where("p_size > 25").select(F.col("w")[0].alias("word"), F.col("p_type").alias("value")), p.where(F.size("w") > 1).select(F.col("w")[1].alias("word"), F.col("p_brand").alias("value")))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name <> '' AND p_type <> '' AND (p_partkey * 2654435761) % 100 < 15")
def t08_training_items(spark, sf_dir):
    """Items to train with, a repeatable sample."""
    return serve.training_items(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"], 100, 15)


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def t09_feedback(spark, sf_dir):
    """Feedback appended as JSON lines in batches and counted."""
    path, rows = folder(spark, "feedback"), table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    for k in range(2):
        sinks.append_jsonl(rows.where(F.coalesce(F.pmod("id", F.lit(2)), F.lit(0)) == k), path)
    return spark.read.schema("kind string, id long").json(path).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', 2) AS v FROM part)
SELECT p_partkey, w || ' ' || v AS query, CAST(CASE WHEN k = 0 THEN 1 ELSE greatest(p_partkey % 7, 1) END AS INTEGER) AS page, CAST(CASE WHEN k < 2 THEN 30 ELSE least(greatest(p_partkey % 200, 1), 100) END AS INTEGER) AS per_page FROM t""")
def s22_search_request(spark, sf_dir):
    """Search addresses read: query, page, rows a page."""
    p, k = F.col("p_partkey"), F.col("p_partkey") % 4
    w = F.split("p_name", " ")
    page = F.when(k == 0, "").otherwise(F.concat(F.lit("&page="), (p % 7).cast("string")))
    per = F.when(k < 2, "").otherwise(F.concat(F.lit("&per_page="), (p % 200).cast("string")))
    url = F.concat(F.lit("http://localhost/api/dict/search?q="), w[0], F.lit("+"), F.get(w, F.lit(1)), page, per)
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in serve.search_request(url).items()))
