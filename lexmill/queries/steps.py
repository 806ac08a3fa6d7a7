"""Steps of the inventory that other modules' queries leave out: each calls the library's function on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill import vocab
from lexmill.functions import checks, text as X
from lexmill.operators import draws, joins, stats
from lexmill.plans import evaluate, serve
from lexmill.queries.corpus import CLEAN, LINES, PAIRS, SPLIT, STOP, WORDS, lines, turn_pairs
from lexmill.queries.registry import query, table
from lexmill.queries.rules import folder
from lexmill.queries.search import _NEXT, neighbours
from lexmill.sources import files, html, ranges, sinks

NAMES = vocab.STOP_EN + vocab.STOP_ES + vocab.PROPER_NOUNS
_ASCII = r"regexp_replace(line, '[^a-zA-Z\s]', '', 'g')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT w AS term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents) WHERE w NOT IN {STOP(NAMES)} AND length(w) > 2 GROUP BY w")
def p06_without_names(spark, sf_dir):
    """Words without stop words, proper nouns and short ones."""
    docs = table(spark, sf_dir, "documents").select(X.keep_words(X.tokens(F.col("text")), NAMES).alias("w"))
    return stats.term_counts(docs, "w")


@query(rf"""
WITH t AS (SELECT doc_id, pos, line, {_STRIP.format(_ASCII)} AS letters FROM {LINES}), u AS (SELECT *, {SPLIT.format('letters')} AS w FROM t)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, length({_STRIP.format('line')}) < 2 OR length(letters) < 2 OR (len(w) <= 2 AND len(list_filter(w, lambda x: length(x) <> 1)) = 0) AS english,
  length({_STRIP.format('line')}) < 1 OR regexp_matches(line, '^[0-9\s.,;:!?]+$') AS gloss FROM u""")
def p10_garbage(spark, sf_dir):
    """P10: the tests for English texts and for glosses on every line."""
    return lines(spark, sf_dir).select("doc_id", "pos", checks.garbage_english(F.col("line")).alias("english"), checks.garbage_gloss(F.col("line")).alias("gloss"))


_LETTER = "a-záéíóúüñ"


@query(f"SELECT w AS term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents WHERE lang = 'en') WHERE regexp_matches(w, '(^|[^{_LETTER}])[{_LETTER}]+(ed|ing|es|ied|ying)([^{_LETTER}]|$)') GROUP BY w")
def p13_verb_forms_en(spark, sf_dir):
    """Words of English texts that look like verb forms."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(X.tokens(F.col("text")).alias("w"))
    return stats.term_counts(docs, "w").where(F.col("term").rlike("(?U)" + vocab.VERB_EN))


@query(rf"""
WITH g AS (SELECT lower(trim(a)) AS gloss, min(b) AS value FROM {PAIRS} GROUP BY 1), k AS (SELECT a AS word, min(b) AS value FROM {_NEXT} GROUP BY a),
t AS (SELECT conv_id * 1000 + turn AS id, lower(trim(text)) AS t FROM conversations WHERE text IS NOT NULL),
w AS (SELECT id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM (SELECT id, {SPLIT.format('t')} AS ws FROM t WHERE t NOT IN (SELECT gloss FROM g)))
SELECT id, value AS text, 'whole' AS how, CAST(1 AS BIGINT) AS changed FROM t JOIN g ON gloss = t
UNION ALL SELECT id, string_agg(coalesce(value, word), ' ' ORDER BY pos), 'words', count(value) FROM w LEFT JOIN k USING (word) GROUP BY id HAVING count(value) > 0""")
def j12_whole_gloss(spark, sf_dir):
    """A turn that is known as a whole gets its answer, others the neighbour of each known word."""
    pairs = turn_pairs(spark, sf_dir)
    glosses = pairs.groupBy(F.lower(F.trim("a")).alias("gloss")).agg(F.min("b").alias("value"))
    known = neighbours(spark, sf_dir).groupBy(F.col("a").alias("word")).agg(F.min("b").alias("value"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return joins.whole_or_words(rows, "id", "text", glosses, known)


_STEM = "regexp_replace(regexp_replace({}, '\\.[^.]+$', ''), '[^A-Za-z0-9_-]+', '_', 'g')".replace("\\\\", "\\")


@query(f"""
WITH m AS (SELECT p_brand || ' ' || p_partkey || '.wav' AS file, p_name AS text FROM part WHERE p_size > 10), s AS (SELECT {_STEM.format("p_brand || ' ' || p_partkey || '.flac'")} AS stem, min('out/' || p_brand || ' ' || p_partkey || '.flac') AS path FROM part WHERE p_size < 40 GROUP BY 1)
SELECT file, text, path FROM m JOIN s ON stem = {_STEM.format('file')}""")
def j31_manifest(spark, sf_dir):
    """Lines of a manifest and the segments that are there, by file name; those without a segment are skipped."""
    p, path = table(spark, sf_dir, "part"), folder(spark, "manifest")
    name = lambda end: F.concat("p_brand", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(end))
    sinks.write_pipe(p.where("p_size > 10").select(name(".wav").alias("file"), F.col("p_name").alias("text")), path)
    segments = p.where("p_size < 40").select(F.concat(F.lit("out/"), name(".flac")).alias("path"))
    return joins.by_file(files.csv_rows(spark, path, "|"), segments, "file", "path").select("file", "text", "path")


@query(f"""
WITH t AS (SELECT list_distinct({WORDS.format('a')}) AS a, list_distinct({WORDS.format('b')}) AS b FROM {PAIRS})
SELECT w AS word, count(*) AS missed FROM (SELECT unnest(list_filter(b, lambda x: NOT list_contains(a, x))) AS w FROM t) GROUP BY w ORDER BY missed DESC, word LIMIT 20""")
def a27_missed_words(spark, sf_dir):
    """The twenty words that turns miss most often of their answers."""
    return evaluate.missed_words(turn_pairs(spark, sf_dir).select(X.tokens(F.col("a")).alias("a"), X.tokens(F.col("b")).alias("b")), "b", "a")


@query("""
WITH s AS (SELECT c_custkey, c_mktsegment AS value, 'direct' AS found_by, 0.95 AS c, 0 AS i FROM customer WHERE c_acctbal > 3000
  UNION ALL SELECT c_custkey, n_name, 'chain', 0.85, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT o_custkey, o_orderpriority, 'inferred', 0.65, 2 FROM orders WHERE o_totalprice > 200000),
b AS (SELECT * FROM s WHERE c_custkey IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY c_custkey, value ORDER BY c DESC, i) = 1)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY c DESC, value) AS INTEGER) AS rank, value, found_by, CAST(round(c * 100) AS INTEGER) AS percent FROM b""")
def o12_candidates(spark, sf_dir):
    """Every candidate of a key in order of confidence, in per cent."""
    c = table(spark, sf_dir, "customer")
    direct = c.where("c_acctbal > 3000").select("c_custkey", F.col("c_mktsegment").alias("value"))
    chain = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("value"))
    inferred = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("value")).distinct()
    return joins.candidates(c, "c_custkey", [("direct", direct, 0.95), ("chain", chain, 0.85), ("inferred", inferred, 0.65)])


_ASKED = (("ring", "en"), ("promo", "es"), ("brand#1", "tol"))
_COLUMNS = {"en": "p_name", "es": "p_type", "tol": "p_brand"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{lang}' AS lang, p_partkey, p_name, p_type, p_brand FROM part WHERE contains(lower({_COLUMNS[lang]}), '{q}') ORDER BY length({_COLUMNS[lang]}), {_COLUMNS[lang]}, {', '.join(c for c in ('p_partkey', 'p_name', 'p_type', 'p_brand') if c != _COLUMNS[lang])} LIMIT 50)" for q, lang in _ASKED))
def t02_lookup(spark, sf_dir):
    """A word looked up in one language, three requests; at most fifty entries each, the cut being the feature."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    parts = [serve.lookup(p, q.upper(), lang, _COLUMNS).select(F.lit(lang).alias("lang"), "p_partkey", "p_name", "p_type", "p_brand") for q, lang in _ASKED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id IS NOT NULL")
def s05_json_arrays(spark, sf_dir):
    """Files that hold one JSON array each, a hundred conversations a file, written and scanned."""
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").where("conv_id IS NOT NULL"), folder(spark, "arrays")
    arrays = rows.groupBy(F.floor(F.col("conv_id") / 100).alias("file")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("value"))  # a file's rows
    arrays.repartition("file").write.partitionBy("file").text(path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return files.json_entries(spark, path, kinds).select("conv_id", "turn", "text")


@query("""
WITH l AS (SELECT list_filter(list_transform(list_concat([upper(p_brand)], string_split(p_name, ' '), [' ' || p_type || ' ', '']), lambda x: lower(trim(x))), lambda x: x <> '') AS w FROM part)
SELECT DISTINCT w[1] AS word, s AS synonym FROM (SELECT w, unnest(w[2:]) AS s FROM l) WHERE w[1] <> s""")
def s10_adjacency_lines(spark, sf_dir):
    """Lines 'root,synonym,...' written and scanned as edges."""
    path = folder(spark, "adjacency")
    line = F.concat_ws(",", F.upper("p_brand"), F.replace("p_name", F.lit(" "), F.lit(",")), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return files.adjacency(spark.read.text(path))


@query("""
WITH g AS (SELECT p_partkey AS group_id, list_filter(list_transform(string_split(p_name || ', ' || p_type || ',' || p_brand || ',' || upper(p_name) || ', ', ','), lambda x: lower(trim(x))), lambda x: x <> '') AS t FROM part),
u AS (SELECT group_id, unnest(t) AS word, unnest(range(0, len(t))) AS i FROM g), f AS (SELECT group_id, word, min(i) AS i FROM u GROUP BY ALL)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY i) - 1 AS INTEGER) AS pos, word FROM f""")
def s11_group_members(spark, sf_dir):
    """Members of groups whose items may hold several terms parted by commas."""
    items = F.array(F.concat("p_name", F.lit(", "), "p_type"), F.col("p_brand"), F.concat(F.upper("p_name"), F.lit(", ")))
    return files.group_members(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("group_id"), items.alias("items")), "items")


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' ,, ' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS terms FROM part")
def f20_comma_terms(spark, sf_dir):
    """terms parted by commas."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.comma_terms(F.concat("p_name", F.lit(" ,, "), "p_type")), "|").alias("terms"))


@query("""
WITH t AS (SELECT conv_id * 1000 + turn AS id, role, trim(string_split(text, chr(10))[1]) AS gloss FROM conversations)
SELECT 'w' || id AS headword, role AS pos, gloss FROM t WHERE gloss <> '' UNION ALL SELECT 'w' || id, role, 'again' FROM t""")
def s12_records(spark, sf_dir):
    """Records parted by a line, whose state lines hold for the lines after them, written and scanned."""
    path = folder(spark, "records")
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), "role", F.get(F.split("text", "\n"), F.lit(0)).alias("line")).where("id IS NOT NULL AND role IS NOT NULL")
    c.select(F.concat(F.lit("w"), "id", F.lit("\npos: "), "role", F.lit("\ngloss: "), F.coalesce("line", F.lit("")), F.lit("\ngloss:again\n")).alias("value")).write.option("lineSep", "_____\n").text(path)
    return files.records(spark, path).where("gloss <> ''")


@query(r"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'bible_align:' || upper(left(p_type, 3)) || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':' || p_partkey % 50 END AS tag FROM part)
SELECT p_partkey, nullif(regexp_extract(tag, ':([A-Z0-9]{3})(\d{2,3}):(\d+)$', 1), '') AS book, CAST(nullif(regexp_extract(tag, ':([A-Z0-9]{3})(\d{2,3}):(\d+)$', 2), '') AS INTEGER) AS chapter, CAST(nullif(regexp_extract(tag, ':([A-Z0-9]{3})(\d{2,3}):(\d+)$', 3), '') AS INTEGER) AS verse FROM t""")
def f22_source_tag(spark, sf_dir):
    """book, chapter and verse of tags, nulls where a text is no tag."""
    tag = F.concat(F.lit("bible_align:"), F.upper(F.substring("p_type", 1, 3)), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(":"), (F.col("p_partkey") % 50).cast("string"))
    rows = table(spark, sf_dir, "part").withColumn("tag", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(tag))
    return rows.select("p_partkey", *(v.alias(k) for k, v in X.source_tag(F.col("tag")).items()))


@query(r"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(regexp_replace(line, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s.,;:''()-]', '', 'g')) AS DOUBLE) AS quality FROM " + LINES)
def f36_line_quality(spark, sf_dir):
    """the quality of every line."""
    return lines(spark, sf_dir).select("doc_id", "pos", X.line_quality(F.col("line")).alias("quality"))


@query("""
WITH s AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: (unicode(c) - 90) * 100) AS s FROM documents WHERE length(text) >= 80),
f AS (SELECT doc_id, unnest(range(0, len(s) // 80)) AS frame, s FROM s)
SELECT doc_id, CAST(frame AS INTEGER) AS frame, sqrt(list_sum(list_transform(s[frame * 80 + 1 : frame * 80 + 80], lambda x: CAST(x AS DOUBLE) * x)) / 80) AS rms FROM f""")
def f40_frames(spark, sf_dir):
    """the loudness of frames of 10 ms, of texts read as samples at 8 kHz."""
    samples = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: (F.ascii(c) - 90) * 100)
    audio = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(8000).alias("rate"), samples.alias("samples"))
    return files.frames(audio).select(F.col("path").alias("doc_id"), "frame", "rms")


_H = "md5('42:' || CAST(doc_id AS VARCHAR))[1:16]"


@query(f"SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL ORDER BY {_H}, doc_id LIMIT 100")
def o07_draw(spark, sf_dir):
    """A seeded draw of exactly a hundred texts, the draw being the feature."""
    return draws.draw(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query(f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents ORDER BY {_H}, doc_id LIMIT 1000)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n FROM d WHERE len(w) BETWEEN 20 AND 200 ORDER BY {_H}, doc_id LIMIT 50""")
def o08_accepted_draw(spark, sf_dir):
    """Fifty texts of 20 to 200 words, drawn by rejection in at most twenty times as many attempts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fits = lambda part: part.withColumn("n", F.size(X.tokens(F.col("text")))).where(F.col("n").between(20, 200)).select("doc_id", "n")
    return draws.draw_accepted(docs, "doc_id", 50, fits)


_LOUD = """(SELECT user_id, event_id // 4000 AS part, list(least(32767, CAST(trunc(value * 100) AS BIGINT) - 3000) ORDER BY event_id) AS s FROM events GROUP BY ALL)"""


@query(f"""
WITH f AS (SELECT user_id, part, s, unnest(range(0, len(s) // 10)) AS frame FROM {_LOUD})
SELECT user_id || '-' || part || '.wav' AS path, frame, CAST(1000 AS INTEGER) AS rate, sqrt(list_sum(list_transform(s[frame * 10 + 1 : frame * 10 + 10], lambda x: CAST(x AS DOUBLE) * x)) / 10) AS rms FROM f""")
def s16_wav_frames(spark, sf_dir):
    """Values of users written as WAV files of a few thousand samples and scanned frame by frame."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor(F.col("event_id") / 4000)).alias("part"), F.least(F.lit(32767), (F.col("value") * 100).cast("int") - 3000).alias("v"))
    held = e.groupBy("user_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("samples"))  # 4,000 samples at most
    path = folder(spark, "audio")
    part = F.col("part").cast("string")
    name = F.concat(part, F.lit("/"), F.col("user_id").cast("string"), F.lit("-"), part, F.lit(".wav"))  # a folder for each part, so that no folder grows with the table
    ranges.write_files(held.select(name.alias("name"), sinks.wav_bytes("samples", F.lit(1000)).alias("content")), path)
    return ranges.wav_frames(spark, path).withColumn("path", F.substring_index("path", "/", -1))


_BOOKS = [*vocab.NT_BOOKS, "GEN", "PSA"]
_CHAPTER = f"(list_value({', '.join(repr(b) for b in _BOOKS)}))[doc_id % {len(_BOOKS)} + 1]"


@query(rf"""
WITH d AS (SELECT doc_id, {_CHAPTER} AS book, doc_id // {len(_BOOKS)} % 199 + 1 AS chapter, 'l' || doc_id // {len(_BOOKS) * 199} AS lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT lang, book, chapter, unnest(range(1, len(ls) + 1)) AS verse, unnest(ls) AS line FROM d WHERE book NOT IN ('GEN', 'PSA'))
SELECT lang, book, CAST(chapter AS INTEGER) AS chapter, CAST(verse AS INTEGER) AS verse, {CLEAN.format('line')} AS text FROM x WHERE {CLEAN.format('line')} <> ''""")
def s04_corpus(spark, sf_dir):
    """Texts written as chapter files of 29 books in a folder a language, of which 27 books are read."""
    n, path = F.lit(len(_BOOKS)), folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    span = lambda line, i: F.concat(F.lit('<span class="verse" id="V">'), (i + 1).cast("string"), F.lit("&#160;</span>"), line)
    page = F.concat(F.array_join(F.transform(F.split("text", "\n"), span), " "), F.lit('<ul class="tnav">'))
    book = F.get(F.array(*map(F.lit, _BOOKS)), (F.col("doc_id") % n).cast("int"))
    chapter = F.format_string("%03d.htm", (F.expr(f"doc_id DIV {len(_BOOKS)}") % 199 + 1).cast("int"))
    lang = F.concat(F.lit("l"), F.expr(f"doc_id DIV {len(_BOOKS) * 199}").cast("string"))
    ranges.write_files(docs.select(F.concat(lang, F.lit("/"), book, chapter).alias("name"), F.encode(page, "UTF-8").alias("content")), path)
    langs = [r.l for r in docs.select(lang.alias("l")).distinct().collect()]  # one for 5,771 texts
    return html.read_corpus(spark, {x: f"{path}/{x}" for x in sorted(langs)}, books=vocab.NT_BOOKS)


@query("SELECT p_name AS source_word, p_type AS target FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) FROM part WHERE p_partkey % 2 = 1 AND len(string_split(p_name, ' ')) = 2")
def s08_pair_files(spark, sf_dir):
    """Files of pairs parted by a tab or by white space, written and scanned; lines without two fields are left out."""
    path = folder(spark, "pairs")
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("\t"), "p_type")).otherwise(F.col("p_name"))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return files.word_pairs(spark, path, ("source_word", "target"))


_PHRASE_H = "md5('42:' || CAST(pair_id AS VARCHAR))[1:16]"
_NUMBER = lambda what: f"CAST(concat('0x', md5('42:{what}:' || CAST(pair_id AS VARCHAR))[1:12]) AS BIGINT)"
_BARE = r"list_filter(list_transform(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''), lambda w: trim(w, '.,;:!?')), lambda w: w <> '')"


@query(rf"""
WITH RECURSIVE p AS (SELECT pair_id, {_BARE.format('a')} AS a, {_BARE.format('b')} AS b FROM {PAIRS} ORDER BY {_PHRASE_H}, pair_id LIMIT 2000),
k AS (SELECT *, CAST({_NUMBER('length')} % 9 + 2 AS INTEGER) AS k FROM p), q AS (SELECT *, CAST({_NUMBER('place')} % (len(a) - k + 1) AS INTEGER) AS s FROM k WHERE len(a) >= k AND len(b) > 0),
c AS (SELECT pair_id, a[s + 1 : s + k] AS ph, b[len(b) * s // len(a) + 1 : len(b) * (s + k) // len(a)] AS ref FROM q),
d AS MATERIALIZED (SELECT * FROM c WHERE len(list_filter(ph, lambda w: length(w) <= 1)) = 0 ORDER BY {_PHRASE_H}, pair_id LIMIT 100),
g AS (SELECT lower(trim(a)) AS gloss, min(b) AS value FROM {PAIRS} GROUP BY 1), n AS (SELECT a AS word, min(b) AS value FROM {_NEXT} GROUP BY a),
w AS (SELECT pair_id, string_agg(coalesce(value, word), ' ' ORDER BY i) AS t, count(value) AS c FROM (SELECT pair_id, unnest(ph) AS word, unnest(range(0, len(ph))) AS i FROM d) LEFT JOIN n USING (word) GROUP BY pair_id),
o AS (SELECT d.pair_id, CASE WHEN g.value IS NOT NULL THEN 'whole' WHEN c > 0 THEN 'words' ELSE 'none' END AS how, coalesce(lower(g.value), w.t) AS t, coalesce(g.value, w.t) AS got, ref FROM d JOIN w USING (pair_id) LEFT JOIN g ON gloss = array_to_string(ph, ' ')),
t AS MATERIALIZED (SELECT pair_id, how, list_filter(regexp_split_to_array(got, '\s+'), lambda x: length(x) > 1) AS a, list_filter(ref, lambda x: length(x) > 1) AS b FROM o),
r AS (SELECT pair_id, CAST(0 AS BIGINT) AS i, j, CAST(0 AS BIGINT) AS v FROM (SELECT pair_id, unnest(range(0, len(a) + 1)) AS j FROM t WHERE len(a) > 0 AND len(b) > 0)
  UNION ALL SELECT pair_id, i + 1, j, max(CASE WHEN j > 0 AND w = a[j] THEN before + 1 ELSE v END) OVER (PARTITION BY pair_id ORDER BY j) FROM
    (SELECT r.pair_id, r.i, r.j, r.v, t.a, t.b[r.i + 1] AS w, lag(r.v) OVER (PARTITION BY r.pair_id ORDER BY r.j) AS before FROM r JOIN t USING (pair_id) WHERE r.i < len(t.b))),
l AS (SELECT pair_id, max(v) AS m FROM r GROUP BY pair_id)
SELECT pair_id, how, CAST(len(b) AS INTEGER) AS word_count, CASE WHEN len(a) > 0 AND len(b) > 0 THEN m::DOUBLE / len(b) ELSE 0.0 END AS lcs, coalesce(len(list_filter(b, lambda x: list_contains(a, x)))::DOUBLE / nullif(len(b), 0), 0.0) AS bow
FROM t LEFT JOIN l USING (pair_id)""")
def x03_evaluation(spark, sf_dir):
    """O08 F33 F34 J12 end to end: a hundred phrases drawn from turns, translated and scored against their answers, the draw being the feature."""
    pairs = turn_pairs(spark, sf_dir)
    glosses = pairs.groupBy(F.lower(F.trim("a")).alias("gloss")).agg(F.min("b").alias("value"))
    known = neighbours(spark, sf_dir).groupBy(F.col("a").alias("word")).agg(F.min("b").alias("value"))
    phrases = evaluate.sampled_phrases(pairs.select("pair_id", X.bare_words(F.col("a")).alias("a"), X.bare_words(F.col("b")).alias("b")), "pair_id", "a", "b", 100)
    return evaluate.evaluation(phrases, "pair_id", glosses, known)


_KEYWORDS = f"(SELECT w AS word, 'c' || length(w) % 7 AS category, min(item_id) AS o FROM (SELECT item_id, unnest({WORDS.format('text')}) AS w FROM benchmark) GROUP BY w)"


@query(f"""
WITH d AS (SELECT doc_id, unnest(list_distinct({WORDS.format('text')})) AS word FROM documents), b AS (SELECT doc_id, min(struct_pack(o := o, c := category)).c AS category FROM d JOIN {_KEYWORDS} USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(category, 'other') AS category FROM documents LEFT JOIN b USING (doc_id)""")
def f27_first_category(spark, sf_dir):
    """The first category of each text by a table of keywords, all words of the benchmark."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.tokens(F.col("text"))).alias("word"))
    keywords = words.groupBy("word").agg(F.min("item_id").alias("o")).withColumn("category", F.concat(F.lit("c"), (F.length("word") % 7).cast("string")))
    return joins.first_category(table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w")), "doc_id", "w", keywords, "o")


@query("""
SELECT l_orderkey AS path, l_linenumber AS name, CAST(2 * (least(900, l_linenumber * 30 * 8 + 240) - least(900, l_linenumber * 30 * 8)) + 44 AS INTEGER) AS n_bytes FROM lineitem WHERE least(900, l_linenumber * 30 * 8 + 240) > least(900, l_linenumber * 30 * 8) AND l_orderkey IS NOT NULL""")
def k12_segments(spark, sf_dir):
    """Segments cut out of sounds of 900 samples, an order each, as WAV files; what lies behind a sound's end is cut off."""
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("name"))
    audio = orders.select("path").distinct().select("path", F.lit(8000).alias("rate"), F.transform(F.sequence(F.lit(1), F.lit(900)), lambda i: (i * 7 + F.col("path").cast("int") % 100) % 2000 - 1000).alias("samples"))
    cuts = orders.select("path", "name", (F.col("name") * 30).cast("long").alias("start_ms"), (F.col("name") * 30 + 30).cast("long").alias("end_ms"))
    return sinks.cut_segments(audio, cuts).select("path", "name", F.octet_length("content").alias("n_bytes"))
