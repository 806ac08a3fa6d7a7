"""Text: scans, cleaning, validation, n-grams, co-occurrence, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill import vocab
from lexmill.functions import checks, text as X
from lexmill.operators import em, stats
from lexmill.operators.durable import durable
from lexmill.operators.matching import warp_udf, word_bounds
from lexmill.operators.sequences import DictionaryPage
from lexmill.plans import evaluate, phrases, serve
from lexmill.queries.registry import query, table
from lexmill.sources import files, html

WORDS = "list_filter(regexp_extract_all(lower({}), '[a-záéíóúüñ'']+'), lambda w: length(w) > 1)"
SPLIT = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
LINES = "(SELECT doc_id, lang, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))"
STOP = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
CLEAN = "trim(regexp_replace(" + "".join("replace(" for _ in vocab.ENTITIES) + "regexp_replace({}, '<[^>]+>', '', 'g')" + "".join(f", '{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in vocab.ENTITIES) + r", '\s+', ' ', 'g'))"


def lines(spark, sf_dir) -> DataFrame:
    """doc_id, lang, pos, line."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def turn_pairs(spark, sf_dir) -> DataFrame:
    """pair_id, a, b: texts of a user's turn and the answer."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "a", "b")


PAIRS = "(SELECT x.conv_id * 1000 + x.turn AS pair_id, x.text AS a, y.text AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 AND x.role = 'user' AND y.role = 'assistant')"


@query(rf"""
WITH c AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS ps FROM pages),
x AS (SELECT page_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS p FROM c)
SELECT page_id, CAST(pos AS INTEGER) AS pos, {CLEAN.format('p')} AS text FROM x WHERE {CLEAN.format('p')} <> ''""")
def s01_page_paragraphs(spark, sf_dir):
    """Paragraphs of web pages."""
    return html.paragraphs(table(spark, sf_dir, "pages"), ["page_id"])


@query(rf"""
WITH x AS (SELECT doc_id, pos, {CLEAN.format('line')} AS text FROM {LINES}),
v AS (SELECT doc_id, CASE WHEN pos < 3 THEN pos + 1 ELSE pos + 2 END AS verse, text FROM x UNION ALL SELECT doc_id, 4, text FROM x WHERE pos = 2)
SELECT doc_id, CAST(verse AS INTEGER) AS verse, text FROM v WHERE text <> ''""")
def s02_verse_scan(spark, sf_dir):
    """Documents set as chapters with verse markup, the third label a range, scanned again."""
    number = lambda i: F.when(i < 2, (i + 1).cast("string")).when(i == 2, "3-4").otherwise((i + 2).cast("string"))
    span = lambda line, i: F.concat(F.lit('<span class="verse" id="V">'), number(i), F.lit("&#160;</span>"), line)
    pages = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array_join(F.transform(F.split("text", "\n"), span), " "), F.lit('<ul class="tnav">')).alias("value"))
    return html.verses(pages, ["doc_id"], merged="replicate")


@query("SELECT conv_id, CAST(turn AS INTEGER) AS page, text FROM conversations")
def s06_page_map(spark, sf_dir):
    """A JSON object from turn numbers to texts, written and read."""
    entry = F.struct(F.col("turn").cast("string"), F.col("text"))
    maps = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return maps.select("conv_id", F.explode(F.from_json("json", "map<string,string>")).alias("page", "text")).select("conv_id", F.col("page").cast("int").alias("page"), "text")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[1] END AS source_word, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE string_split(p_name, ' ')[2] END AS target FROM part")
def s08_pair_scan(spark, sf_dir):
    """Two fields of a line, parted by a tab or else by white space."""
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("\t"), "p_type")).otherwise(F.col("p_name"))
    a, b = files.pair_columns(line)
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("source_word"), b.alias("target"))


@query(r"""
WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 1)) AS target, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 2)) AS label FROM pages)
SELECT page_id, target, label FROM x""")
def s10_adjacency_explode(spark, sf_dir):
    """Links of pages as edges."""
    return html.links(table(spark, sf_dir, "pages"), ["page_id"])


@query(f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, last_value(CASE WHEN length(line) <= 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS header
FROM {LINES}""")
def s12_record_state(spark, sf_dir):
    """Short lines set a state that the lines after them carry."""
    from lexmill.operators.sequences import carry_forward

    return carry_forward(lines(spark, sf_dir), ["doc_id"], ["pos"], F.when(F.length("line") <= 40, F.col("line")), "header").select("doc_id", "pos", "header")


@query(f"""
WITH t AS (SELECT lang, {WORDS.format('text')} AS w FROM documents)
SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(list_filter(w, lambda x: x NOT IN {STOP(vocab.STOP_EN + vocab.STOP_ES)} AND length(x) > 2))) AS BIGINT) AS n_kept FROM t GROUP BY lang""")
def p06_token_filter(spark, sf_dir):
    """Words, and those left after stop words and short ones go."""
    w = X.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("lang", w.alias("w"))
    return rows.groupBy("lang").agg(F.sum(F.size("w")).alias("n_words"), F.sum(F.size(X.keep_words(F.col("w"), vocab.STOP_EN + vocab.STOP_ES))).alias("n_kept"))


@query(f"""
WITH t AS (SELECT doc_id, trim(line) AS t, {SPLIT.format("lower(trim(line))")} AS w, pos FROM {LINES})
SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(t) BETWEEN 2 AND 60 AND NOT regexp_matches(t, '[0-9]{{3,}}') AND NOT regexp_matches(t, '^[()\\[\\]]+$') AND NOT (starts_with(t, '(') AND ends_with(t, ')') AND NOT contains(t, ' '))
  AND len(list_distinct(list_filter(w, lambda x: x IN {STOP(vocab.INDICATORS)}))) < 2 AND NOT (len(w) > 3 AND len(list_distinct(list_filter(w, lambda x: x IN {STOP(vocab.INDICATORS)}))) >= 1) AND NOT regexp_matches(t, '^\\([mf]\\)') AS valid,
  length(t) < 2 OR length(t) > 100 OR regexp_matches(t, '^[0-9\\s.,;:!?]+$') AS garbage
FROM t""".replace("\\\\", "\\"))
def p07_valid_line(spark, sf_dir):
    """The word battery and the garbage test on every line (gloss: a constant)."""
    t = F.trim("line")
    return lines(spark, sf_dir).select("doc_id", "pos", checks.valid_word(t, F.lit("--")).alias("valid"), checks.garbage_headword(t).alias("garbage"))


@query(f"""
WITH t AS (SELECT doc_id, pos, {SPLIT.format('line')} AS w FROM {LINES})
SELECT doc_id, CAST(pos AS INTEGER) AS pos, len(w) >= 4 AND len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN {STOP(vocab.STOP_ES)})) >= 2 AS spanish FROM t""")
def p11_function_word_sentence(spark, sf_dir):
    """Lines of four words or more with two function words."""
    return lines(spark, sf_dir).select("doc_id", "pos", checks.function_word_sentence(F.col("line"), vocab.STOP_ES).alias("spanish"))


_ENDS = " OR ".join(f"(ends_with(w, '{s}') AND length(w) > {len(s) + 2})" for s in vocab.VERB_SUFFIXES_ES)


@query(f"SELECT w AS term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents WHERE lang = 'es') WHERE {_ENDS} GROUP BY w")
def p13_verb_forms(spark, sf_dir):
    """Words of Spanish texts that end like verbs."""
    docs = table(spark, sf_dir, "documents").where("lang = 'es'").select(X.tokens(F.col("text")).alias("w"))
    return stats.term_counts(docs, "w").where(checks.verb_form(F.col("term")))


@query(r"""
SELECT p_partkey, CASE WHEN length(p_name) / (p_size + 0.0) BETWEEN 0.3 AND 1.0 THEN 'good' ELSE 'suspect' END AS quality,
  printf('%s_%02d_v%03d.wav', p_brand, p_size, CAST(p_partkey % 1000 AS INTEGER)) AS file, least(CAST(trunc(p_retailprice * 22050 / 1000) AS BIGINT), 40000) AS sample FROM part""")
def p14_segment_columns(spark, sf_dir):
    """Quality bands, file names, sample numbers."""
    name = X.segment_name(F.col("p_brand"), F.col("p_size"), (F.col("p_partkey") % 1000).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", checks.segment_quality(F.col("p_size").cast("double"), F.length("p_name"), 0.3, 1.0).alias("quality"), name.alias("file"), X.to_samples(F.col("p_retailprice"), 22050, high=F.lit(40000)).alias("sample"))


_PHON = "replace(replace(replace(replace(replace(replace(w, 'tsj', 'ch'), 'tj', 'ch'), 'cj', 'ch'), 'pj', 'p'), 'ts''', 's'), 'ts', 's')"


@query(f"""
WITH w AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS w FROM documents)
SELECT w AS word, translate(replace({_PHON}, '''', ''), '{vocab.ACCENTS[0]}', '{vocab.ACCENTS[1]}') AS sound, translate(w, '{vocab.ACCENTS[0]}', '{vocab.ACCENTS[1]}') AS plain FROM w""")
def f15_ordered_rewrite(spark, sf_dir):
    """The vocabulary, as it sounds and without accents."""
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", X.phonetic(F.col("word")).alias("sound"), X.without_accents(F.col("word")).alias("plain"))


@query("""
WITH t AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)
SELECT p_partkey, a || '|' || 'to ' || b || '|' || b AS terms FROM t""")
def f18_gloss_terms(spark, sf_dir):
    """terms of a gloss with qualifiers, an article and a verb."""
    gloss = F.concat(F.lit("the "), "p_name", F.lit(" (rare); to "), "p_type", F.lit(" [x]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.gloss_terms(gloss), "|").alias("terms"))


@query("""
WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, lower(string_split(p_name, ' ')[1]) AS a, lower(string_split(p_name, ' ')[2]) AS b FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN a || '|' || b ELSE a || ' ' || b END AS keywords FROM t""")
def f19_keyword_rules(spark, sf_dir):
    """Keywords of glosses of four forms."""
    a, b, k = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_partkey") % 4
    gloss = F.when(k == 0, F.concat(F.lit("I "), a, F.lit(" it very well."))).when(k == 1, F.concat(F.lit("the "), a, F.lit(" (old) "))).when(k == 2, F.concat(a, F.lit(": my "), b, F.lit(" is here"))).otherwise(F.col("p_name"))
    k1 = F.when(k == 1, F.concat(F.lit("the big "), a)).otherwise(gloss)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.keywords(k1), "|").alias("keywords"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'), '"''“”‘’ ')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, coalesce(s[1], '') AS opening FROM s""")
def f21_sentences(spark, sf_dir):
    """sentences of whole texts."""
    s = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("opening"))


@query(r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, CAST(nullif(regexp_extract(url, '/(\d+)', 1), '') AS INTEGER) AS number, url LIKE 'http%://%:%' OR url LIKE '%?%=%' AS has_query FROM pages""")
def f22_tag_parse(spark, sf_dir):
    """Parts of a tag by regular expressions."""
    get = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", get("^https?://([^/]+)/").alias("host"), get("^https?://[^/]+/([a-z]{2})/").alias("lang"), F.nullif(get(r"/(\d+)"), F.lit("")).cast("int").alias("number"), (F.col("url").like("http%://%:%") | F.col("url").like("%?%=%")).alias("has_query"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'verbo' WHEN 1 THEN 'Sustantivo' WHEN 2 THEN 'vi' WHEN 3 THEN 'adj' WHEN 4 THEN '' ELSE 'pron per' END AS raw, string_split(p_name, ' ') AS w FROM part),
u AS (SELECT p_partkey, CASE raw WHEN 'verbo' THEN 'verb' WHEN 'Sustantivo' THEN 'noun' WHEN 'vi' THEN 'verb' WHEN 'adj' THEN 'adjective' WHEN '' THEN 'other' ELSE 'pronoun' END AS pos,
  CASE WHEN list_has_any(w, ['red', 'blue', 'green']) THEN 'colors' WHEN list_has_any(w, ['ring', 'gear']) THEN 'house' ELSE 'other' END AS category, len(w) AS n FROM t)
SELECT p_partkey, pos, category, CASE WHEN category = 'colors' THEN 1 WHEN category = 'house' OR pos = 'verb' THEN 2 WHEN n > 3 THEN 3 ELSE 2 END AS difficulty FROM u""")
def f27_pos_ladder(spark, sf_dir):
    """Part of speech, first category in order, difficulty."""
    raw = F.element_at(F.array(*map(F.lit, ["verbo", "Sustantivo", "vi", "adj", "", "pron per"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    w = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", X.pos_name(raw).alias("pos"), X.semantic_category(w, {"colors": ["red", "blue", "green"], "house": ["ring", "gear"]}).alias("category"), F.size(w).alias("n"))
    return rows.select("p_partkey", "pos", "category", X.difficulty(F.col("category"), F.col("pos"), F.col("n")).alias("difficulty"))


@query()
def f32_fuzzy_match(spark, sf_dir):
    """Words of benchmark texts of two letters and more matched to the vocabulary of the documents; held against brute force in the tests."""
    from lexmill.operators.joins import fuzzy

    words = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    known = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return fuzzy(words, "word", known)


_BARE = r"list_filter(list_transform(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''), lambda w: trim(w, '.,;:!?')), lambda w: length(w) > 1)"


@query(f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT pair_id, {_BARE.format('a')} AS a, {_BARE.format('b')} AS b FROM {PAIRS}),
r AS (SELECT pair_id, CAST(0 AS BIGINT) AS i, j, CAST(0 AS BIGINT) AS v FROM (SELECT pair_id, unnest(range(0, len(a) + 1)) AS j FROM t WHERE len(a) > 0 AND len(b) > 0)
  UNION ALL SELECT pair_id, i + 1, j, max(CASE WHEN j > 0 AND w = a[j] THEN before + 1 ELSE v END) OVER (PARTITION BY pair_id ORDER BY j) FROM
    (SELECT r.pair_id, r.i, r.j, r.v, t.a, t.b[r.i + 1] AS w, lag(r.v) OVER (PARTITION BY r.pair_id ORDER BY r.j) AS before FROM r JOIN t USING (pair_id) WHERE r.i < len(t.b))),
l AS (SELECT pair_id, max(v) AS n FROM r GROUP BY pair_id)
SELECT t.pair_id, CAST(len(b) AS INTEGER) AS word_count, CASE WHEN len(a) > 0 AND len(b) > 0 THEN n::DOUBLE / len(b) ELSE 0.0 END AS lcs, coalesce(len(list_filter(b, lambda w: list_contains(a, w)))::DOUBLE / nullif(len(b), 0), 0.0) AS bow
FROM t LEFT JOIN l USING (pair_id)""")
def f33_lcs(spark, sf_dir):
    """Longest common subsequence of the words of a turn and its answer."""
    pairs = turn_pairs(spark, sf_dir).select("pair_id", X.bare_words(F.col("a")).alias("a"), X.bare_words(F.col("b")).alias("b"))
    return evaluate.scores(pairs, "a", "b").select("pair_id", "word_count", "lcs", "bow")


@query(f"""
WITH t AS (SELECT pair_id, {WORDS.format('a')} AS a, {WORDS.format('b')} AS b FROM {PAIRS})
SELECT pair_id, len(list_filter(a, lambda w: list_contains(b, w)))::DOUBLE / nullif(len(a), 0) AS overlap,
  CAST(len(list_filter(a, lambda w: list_contains(b, w) OR (length(w) >= 3 AND len(list_filter(b, lambda x: contains(x, w) OR contains(w, x))) > 0))) AS INTEGER) AS near FROM t""")
def f34_bow_overlap(spark, sf_dir):
    """Bag-of-words overlap, exact and tolerant."""
    rows = turn_pairs(spark, sf_dir).select("pair_id", X.tokens(F.col("a")).alias("a"), X.tokens(F.col("b")).alias("b"))
    return rows.select("pair_id", X.bag_overlap(F.col("a"), F.col("b")).alias("overlap"), X.tolerant_hits(F.col("a"), F.col("b")).alias("near"))


@query(f"""
WITH t AS (SELECT doc_id, {SPLIT.format('text')} AS w FROM documents), p AS (SELECT doc_id, w, unnest([0, 1, 2, 3]) AS i FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS part, CAST(len(w) * (i + 1) // 4 - len(w) * i // 4 AS INTEGER) AS n, sha256(array_to_string(w[len(w) * i // 4 + 1 : len(w) * (i + 1) // 4], ' ')) AS digest FROM p""")
def f41_word_slices(spark, sf_dir):
    """Each text's words in four proportional parts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.split_words(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    part = X.proportional_slice(F.col("w"), F.col("part"), F.lit(4))
    return rows.select("doc_id", "part", F.size(part).alias("n"), F.sha2(F.array_join(part, " "), 256).alias("digest"))


@query(rf"""
WITH t AS (SELECT {SPLIT.format("trim(lower(text))")} AS w FROM documents), g AS (
SELECT 1 AS n, unnest(w) AS gram FROM t UNION ALL SELECT 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t
UNION ALL SELECT 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM t)
SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram""")
def a05_ngrams(spark, sf_dir):
    """Word n-grams of whole texts, n = 1, 2, 3."""
    rows = table(spark, sf_dir, "documents").select(X.split_words(F.lower("text")).alias("w"))
    return stats.ngram_counts(rows, "w")


@query(f"""
WITH t AS (SELECT doc_id, pos, unnest({WORDS.format('line')}) AS term FROM {LINES}), c AS (SELECT doc_id, pos, term, count(*) AS c FROM t GROUP BY ALL)
SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM c GROUP BY term""")
def a06_doc_freq(spark, sf_dir):
    """Term and unit frequency of words over lines."""
    return stats.document_counts(lines(spark, sf_dir).select(X.tokens(F.col("line")).alias("w")), "w")


_UNITS = f"(SELECT pair_id, list_filter({WORDS.format('a')}, lambda x: x NOT IN {STOP(vocab.STOP_EN + vocab.STOP_ES)} AND length(x) > 2) AS aw, list_filter({WORDS.format('b')}, lambda x: x NOT IN {STOP(vocab.STOP_EN + vocab.STOP_ES)} AND length(x) > 2) AS bw FROM {PAIRS})"


def units(spark, sf_dir) -> DataFrame:
    keep = lambda c: X.keep_words(X.tokens(F.col(c)), vocab.STOP_EN + vocab.STOP_ES)
    return turn_pairs(spark, sf_dir).select("pair_id", keep("a").alias("aw"), keep("b").alias("bw"))


@query(f"""
WITH u AS (SELECT pair_id, list_distinct(list_transform(range(1, len(aw)), lambda i: aw[i] || ' ' || aw[i + 1])) AS g, list_distinct(bw) AS w FROM {_UNITS}),
a AS (SELECT pair_id, unnest(g) AS gram FROM u), b AS (SELECT pair_id, unnest(w) AS word FROM u),
an AS (SELECT gram, count(*) AS a_n FROM a GROUP BY gram), bn AS (SELECT word, count(*) AS b_n FROM b GROUP BY word),
p AS (SELECT gram, word, count(*) AS together FROM a JOIN b USING (pair_id) GROUP BY gram, word HAVING count(*) >= 2),
s AS (SELECT gram, word, together, a_n, b_n, 0.6 * (2.0::DOUBLE * together / (a_n + b_n)) + 0.4 * (least(a_n, b_n)::DOUBLE / greatest(a_n, b_n)) AS score FROM p JOIN an USING (gram) JOIN bn USING (word) WHERE 2.0 * together / (a_n + b_n) >= 0.15)
SELECT gram, word, together, a_n, b_n, score FROM s QUALIFY row_number() OVER (PARTITION BY gram ORDER BY score DESC, word) <= 2""")
def a07_cooccur_dice(spark, sf_dir):
    """J26 A07 F29 W01 G09, lifecycle of phrase mining: bigrams of one side with words of the other, the two best by score."""
    rows = units(spark, sf_dir).select("pair_id", X.ngrams(F.col("aw"), 2).alias("gram"), F.col("bw").alias("word"))
    return phrases.phrase_pairs(rows, "pair_id", "gram", "word", least=2)


@query(f"""
WITH u AS (SELECT pair_id, list_distinct(aw) AS aw, list_distinct(list_filter(bw, lambda w: regexp_matches(w, '(ed|ing|es)$'))) AS bw FROM {_UNITS}),
a AS (SELECT pair_id, len(bw) AS k, unnest(aw) AS tol FROM u), b AS (SELECT pair_id, len(aw) AS k, unnest(bw) AS verb FROM u),
an AS (SELECT tol, CAST(sum(k) AS BIGINT) AS a_n FROM a GROUP BY tol), bn AS (SELECT verb, CAST(sum(k) AS BIGINT) AS b_n FROM b GROUP BY verb)
SELECT tol, verb, count(*) AS together, any_value(a_n) AS a_n, any_value(b_n) AS b_n FROM a JOIN b USING (pair_id) JOIN an USING (tol) JOIN bn USING (verb) GROUP BY tol, verb HAVING count(*) >= 3""")
def a08_pair_marginal(spark, sf_dir):
    """Co-occurrence of words and verb forms with marginals counted per pair."""
    verbs = F.filter("bw", lambda w: w.rlike("(ed|ing|es)$"))
    return stats.cooccurrence(units(spark, sf_dir).select("pair_id", F.col("aw").alias("tol"), verbs.alias("verb")), "pair_id", "tol", "verb", 3, marginal="pair")


_SCORED = f"(SELECT lang, len({WORDS.format('text')}) % 10 AS k, coalesce(quality, 0) * 0.5 + (1 - coalesce(toxic, 0)) * 0.5 AS s FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"SELECT lang, k AS band, count(*) AS n, avg(s) AS mean_score, count(*) FILTER (s >= 1.0) AS perfect, count(*) FILTER (s >= 0.5) AS half, count(*) FILTER (s >= 0.25) AS quarter, count(*) FILTER (s > 0) AS some, count(*) FILTER (s = 0) AS none FROM {_SCORED} GROUP BY lang, k")
def a09_threshold_report(spark, sf_dir):
    """Counts above thresholds by language and word-count class."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    scored = rows.select("lang", (F.size(X.tokens(F.col("text"))) % 10).cast("long").alias("band"), (F.coalesce("quality", F.lit(0)) * 0.5 + (1 - F.coalesce("toxic", F.lit(0))) * 0.5).alias("s"))
    return evaluate.report(scored, ["lang", "band"], "s")


@query(f"""
WITH t AS (SELECT {WORDS.format('a')} AS a, {WORDS.format('b')} AS b FROM {PAIRS}), s AS (SELECT coalesce(len(list_filter(b, lambda w: list_contains(a, w)))::DOUBLE / nullif(len(b), 0), 0.0) AS s FROM t)
SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bucket, count(*) AS n FROM s GROUP BY 1""")
def a13_histogram(spark, sf_dir):
    """Histogram of overlap scores."""
    rows = turn_pairs(spark, sf_dir).select(X.tokens(F.col("a")).alias("a"), X.tokens(F.col("b")).alias("b"))
    return evaluate.histogram(rows.select(F.coalesce(X.bag_overlap(F.col("b"), F.col("a")), F.lit(0.0)).alias("bow")))


@query(f"""
WITH u AS (SELECT list_distinct(aw) AS aw, list_distinct(bw) AS bw FROM {_UNITS}),
e AS (SELECT aw, bw, unnest(aw) AS a_word FROM u), c AS (SELECT a_word, sha256(array_to_string(list_sort(list_filter(aw, lambda x: x <> a_word)), ' ')) AS context, unnest(bw) AS b_word FROM e)
SELECT a_word, b_word, context, count(*) AS cnt FROM c GROUP BY ALL""")
def a23_whole_contexts(spark, sf_dir):
    """Contexts of all turns and answers, by a digest of all the other words."""
    return stats.contexts(units(spark, sf_dir), "aw", "bw", top=None)


@query(f"""
WITH t AS (SELECT {SPLIT.format('line')} AS w FROM {LINES})
SELECT w[1] || ' ' || w[2] AS opening, w[-2] || ' ' || w[-1] AS ending, count(*) AS cnt FROM t WHERE len(w) >= 4 GROUP BY ALL""")
def a24_skeleton(spark, sf_dir):
    """First two and last two words of lines."""
    return stats.skeletons(lines(spark, sf_dir).select(X.split_words(F.col("line")).alias("w")), "w")


@query(f"""
WITH w AS (SELECT unnest({WORDS.format('text')}) AS w FROM documents), a(kind, affix) AS (VALUES ('prefix', 'th'), ('prefix', 'ver'), ('prefix', 'con'), ('suffix', 'tion'), ('suffix', 'ing'), ('suffix', 'heit'))
SELECT kind, affix, count(*) AS cnt FROM w, a WHERE CASE kind WHEN 'prefix' THEN starts_with(w, affix) ELSE ends_with(w, affix) END GROUP BY ALL""")
def a25_affixes(spark, sf_dir):
    """Counts of beginnings and endings over all words."""
    return stats.affix_counts(table(spark, sf_dir, "documents").select(X.tokens(F.col("text")).alias("w")), "w", ["th", "ver", "con"], ["tion", "ing", "heit"])


def _em_sql(rounds: int) -> str:
    """Rounds of expectation maximisation from a uniform start, which cancels out in the first."""
    steps = []
    for k in range(rounds):
        p, known = ("p", f"JOIN t{k} USING (en, tol)") if k else ("1", "")
        steps.append(f"z{k} AS (SELECT pair_id, tol, sum(m_en * {p}) AS z FROM occ {known} GROUP BY ALL)")
        steps.append(f"c{k} AS (SELECT en, tol, sum(m_tol * m_en * {p} / z) AS c FROM occ {known} JOIN z{k} USING (pair_id, tol) GROUP BY ALL)")
        steps.append(f"t{k + 1} AS MATERIALIZED (SELECT en, tol, c / sum(c) OVER (PARTITION BY en) AS p FROM c{k})")
    return f"""
WITH a AS (SELECT pair_id, unnest(list_filter({WORDS.format('a')}, lambda w: w NOT IN {STOP(vocab.STOP_EN + vocab.STOP_ES)})) AS en FROM {PAIRS}),
b AS (SELECT pair_id, unnest({WORDS.format('b')}) AS tol FROM {PAIRS}),
an AS (SELECT pair_id, en, count(*) AS m_en FROM a GROUP BY ALL), bn AS (SELECT pair_id, tol, count(*) AS m_tol FROM b GROUP BY ALL),
occ AS MATERIALIZED (SELECT * FROM an JOIN bn USING (pair_id)),
{', '.join(steps)}
SELECT en, tol, CAST(round(p * 1000000) AS BIGINT) AS p_millionths FROM t{rounds} WHERE round(p * 1000000) > 100000"""


@query(_em_sql(5))
def g01_em_all_words(spark, sf_dir):
    """Five rounds of IBM Model 1 over all words of more than one letter, the turns' without stop words."""
    content = F.filter(X.tokens(F.col("a")), lambda w: ~w.isin(list(vocab.STOP_EN + vocab.STOP_ES)))
    rows = turn_pairs(spark, sf_dir).select("pair_id", content.alias("aw"), X.tokens(F.col("b")).alias("bw"))
    t = em.model1(rows, "pair_id", "aw", "bw", least=0.1)
    return t.select("en", "tol", F.round(F.col("p") * 1_000_000).cast("long").alias("p_millionths")).where("p_millionths > 100000")


@query()
def g03_dtw(spark, sf_dir):
    """Characters of part names aligned with their brands and types by warping, and the bounds of each word."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat("p_type", F.lit(" "), "p_name")).alias("heard"), F.split("p_name", " ").alias("words"))
    # what is equal is aligned once: bounds depend on nothing but the two strings
    sides = rows.select("heard", "words").distinct().select(F.struct("heard", "words").alias("side"), "words", warp_udf("heard", F.array_join("words", "")).alias("pairs"))
    bounds = word_bounds(durable(sides), "side", "words", "pairs")
    of_side = bounds.groupBy("side").agg(F.array_sort(F.collect_list(F.struct("word_no", "word", "first_char", "last_char"))).alias("b"))  # of one name
    return rows.select("p_partkey", F.struct("heard", "words").alias("side")).join(of_side, "side").select("p_partkey", F.inline("b"))


@query()
def g06_dictionary_page(spark, sf_dir):
    """Entries of pages made of parts, a third of the headwords on a line of their own."""
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("\n("), "p_type", F.lit(") "), "p_brand")).otherwise(F.concat("p_name", F.lit(" ("), "p_type", F.lit(": x) "), "p_brand", F.lit("\nand more")))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return pages.lateralJoin(DictionaryPage(F.col("text").outer())).select("page", "line_no", "headword", "pos", "definition")


@query(f"SELECT w AS token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY ALL")
def g08_inverted_index(spark, sf_dir):
    """Postings of all words."""
    return serve.inverted_index(table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w")), "doc_id", "w")


@query(f"""
WITH w AS (SELECT lang, unnest({WORDS.format('text')}) AS w FROM documents), a AS (SELECT DISTINCT w FROM w WHERE lang = 'en'), b AS (SELECT DISTINCT w FROM w WHERE lang = 'es')
SELECT 'both' AS kind, w FROM (SELECT w FROM a INTERSECT SELECT w FROM b) UNION ALL SELECT 'en_only', w FROM (SELECT w FROM a EXCEPT SELECT w FROM b) UNION ALL SELECT 'either', w FROM (SELECT w FROM a UNION SELECT w FROM b)""")
def u01_set_ops(spark, sf_dir):
    """Vocabularies of two languages intersected, subtracted and united."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(X.tokens(F.col("text"))).alias("w")).distinct()
    a, b = words.where("lang = 'en'").select("w"), words.where("lang = 'es'").select("w")
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "w")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "en_only")).unionByName(tag(a.union(b).distinct(), "either"))


@query(rf"""
WITH t AS (SELECT doc_id, text, {SPLIT.format('text')} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, coalesce(list_aggregate(list_transform(w, lambda x: length(x)), 'max'), 0) AS longest, lower(coalesce(w[1], '')) AS first_word, coalesce(quality, 0) AS quality
FROM t LEFT JOIN labels USING (doc_id)""")
def f42_scalars(spark, sf_dir):
    """Length, case, coalesce, extrema per text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.split_words(F.col("text")).alias("w")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.size("w").alias("n_words"), F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)).cast("long").alias("longest"), F.lower(F.coalesce(F.get("w", F.lit(0)), F.lit(""))).alias("first_word"), F.coalesce("quality", F.lit(0)).alias("quality"))


@query(rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
j AS (SELECT doc_id, CASE WHEN len(s) > 1 AND NOT regexp_matches(s[-1], '[.!?]$') AND len({SPLIT.format('s[-1]')}) < 3 THEN list_append(s[1 : len(s) - 2], s[-2] || ' ' || s[-1]) ELSE s END AS s FROM s)
SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS sentence FROM j""")
def w17_sentence_carry(spark, sf_dir):
    """Sentences, a short fragment at the end joined to the one before."""
    s = X.carried_sentences(F.regexp_replace("text", "\n", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(s).alias("pos", "sentence"))


@query(f"""
WITH w AS (SELECT unnest({WORDS.format('text')}) AS w FROM documents), c AS (SELECT w AS term, count(*) AS n FROM w GROUP BY w)
SELECT term, n FROM (SELECT term, n FROM c ORDER BY n DESC, term LIMIT 200) WHERE term NOT IN (SELECT unnest({WORDS.format('text')}) FROM benchmark)""")
def j21_missing_words(spark, sf_dir):
    """Of the 200 commonest words those that no benchmark text has."""
    from lexmill.operators.joins import missing_words

    counts = stats.term_counts(table(spark, sf_dir, "documents").select(X.tokens(F.col("text")).alias("w")), "w")
    known = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term"))
    return missing_words(counts, "term", [known], 200)


