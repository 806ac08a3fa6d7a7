"""Ordered rows: windows, islands, segmentation, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from lexmill.functions import text as X
from lexmill.operators import joins, matching as M, picks, sequences as S
from lexmill.operators.durable import shared_base
from lexmill.queries.corpus import LINES, lines
from lexmill.queries.registry import query, table
from lexmill.streaming import logs

USER = ["user_id"]
TIME = ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(line) AS n, length(next_line) AS next_n FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next_line FROM {LINES}) WHERE next_line IS NOT NULL")
def w05_adjacent_pairs(spark, sf_dir):
    """Neighbouring lines."""
    out = S.adjacent(lines(spark, sf_dir), ["doc_id"], ["pos"], "line")
    return out.select("doc_id", "pos", F.length("line").cast("long").alias("n"), F.length("next_value").cast("long").alias("next_n"))


@query(f"""
WITH c AS (SELECT *, coalesce(event_type IN ('view', 'click') AND lead(event_type) {OVER} IN ('click', 'purchase'), false) AS p, lead(event_id) {OVER} AS next_id FROM events),
s AS (SELECT *, CASE WHEN p AND NOT coalesce(lag(p) {OVER}, false) THEN 1 ELSE 0 END AS s FROM c), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT event_id, next_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS i FROM r WHERE p) WHERE i % 2 = 1""")
def w06_consumed_pairs(spark, sf_dir):
    """Pairs of neighbours that use both rows up."""
    opens, closes = F.col("event_type").isin("view", "click"), F.col("event_type").isin("click", "purchase")
    return S.consumed_pairs(events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), USER, TIME, "event_id", opens, closes).select("event_id", F.col("next_value").alias("next_id"))


@query(f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
  CAST(floor(60000.0::DOUBLE * sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(length(line)) OVER (PARTITION BY doc_id)) AS BIGINT) AS target FROM {LINES} WHERE line <> ''""")
def w10_running_targets(spark, sf_dir):
    """Running sizes, and times in proportion to them."""
    rows = lines(spark, sf_dir).where("line <> ''").select("doc_id", "pos", F.length("line").alias("n"))
    return S.proportional_targets(rows, ["doc_id"], ["pos"], "n", F.lit(60000.0)).select("doc_id", "pos", "cum", "target")


@query("""
WITH v AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM v""")
def w12_gap_fill(spark, sf_dir):
    """Gaps filled from before, else from after."""
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("click", "view"), F.col("value")).alias("v"))
    return S.fill_gaps(rows, USER, TIME, "v").select("event_id", "filled")


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, row_number() OVER w AS i, CASE WHEN event_type IN ('click', 'purchase') THEN CAST(row_number() OVER w * 10 AS DOUBLE) END AS a, CASE WHEN event_id % 3 = 0 THEN CAST(row_number() OVER w * 10 + event_id % 8 AS DOUBLE) END AS z
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS MATERIALIZED (SELECT *, first_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM e),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 0.0::DOUBLE AS s, 0.0::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT n.user_id, n.i, n.event_id, coalesce(n.a, r.t), coalesce(n.z, coalesce(n.a, r.t) + (n.nx - coalesce(n.a, r.t)) / 2, coalesce(n.a, r.t)) FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, s AS filled_start, t AS filled_end FROM r WHERE i > 0""")
def w12_half_way(spark, sf_dir):
    """Spans with missing starts and ends, filled from the end before and half way to the next start."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 10
    e = events(spark, sf_dir).withColumn("p", place)
    spans = e.select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("click", "purchase"), F.col("p").cast("double")).alias("a"), F.when(F.col("event_id") % 3 == 0, (F.col("p") + F.col("event_id") % 8).cast("double")).alias("z"))
    return S.fill_spans(spans, USER, TIME, "a", "z").select("event_id", "filled_start", "filled_end")


_RUNS = f"""(SELECT user_id, island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, value < 10 AS inside, CASE WHEN value < 10 AND NOT coalesce(lag(value < 10) {OVER}, false) THEN 1 ELSE 0 END AS s FROM events)) WHERE inside GROUP BY user_id, island)"""


@query(f"SELECT user_id, CAST(island AS BIGINT) AS island, first_ts, last_ts, n FROM {_RUNS} WHERE n >= 3")
def w13_islands(spark, sf_dir):
    """Runs below a threshold of at least three rows."""
    out = S.islands(events(spark, sf_dir), USER, TIME, F.col("value") < 10, 3)
    return out.withColumnsRenamed({"first": "first_ts", "last": "last_ts"})


@query(f"SELECT user_id, arg_min(first_ts, -n * 1000000 + island) AS first_ts, max(n) AS n FROM {_RUNS} WHERE n >= 2 AND first_ts < TIMESTAMP '2024-02-01' GROUP BY user_id")
def w14_longest_run(spark, sf_dir):
    """Each user's longest run that starts in the first part, ties to the first."""
    runs = S.islands(events(spark, sf_dir), USER, TIME, F.col("value") < 10, 2)
    return S.longest_run(runs, USER, F.expr("timestamp'2024-02-01'"), after=None, least=2).select("user_id", F.col("first").alias("first_ts"), "n")


@query("""
WITH t AS (SELECT user_id, value, 0 AS tier FROM events WHERE value < 1 UNION ALL SELECT user_id, value, 1 FROM events WHERE value < 2 UNION ALL SELECT user_id, value, 2 FROM events WHERE value < 4),
c AS (SELECT user_id, tier, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT user_id, coalesce(min(tier) FILTER (n >= 5), 2) AS tier FROM c GROUP BY user_id)
SELECT user_id, CAST(tier AS INTEGER) AS tier, count(*) AS n, max(value) AS top FROM t JOIN p USING (user_id, tier) GROUP BY ALL""")
def w15_relax(spark, sf_dir):
    """The first of three thresholds that gives enough rows."""
    tiers = [F.col("value") < 1, F.col("value") < 2, F.col("value") < 4]
    out = picks.relax(events(spark, sf_dir).select("user_id", "value"), USER, tiers, F.count("*") >= 5)
    return out.groupBy("user_id", "tier").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"SELECT event_id, event_type FROM (SELECT *, lag(event_type) {OVER} AS b FROM events) WHERE (b IS NULL OR b <> event_type) AND event_type <> 'error'")
def w16_collapse_repeats(spark, sf_dir):
    """Repeats collapsed, blanks dropped."""
    return S.collapse_repeats(events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), USER, TIME, "event_type", "error").select("event_id", "event_type")


@query("""
WITH s AS (SELECT DISTINCT l_shipdate AS at FROM lineitem WHERE l_quantity > 49), t AS (SELECT DISTINCT o_orderdate AS at FROM orders WHERE o_orderpriority LIKE '1%')
SELECT epoch(t.at)::BIGINT AS target, (SELECT epoch(s.at)::BIGINT FROM s ORDER BY abs(epoch(s.at) - epoch(t.at)), s.at LIMIT 1) AS point FROM t""")
def j29_nearest(spark, sf_dir):
    """The nearest point to each target, found by as-of windows."""
    points = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.lit(1).alias("k"), F.unix_timestamp("l_shipdate").alias("point")).distinct()
    targets = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.lit(1).alias("k"), F.unix_timestamp("o_orderdate").alias("target")).distinct()
    return joins.nearest(targets, points, "k", "target", "point", width=30 * 86_400).select("target", "point")  # all rows have one key


@query(r"""
WITH s AS (SELECT doc_id, pos, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM s), w AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents))
SELECT w.doc_id, CAST(w.pos AS BIGINT) AS word_no, CAST(e.pos AS INTEGER) AS line_no, w.w AS word FROM w JOIN e ON e.doc_id = w.doc_id AND w.pos >= e.e - e.n AND w.pos < e.e""")
def j30_positional(spark, sf_dir):
    """Words and the lines they lie in, by running offsets."""
    spans = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("line_no"), F.size(X.split_words(F.col("line"))).cast("long").alias("n"))
    words = table(spark, sf_dir, "documents").select("doc_id", X.split_words(F.col("text")).alias("w"))
    out = joins.positional_arrays(spans, words, "doc_id", "line_no", "n", "w")
    return out.select("doc_id", F.col("pos").alias("word_no"), "line_no", "word")


@query("""
WITH v AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
m AS (SELECT user_id, event_type, value AS upper_median FROM v WHERE r = n // 2 + 1)
SELECT user_id, event_type, upper_median, avg(value) AS mean_value, sum(value) / 3600 AS hours, count(*) FILTER (value < 5) AS short FROM events JOIN m USING (user_id, event_type) GROUP BY ALL""")
def a14_upper_median(spark, sf_dir):
    """Upper median, mean, sum and bands of durations."""
    from lexmill.operators.stats import upper_median

    keys = ["user_id", "event_type"]
    e = events(spark, sf_dir)
    rest = e.groupBy(*keys).agg(F.avg("value").alias("mean_value"), (F.sum("value") / 3600).alias("hours"), F.count_if(F.col("value") < 5).alias("short"))
    return upper_median(e, keys, "value").join(rest, keys)


def timed(spark, sf_dir) -> DataFrame:
    """user_id, event_id, event_type, n, at: sizes of events, and times since the user's first one in milliseconds."""
    e = events(spark, sf_dir).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    low = e.groupBy("user_id").agg(F.min("ms").alias("low"))
    return e.join(low, "user_id").select("user_id", "event_id", "event_type", (F.col("value") * 10 + 1).cast("int").alias("n"), (F.col("ms") - F.col("low")).alias("at"))


@query()
def g02_dp_split(spark, sf_dir):
    """Boundaries by dynamic programming over streamed rows; held against brute force in the tests."""
    e = timed(spark, sf_dir)
    totals = e.groupBy("user_id").agg(F.max("at").alias("total_ms"))
    sizes = e.where("event_type = 'purchase'").select("user_id", "event_id", "n")
    return M.split_by_points(sizes, e.where("event_type <> 'view'").select("user_id", F.col("at").alias("point")), totals, "user_id", "event_id", "n", "point", "total_ms")


_TIMED = "(SELECT user_id, event_id, event_type, CAST(trunc(value * 10 + 1) AS BIGINT) AS n, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS ms FROM events)"


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_TIMED}), p AS (SELECT user_id, list(ms ORDER BY ms) AS free FROM e WHERE event_type <> 'view' GROUP BY user_id),
t AS MATERIALIZED (SELECT user_id, event_id, n * 1000000 AS target, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e WHERE event_type = 'purchase'),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS target, CAST(NULL AS BIGINT) AS point, free FROM p
  UNION ALL SELECT user_id, i, event_id, target, free[k], list_concat(free[1 : k - 1], free[k + 1 :]) FROM (SELECT r.user_id, t.i, t.event_id, t.target, r.free,
    list_position(r.free, list_sort(list_transform(r.free, lambda x: struct_pack(d := abs(x - t.target), x := x)))[1].x) AS k FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1))
SELECT user_id, event_id, target, point FROM r WHERE i > 0""")
def j28_nearest_unused(spark, sf_dir):
    """Each target takes the nearest point that is free."""
    e = timed(spark, sf_dir)
    targets = e.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("n").cast("long") * 1_000_000).alias("target"))
    return M.nearest_unused(targets, e.where("event_type <> 'view'").select("user_id", F.col("at").alias("point")), "user_id", "event_id", "target", "point")


@query()
def g04_sub_split(spark, sf_dir):
    """Texts read at 70 ms a character; those of more than 30 s are cut near the ends of lines, words in proportion; held against brute force in the tests."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.lit(0).cast("long").alias("start_ms"), (F.length("text") * 70).cast("long").alias("end_ms"), "text")
    each = lines(spark, sf_dir).select("doc_id", "pos", (F.length("line") + 1).alias("n"))
    ends = S.proportional_targets(each, ["doc_id"], ["pos"], "n", F.lit(1.0)).select("doc_id", (F.col("cum") * 70).cast("long").alias("point"))
    return M.sub_split(docs, ends, "doc_id", 30.0)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def x01_stream_window(spark, sf_dir):
    """Streaming extension: tumbling hours over a file stream with a watermark, all that is there worked off once."""
    e = events(spark, sf_dir)
    base = shared_base(spark)
    path = f"{base.rstrip('/')}/lexmill/windows-{uuid.uuid4().hex}"
    # the folder is listed and filtered by name, so that one file and a folder of files are both read
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    out = logs.windowed(stream, "ts", "value", ["event_type"])
    # complete mode returns the last windows too, which append mode holds back until the watermark passes them
    logs.rewrite_once(out, f"{path}/rows", f"{path}/progress")
    return spark.read.schema(out.schema).parquet(f"{path}/rows").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


_SESSIONS = """(SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WHERE value < 10))"""


@query(f"SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS end_ts, count(*) AS n FROM {_SESSIONS} GROUP BY user_id, k")
def x02_quiet_sessions(spark, sf_dir):
    """Streaming extension: runs of small values of a user, less than six hours apart, by session windows; here over all that is there, in the tests as a stream with late rows and a restart."""
    out = logs.quiet_runs(events(spark, sf_dir), "ts", F.col("value") < 10, USER, "6 hours")
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", stamp("first_ts"), stamp("end_ts"), "n")


@query(f"""
WITH e AS (SELECT *, coalesce(value < 10, false) AS inside FROM events),
s AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) {OVER}, false) THEN 1 ELSE 0 END AS s, lead(ts) {OVER} AS next_ts, lead(inside) {OVER} AS next_inside FROM e),
r AS (SELECT *, sum(s) {OVER[:-1]} ROWS UNBOUNDED PRECEDING) AS island FROM s),
g AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(CASE WHEN NOT next_inside THEN next_ts END) AS closed FROM r WHERE inside GROUP BY user_id, island)
SELECT user_id, first_ts, last_ts, n FROM g WHERE n >= 2 AND closed <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 HOUR""")
def x03_stream_runs(spark, sf_dir):
    """Streaming extension of W13: closed runs of small values of a user, by a state of each user with timers over a file stream, all that is there worked off once.

    Runs that no later row of the user ended before the watermark (two hours before the last event) are still open.
    """
    e = events(spark, sf_dir)
    path = f"{shared_base(spark).rstrip('/')}/lexmill/runs-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    out = logs.closed_runs(stream, "ts", "event_id", F.col("value") < 10, USER, 2)
    got = logs.drain(out, f"{path}/rows", f"{path}/progress")
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return got.select("user_id", stamp("first_ts"), stamp("last_ts"), "n")
