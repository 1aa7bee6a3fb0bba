"""Queries over ordered rows and metrics, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.operators import metrics as mt, sequences as sq
from inkfield.plans import standins as st, views_sql as v
from inkfield.plans.registry import SQL, query, rounded
from inkfield.plans.views_sql import views

ORDER = ["at_us", "event_id"]


def _ink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("row", "v"), (20 + 4 * (F.col("vec_id") % 8)).alias("width"), F.lit(64).alias("rows")
    ).withColumn("count", F.greatest(F.lit(0), F.floor((F.col("v").cast("double") - 0.02) * 100)))


INK = """ink_v AS (
  SELECT vec_id, unnest(range(0, 64)) AS row, greatest(0, floor((CAST(unnest(embedding) AS DOUBLE) - 0.02) * 100)) AS n,
    20 + 4 * (vec_id % 8) AS width FROM embeddings),
active_v AS (
  SELECT *, greatest(1, floor(width * CAST(0.045 AS DOUBLE) + 0.5)) AS least_gap,
    lag(row) OVER (PARTITION BY vec_id ORDER BY row) AS before
  FROM ink_v WHERE n > greatest(1.0, width * CAST(0.03 AS DOUBLE))),
island_v AS (
  SELECT *, sum(CASE WHEN before IS NULL OR row - before - 1 >= least_gap THEN 1 ELSE 0 END)
    OVER (PARTITION BY vec_id ORDER BY row) AS island FROM active_v),
kept_v AS (
  SELECT vec_id, top, CASE WHEN 64 - bottom < least_gap THEN 64 ELSE bottom END AS bottom FROM (
    SELECT vec_id, island, min(row) AS top, max(row) + 1 AS bottom, any_value(least_gap) AS least_gap, any_value(width) AS width
    FROM island_v GROUP BY vec_id, island)
  WHERE CASE WHEN 64 - bottom < least_gap THEN 64 ELSE bottom END - top >= width * CAST(0.3 AS DOUBLE)),
segments_v AS (
  SELECT e.vec_id, coalesce(k.top, 0) AS top, coalesce(k.bottom, 64) AS bottom, 20 + 4 * (e.vec_id % 8) AS width
  FROM embeddings e LEFT JOIN kept_v k ON k.vec_id = e.vec_id)"""


@query
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.gap_segments(_ink_rows(spark, sf_dir), "vec_id")


SQL["gap_segments"] = views(INK) + "SELECT vec_id, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom, width FROM segments_v"


@query
def unroll_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sq.unroll_plan(sq.gap_segments(_ink_rows(spark, sf_dir), "vec_id"), "vec_id")
    return plan.select("vec_id", "top", "bottom", F.col("cell").cast("long"), F.col("target_x").cast("long"))


SQL["unroll_plan"] = views(INK) + """
SELECT vec_id, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom,
  row_number() OVER w - 1 AS cell, (row_number() OVER w - 1) * width AS target_x
FROM segments_v WINDOW w AS (PARTITION BY vec_id ORDER BY top)"""

SYMBOLS = v.EVENTS + """,
symbols_v AS (
  SELECT *, list_position(['view', 'click', 'error', 'purchase', 'signup'], event_type) - 1 AS class, value / 500 AS p FROM events_v),
steps_v AS (
  SELECT *, lag(class) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS before FROM symbols_v)"""


@query
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept steps per user with their mean probability and its log."""
    steps = st.symbols(spark, sf_dir).withColumn("class", F.col("raw_class") - 1)
    kept = sq.collapse_repeats(steps, "user_id", ORDER, st.event_bucket())
    per_user = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.avg("p").alias("mean_p"))
    read = kept.select("user_id", F.col("p").alias("probability"), F.lit(True).alias("read"))
    return rounded(per_user.join(mt.ctc_confidence(read, "user_id"), "user_id"))


SQL["ctc_collapse"] = views(SYMBOLS) + """
SELECT user_id, count(*) AS kept, round(1e-9 + avg(p), 6) AS mean_p, round(1e-9 + ln(avg(p)), 6) AS confidence
FROM steps_v WHERE class <> 0 AND class IS DISTINCT FROM before GROUP BY user_id"""


@query
def ctc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as 16 steps of 4 class scores: the kept classes as text and their mean score."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    lines = st.table(spark, sf_dir, "embeddings").select("vec_id", steps.alias("steps")).withColumn(
        "classes", F.transform("steps", sq.best_class)
    ).withColumn("kept", sq.collapse_array(F.col("classes")))
    text = F.array_join(F.transform("kept", lambda i: F.element_at("classes", i + 1).cast("string")), "")
    score = F.aggregate("kept", F.lit(0.0), lambda s, i: s + F.array_max(F.element_at("steps", i + 1)).cast("double"))
    return rounded(lines.select("vec_id", text.alias("text"), F.when(F.size("kept") > 0, score / F.size("kept")).otherwise(0.0).alias("score")))


SQL["ctc_lines"] = """WITH s AS (
  SELECT vec_id, unnest(range(0, 16)) AS i, embedding FROM embeddings),
b AS (SELECT vec_id, i, list_position(embedding[4*i+1:4*i+4], list_max(embedding[4*i+1:4*i+4])) - 1 AS c,
    CAST(list_max(embedding[4*i+1:4*i+4]) AS DOUBLE) AS p FROM s),
k AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM b)
SELECT e.vec_id, coalesce(t.text, '') AS text, coalesce(round(1e-9 + t.score, 6), 0.0) AS score FROM embeddings e LEFT JOIN (
  SELECT vec_id, string_agg(CAST(c AS VARCHAR), '' ORDER BY i) AS text, sum(p) / count(*) AS score
  FROM k WHERE c <> 0 AND c IS DISTINCT FROM before GROUP BY vec_id) t USING (vec_id)"""


@query
def repeat_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = st.symbols(spark, sf_dir).withColumn(
        "class", F.when(F.col("value") > 350, 3).when(F.col("value") < 5, 2).when(F.col("value") < 120, 7).otherwise(8)
    )
    return sq.repeat_guard(steps, "user_id", ORDER, st.event_bucket()).select("event_id", "user_id", F.col("place").cast("long"), "class")


SQL["repeat_guard"] = views(v.EVENTS) + """, s AS (
  SELECT event_id, user_id, at_us, CASE WHEN value > 350 THEN 3 WHEN value < 5 THEN 2 WHEN value < 120 THEN 7 ELSE 8 END AS class,
    row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS place FROM events_v),
g AS (SELECT *, place - row_number() OVER (PARTITION BY user_id, class ORDER BY place) AS island FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, class, island ORDER BY place) - 1
    + CASE WHEN class = 2 AND min(place) OVER (PARTITION BY user_id, class, island) = 1 THEN 1 ELSE 0 END AS repeats FROM g),
f AS (SELECT user_id, min(place) AS stop FROM r WHERE class = 3 OR repeats >= 16 GROUP BY user_id)
SELECT event_id, r.user_id, place, class FROM r LEFT JOIN f ON f.user_id = r.user_id
WHERE place < coalesce(stop, 301) AND place <= 300"""


@query
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = sq.reading_order(st.lines(spark, sf_dir), "page_id", "box_id")
    return ordered.select("page_id", "box_id", "vertical", F.col("position").cast("long"))


# Boxes of a page one after the other by centre; the rows opened so far are the state.
SQL["reading_order"] = views(v.LINES, """item_v AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY centre, box_id) AS i FROM (
    SELECT page_id, box_id, vertical, CASE WHEN vertical THEN x + w / 2 ELSE y + h / 2 END AS centre,
      CASE WHEN vertical THEN w ELSE h END AS thick, CASE WHEN vertical THEN y ELSE x END AS along FROM (
      SELECT *, 2 * count(*) FILTER (h > CAST(1.5 AS DOUBLE) * w) OVER (PARTITION BY page_id) >= count(*) OVER (PARTITION BY page_id) AS vertical
      FROM lines_v))),
fold_v AS (
  SELECT page_id, i, [{'c': centre, 't': thick}] AS held, CAST(1 AS BIGINT) AS slot FROM item_v WHERE i = 1
  UNION ALL
  SELECT page_id, i, CASE WHEN hit = 0 THEN list_append(held, {'c': centre, 't': thick})
      ELSE list_transform(held, lambda r, k: CASE WHEN k = hit THEN {'c': r.c, 't': least(r.t, thick)} ELSE r END) END,
    CAST(CASE WHEN hit = 0 THEN len(held) + 1 ELSE hit END AS BIGINT)
  FROM (SELECT f.page_id, n.i, f.held, n.centre, n.thick, coalesce(list_position(list_transform(f.held,
      lambda r: abs(n.centre - r.c) < CAST(0.5 AS DOUBLE) * least(n.thick, r.t)), TRUE), 0) AS hit
    FROM fold_v f JOIN item_v n ON n.page_id = f.page_id AND n.i = f.i + 1))""") + """
SELECT page_id, box_id, vertical, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN vertical THEN -slot ELSE slot END, along, box_id) - 1 AS position
FROM item_v JOIN fold_v USING (page_id, i)"""


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.lines(spark, sf_dir).selectExpr("page_id", "box_id", "x", "y", "w / 6 AS w", "2 * h AS h")


COLUMNS = v.LINES + """,
columns_v AS (SELECT page_id, box_id, x, y, w / 6 AS w, 2 * h AS h FROM lines_v),
tall_v AS (SELECT page_id FROM columns_v GROUP BY page_id
  HAVING count(*) >= 2 AND count(*) FILTER (h > 1.5 * w) >= CAST(0.6 AS DOUBLE) * count(*)),
line_v AS (
  SELECT *, h / greatest(1, w) AS chars, row_number() OVER (PARTITION BY page_id ORDER BY -(x + w / 2), box_id) AS i
  FROM columns_v WHERE page_id IN (SELECT page_id FROM tall_v)),
pack_v AS (
  SELECT page_id, i, box_id, chars AS held, 0 AS chunk FROM line_v WHERE i = 1
  UNION ALL
  SELECT l.page_id, l.i, l.box_id, CASE WHEN p.held + l.chars > 18 THEN 0.0 + l.chars ELSE p.held + l.chars END,
    CASE WHEN p.held + l.chars > 18 THEN p.chunk + 1 ELSE p.chunk END
  FROM pack_v p JOIN line_v l ON l.page_id = p.page_id AND l.i = p.i + 1),
chunks_v AS (SELECT * FROM pack_v WHERE page_id IN (SELECT page_id FROM pack_v GROUP BY page_id HAVING max(chunk) > 0))"""


@query
def column_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.column_packing(_columns(spark, sf_dir), "page_id", "box_id").select("page_id", "box_id", F.col("chunk").cast("long"))


SQL["column_pack"] = views(COLUMNS) + "SELECT page_id, box_id, CAST(chunk AS BIGINT) AS chunk FROM chunks_v"


@query
def chunk_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _columns(spark, sf_dir)
    return sq.chunk_boxes(lines, sq.column_packing(lines, "page_id", "box_id"), "page_id", "box_id").withColumn(
        "chunk", F.col("chunk").cast("long"))


SQL["chunk_boxes"] = views(COLUMNS) + """
SELECT c.page_id, CAST(c.chunk AS BIGINT) AS chunk, CAST(floor(min(l.x)) AS BIGINT) AS x0, CAST(floor(min(l.y)) AS BIGINT) AS y0,
  CAST(floor(max(l.x + l.w)) AS BIGINT) AS x1, CAST(floor(max(l.y + l.h)) AS BIGINT) AS y1
FROM chunks_v c JOIN line_v l ON l.page_id = c.page_id AND l.box_id = c.box_id GROUP BY ALL"""


@query
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = st.events(spark, sf_dir).select("user_id", "event_id", "value", (F.col("k") * 60).cast("long").alias("seconds"))
    return sq.running_best(epochs, "user_id", "event_id", "value", "seconds", 100_000, F.floor(F.col("event_id") / 512))


SQL["best_epoch"] = views(v.EVENTS) + """, e AS (
  SELECT user_id, event_id, value, sum(k * 60) OVER w AS elapsed,
    max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM events_v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, min(event_id) AS stop_at FROM e WHERE elapsed > 100000 GROUP BY user_id)
SELECT e.user_id, event_id, value, best IS NULL OR value > best AS is_best, stop_at, stop_at IS NULL OR event_id <= stop_at AS was_run
FROM e LEFT JOIN s ON s.user_id = e.user_id"""


@query
def lobe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertical = st.pages(spark, sf_dir).select("page_id", (F.col("language") == "ja").alias("vertical"))
    lobes = st.regions(spark, sf_dir).join(vertical, "page_id")
    return sq.lobe_order(lobes, "page_id", "box_id").select("box_id", F.col("position").cast("long"))


SQL["lobe_order"] = views(v.PAGES, v.REGIONS) + """
SELECT box_id, row_number() OVER (PARTITION BY r.page_id
  ORDER BY CASE WHEN language = 'ja' THEN -(x + w / 2) ELSE y + h / 2 END, box_id) - 1 AS position
FROM regions_v r JOIN pages_v p ON p.page_id = r.page_id"""


@query
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = st.events(spark, sf_dir).selectExpr("user_id", "-value / 100 AS log_prob", "k % 4 AS steps")
    return rounded(mt.mean_log_confidence(chunks, "user_id"))


SQL["confidence"] = views(v.EVENTS) + """
SELECT user_id, CASE WHEN sum(k % 4) > 0 THEN round(1e-9 + sum(-value / 100) / sum(k % 4), 6) ELSE 0.0 END AS confidence
FROM events_v GROUP BY user_id"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = st.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("cell", "v"))
    return cells.select(
        "vec_id", "label", "cell", (F.col("v").cast("double") * 8).alias("logit"), (F.col("v") > 0.05).alias("predicted"),
        ((F.col("cell") * 7 + F.col("vec_id")) % 5 == 0).cast("int").alias("target"), (F.col("cell") % 9 != 0).cast("int").alias("mask"),
    )


PREDICTIONS = """cells_v AS (
  SELECT vec_id, label, unnest(range(0, 64)) AS cell, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
predictions_v AS (
  SELECT vec_id, label, cell, e * 8 AS logit, e > CAST(CAST(0.05 AS FLOAT) AS DOUBLE) AS predicted,
    CASE WHEN (cell * 7 + vec_id) % 5 = 0 THEN 1 ELSE 0 END AS target, CASE WHEN cell % 9 <> 0 THEN 1 ELSE 0 END AS mask FROM cells_v)"""


@query
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mt.f1_report(_predictions(spark, sf_dir), ["label"]))


SQL["f1"] = views(PREDICTIONS) + """, c AS (
  SELECT label, count(*) FILTER (predicted AND target = 1) AS tp, count(*) FILTER (predicted AND target = 0) AS fp,
    count(*) FILTER (NOT predicted AND target = 1) AS fn FROM predictions_v WHERE mask = 1 GROUP BY label),
p AS (SELECT *, tp / greatest(1, tp + fp) AS prec, tp / greatest(1, tp + fn) AS rec FROM c)
SELECT label, tp, fp, fn, round(1e-9 + prec, 6) AS precision, round(1e-9 + rec, 6) AS recall,
  round(1e-9 + 2 * prec * rec / greatest(1e-9, prec + rec), 6) AS f1 FROM p"""


@query
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mt.masked_loss(_predictions(spark, sf_dir), "vec_id"))


SQL["masked_loss"] = views(PREDICTIONS) + """, b AS (
  SELECT *, greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit))) AS bce, 1 / (1 + exp(-logit)) AS prob FROM predictions_v),
s AS (SELECT vec_id, sum(target * mask) AS n_pos, sum((1 - target) * mask) AS negs, sum(bce * target * mask) AS pos_loss,
    sum(prob * target * mask) AS hit, sum(prob * mask) AS ps, sum(target * mask) AS ts FROM b GROUP BY vec_id),
k AS (SELECT *, least(negs, 3 * greatest(n_pos, 1)) AS n_neg FROM s),
r AS (SELECT vec_id, bce, row_number() OVER (PARTITION BY vec_id ORDER BY bce DESC) AS place FROM b WHERE target = 0 AND mask = 1),
m AS (SELECT r.vec_id, sum(bce) AS neg_loss FROM r JOIN k ON k.vec_id = r.vec_id WHERE place <= n_neg GROUP BY r.vec_id),
o AS (SELECT k.vec_id, (pos_loss + coalesce(neg_loss, 0)) / greatest(1, n_pos + n_neg) AS bce,
    1 - (2 * hit + 1) / (ps + ts + 1) AS dice FROM k LEFT JOIN m ON m.vec_id = k.vec_id)
SELECT vec_id, round(1e-9 + bce, 6) AS bce, round(1e-9 + dice, 6) AS dice, round(1e-9 + bce + dice, 6) AS loss FROM o"""


@query
def store_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = st.table(spark, sf_dir, "pages").selectExpr(
        "regexp_extract(url, '^https?://([^/]+)', 1) AS bucket", "length(html) AS length",
        "CASE WHEN page_id % 3 = 0 THEN 0 WHEN page_id % 7 = 0 THEN NULL ELSE length(html) + 10 END AS declared",
    )
    usage = mt.store_usage(entries)
    return usage.withColumn("shown", mt.format_bytes(F.col("bytes")))


SQL["store_usage"] = """WITH e AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS bucket, length(html) AS n,
    CASE WHEN page_id % 3 = 0 THEN 0 WHEN page_id % 7 = 0 THEN NULL ELSE length(html) + 10 END AS declared FROM pages),
u AS (SELECT bucket, count(*) AS entries, CAST(sum(CASE WHEN declared > 0 THEN declared ELSE n END) AS BIGINT) AS bytes,
  bool_and(coalesce(declared > 0, false)) AS from_headers FROM e GROUP BY bucket)
SELECT *, CASE WHEN bytes < 1024 THEN bytes || ' B'
  WHEN bytes / 1024 < 10 THEN printf('%.1f KB', bytes / 1024) WHEN bytes / 1024 < 1024 THEN printf('%.0f KB', bytes / 1024)
  WHEN bytes / 1048576 < 10 THEN printf('%.1f MB', bytes / 1048576) ELSE printf('%.0f MB', bytes / 1048576) END AS shown
FROM u ORDER BY bytes DESC, bucket"""


@query
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = st.events(spark, sf_dir).selectExpr("user_id % 3 AS model", "event_type AS stage", "value AS ms", "k % 10 = 0 AS failed")
    return rounded(mt.timing_totals(timings), 4)


SQL["stage_timings"] = views(v.EVENTS) + """
SELECT user_id % 3 AS model, event_type AS stage, round(1e-9 + sum(value), 4) AS total_ms, round(1e-9 + avg(value), 4) AS mean_ms,
  count(*) FILTER (k % 10 = 0) AS failed, count(*) AS items FROM events_v GROUP BY ALL"""
