"""Label-set construction by name, each with its SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.operators import labels as lb, raster as rs
from inkfield.plans import standins as st, views_sql as v
from inkfield.plans.registry import SQL, query, rounded
from inkfield.plans.views_sql import views
from inkfield.session import cut_lineage

STORED_SIDE = 320  # the stand-in pages are small; a long side that really shrinks them

HELD_OUT = "held_v AS (SELECT o_orderkey AS page_id FROM orders WHERE o_orderpriority = '1-URGENT')"


@query
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.leaked(st.pages(spark, sf_dir), st.held_out(spark, sf_dir))


SQL["leak_guard"] = views(v.PAGES, HELD_OUT) + """
SELECT DISTINCT page_id FROM pages_v WHERE page_id IN (SELECT page_id FROM held_v)"""


@query
def drop_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.drop_leaked(st.pages(spark, sf_dir), st.held_out(spark, sf_dir)).select("page_id", "kind")


SQL["drop_leaked"] = views(v.PAGES, HELD_OUT) + """
SELECT page_id, kind FROM pages_v WHERE page_id NOT IN (SELECT page_id FROM held_v)"""


@query
def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    negatives = st.pages(spark, sf_dir).where("kind = 'negative'")
    return lb.shared_ids(negatives, st.regions(spark, sf_dir))


SQL["shared_ids"] = views(v.PAGES, v.REGIONS) + """
SELECT page_id FROM pages_v WHERE kind = 'negative' INTERSECT SELECT page_id FROM regions_v"""


@query
def leak_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.passage_matches(st.table(spark, sf_dir, "documents"), st.table(spark, sf_dir, "benchmark"))


SQL["leak_text"] = r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS t FROM documents),
b AS (SELECT item_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = st.lines(spark, sf_dir)
    text, ignore = lines.where("line_no <= 5"), lines.where("line_no > 5")
    return lb.label_boxes(st.pages(spark, sf_dir), text, ignore, lines, STORED_SIDE)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.label_pages(st.pages(spark, sf_dir), _boxes(spark, sf_dir), STORED_SIDE)


_BOXES = """stored_v AS (
  SELECT *, greatest(1, CAST(round_even(width * least(1.0, CAST(320 AS DOUBLE) / greatest(width, height)), 0) AS INT)) AS sw,
    greatest(1, CAST(round_even(height * least(1.0, CAST(320 AS DOUBLE) / greatest(width, height)), 0) AS INT)) AS sh FROM pages_v),
boxes_v AS (
  SELECT p.page_id, p.kind, p.reviewed, sw AS stored_width, sh AS stored_height, line_no,
    CASE WHEN p.kind = 'negative' THEN 'background' WHEN line_no <= 5 THEN 'text' ELSE 'ignore' END AS role,
    round(x * (sw / width) + 1e-9, 1) AS x, round(y * (sw / width) + 1e-9, 1) AS y,
    round(w * (sw / width) + 1e-9, 1) AS w, round(h * (sw / width) + 1e-9, 1) AS h
  FROM stored_v p JOIN lines_v l ON l.page_id = p.page_id)"""
_RECORDS = _BOXES + """,
records_v AS (
  SELECT p.page_id, p.kind, 'pages/' || p.page_id || '.jpg' AS file, sw AS width, sh AS height,
    p.kind = 'negative' OR p.reviewed AS reviewed, p.kind = 'negative' AS ignore_all,
    coalesce(t, 0) AS text_boxes, coalesce(i, 0) AS ignore_boxes, coalesce(b, 0) AS background_boxes
  FROM stored_v p LEFT JOIN (
    SELECT page_id, count(*) FILTER (role = 'text') AS t, count(*) FILTER (role = 'ignore') AS i,
      count(*) FILTER (role = 'background') AS b FROM boxes_v GROUP BY page_id) c ON c.page_id = p.page_id)"""


@query
def label_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_boxes(spark, sf_dir))


SQL["label_build"] = views(v.PAGES, v.LINES, _BOXES) + "SELECT * EXCLUDE (line_no) FROM boxes_v"


@query
def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


SQL["label_records"] = views(v.PAGES, v.LINES, _RECORDS) + "SELECT * FROM records_v"


@query
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    unread = st.table(spark, sf_dir, "orders").where("o_totalprice < 2000").selectExpr("o_orderkey AS page_id")
    return lb.build_summary(records.join(unread, "page_id", "left_anti"), unread)


SQL["build_summary"] = views(v.PAGES, v.LINES, _RECORDS) + """, unread_v AS (
  SELECT o_orderkey AS page_id FROM orders WHERE o_totalprice < 2000)
SELECT *, failed <= 0.02 * (pages + negatives + failed) AS within_budget FROM (
  SELECT count(*) FILTER (kind = 'page') AS pages, count(*) FILTER (kind = 'page' AND reviewed) AS reviewed,
    count(*) FILTER (kind <> 'page') AS negatives,
    CAST(sum(text_boxes) FILTER (kind = 'page') AS BIGINT) AS text_regions,
    CAST(sum(ignore_boxes) FILTER (kind = 'page') AS BIGINT) AS ignore_regions,
    (SELECT count(*) FROM unread_v) AS failed
  FROM records_v WHERE page_id NOT IN (SELECT page_id FROM unread_v))"""


@query
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the reviewed pages for validation."""
    records = _records(spark, sf_dir)
    count = records.where("kind = 'page' AND reviewed").count() // 20
    return lb.split(records, count, 7).select("page_id", "kind", "part")


SQL["split"] = views(v.PAGES, v.LINES, _RECORDS) + """, val_v AS (
  SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY md5(page_id || '-7'), page_id) AS r, count(*) OVER () AS n
    FROM records_v WHERE kind = 'page' AND reviewed) WHERE r <= n // 20)
SELECT page_id, kind, CASE WHEN page_id IN (SELECT page_id FROM val_v) THEN 'val' ELSE 'train' END AS part FROM records_v"""


EPOCH, SEED = 3, 11


@query
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = lb.crop_plan(_records(spark, sf_dir), _boxes(spark, sf_dir), EPOCH, SEED)
    return rounded(plan.select("page_id", "on_text", "sx", "sy", "vx0", "vy0", "vx1", "vy1",
                               F.col("x0").cast("long"), F.col("y0").cast("long")))


def _draw(step: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('-', page_id, {EPOCH}, {SEED}, '{step}')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def _anywhere(size: str, step: str, crop: int) -> str:
    return (f"least(0, {size} - {crop}) + floor({_draw(step)} * (greatest(0, {size} - {crop}) - least(0, {size} - {crop}) + 1))")


def _around(centre: str, step: str, crop: int) -> str:
    return f"trunc({centre} + (2 * {_draw(step)} - 1) * ({crop} / CAST(3 AS DOUBLE)) - {crop / 2})"


def _crop_views(name: str, crop: int, train: bool, input_size: int) -> str:
    """A view ``name`` of crops, over ``records_v`` and ``boxes_v``."""
    base = f"{input_size} / CAST(greatest(width, height) AS DOUBLE)"
    scale = f"{base} * (CAST(0.6 AS DOUBLE) + CAST(0.65 AS DOUBLE) * {_draw('scale')})" if train else base
    side = crop if train else input_size
    centre = "trunc(CASE WHEN {0} < " + str(side) + " THEN floor(({0} - " + str(side) + ") / 2) ELSE 0 END)"
    x0, y0, on_text = centre.format("sw"), centre.format("sh"), "FALSE"
    if train:
        on_text = f"(bx IS NOT NULL AND {_draw('text')} < 0.5)"
        x0 = f"CASE WHEN {on_text} THEN {_around('(bx + bw / 2) * sx', 'jx', crop)} ELSE {_anywhere('sw', 'ox', crop)} END"
        y0 = f"CASE WHEN {on_text} THEN {_around('(b_y + bh / 2) * sy', 'jy', crop)} ELSE {_anywhere('sh', 'oy', crop)} END"
    return f"""{name}_pick_v AS (
  SELECT page_id, x AS bx, y AS b_y, w AS bw, h AS bh FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY md5(concat_ws('-', page_id, {EPOCH}, {SEED}, x, y, w, h))) AS place
    FROM boxes_v WHERE role = 'text') WHERE place = 1),
{name}_sized_v AS (
  SELECT *, sw / CAST(width AS DOUBLE) AS sx, sh / CAST(height AS DOUBLE) AS sy FROM (
    SELECT page_id, width, height, ignore_all, greatest(1, CAST(round_even(width * ({scale}), 0) AS INT)) AS sw,
      greatest(1, CAST(round_even(height * ({scale}), 0) AS INT)) AS sh FROM records_v)),
{name} AS (
  SELECT *, greatest(0, -x0) AS vx0, greatest(0, -y0) AS vy0, least({side}, sw - x0) AS vx1, least({side}, sh - y0) AS vy1 FROM (
    SELECT page_id, ignore_all, {side} AS crop, sw, sh, sx, sy, {on_text} AS on_text,
      CAST({x0} AS BIGINT) AS x0, CAST({y0} AS BIGINT) AS y0
    FROM {name}_sized_v LEFT JOIN {name}_pick_v USING (page_id)))"""


SQL["crop_plan"] = views(v.PAGES, v.LINES, _RECORDS, _crop_views("crop_v", 768, True, 1280)) + """
SELECT page_id, on_text, round(1e-9 + sx, 6) AS sx, round(1e-9 + sy, 6) AS sy, CAST(vx0 AS INT) AS vx0, CAST(vy0 AS INT) AS vy0,
  CAST(vx1 AS INT) AS vx1, CAST(vy1 AS INT) AS vy1, x0, y0 FROM crop_v"""


def painted(layers: str) -> str:
    """View ``painted_v`` of the cells that boxes of a view reach, with target and mask."""
    reach = ("CASE WHEN (x + w - {0}) / 4 - (x + {0}) / 4 >= 1e-3 AND (y + h - {0}) / 4 - (y + {0}) / 4 >= 1e-3 THEN"
             " [greatest(0, floor((x + {0}) / 4)), greatest(0, floor((y + {0}) / 4)),"
             " least(columns, ceil((x + w - {0}) / 4)), least(rows, ceil((y + h - {0}) / 4))] END")
    return f"""reach_v AS (
  SELECT *, {reach.format("0")} AS o, {reach.format("((w * h) * CAST(0.84 AS DOUBLE) / greatest(1e-6, 2 * (w + h)))")} AS c
  FROM {layers} WHERE role <> 'page' OR ignore_all),
sided_v AS (SELECT *, role = 'text' AND coalesce(least(c[3] - c[1], c[4] - c[2]) >= 2, FALSE) AS core FROM reach_v
  WHERE o IS NOT NULL AND o[3] > o[1] AND o[4] > o[2]),
layer_v AS (
  SELECT page_id, o AS r, ord, 0 AS target, CASE role WHEN 'page' THEN 0 WHEN 'background' THEN 1 WHEN 'ignore' THEN 2 ELSE 3 END AS layer,
    CASE WHEN role = 'background' OR (core AND NOT ignore_all) THEN 1 ELSE 0 END AS mask FROM sided_v
  UNION ALL SELECT page_id, c, ord, 1, 4, 1 FROM sided_v WHERE core),
rows_v AS (SELECT *, unnest(range(CAST(r[2] AS BIGINT), CAST(r[4] AS BIGINT))) AS gy FROM layer_v),
spot_v AS (SELECT *, unnest(range(CAST(r[1] AS BIGINT), CAST(r[3] AS BIGINT))) AS gx FROM rows_v),
painted_v AS (SELECT page_id, gx, gy, max((layer, ord, target, mask)) AS top FROM spot_v GROUP BY page_id, gx, gy)"""


@query
def crop_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label targets of every record's crop, for training and for validation, counted; the stored pages are the input's size."""
    records, boxes = _records(spark, sf_dir), _boxes(spark, sf_dir)
    order = F.col("x").cast("long") * 4096 + F.col("y").cast("long")
    # A row a page and mode, made once: the draws in it are digests, which a filter on cells would make again for each of its terms.
    plan = cut_lineage(functools.reduce(DataFrame.unionByName, (
        lb.crop_plan(records, boxes, EPOCH, SEED, crop=CROP, train=train, input_size=STORED_SIDE).withColumn("train", F.lit(train)) for train in (True, False))))
    return rs.raster_digest(lb.crop_layers(records, boxes, plan, order, ["page_id", "train"]), ["page_id", "train"], "ord", 80)


CROP = 192


def _crop_counts(train: bool) -> str:
    return "(" + views(_crop_views("crop_v", CROP, train, STORED_SIDE), """all_v AS (
  SELECT c.page_id, role, x * sx - x0 AS x, y * sy - y0 AS y, w * sx AS w, h * sy AS h, ignore_all,
    CAST(trunc(x) AS BIGINT) * 4096 + CAST(trunc(y) AS BIGINT) AS ord, crop // 4 AS columns, crop // 4 AS rows
  FROM boxes_v b JOIN crop_v c ON c.page_id = b.page_id
  UNION ALL SELECT page_id, 'page', vx0, vy0, vx1 - vx0, vy1 - vy0, ignore_all, 0, crop // 4, crop // 4 FROM crop_v)""", painted("all_v")) + f"""
SELECT page_id, {train} AS train, CAST(sum(top[3]) AS BIGINT) AS core_cells, count(*) FILTER (top[4] = 0) AS masked_cells, count(*) AS cells,
  CAST(sum((gy * 80 + gx) * top[3]) AS BIGINT) AS core_sum, CAST(sum((gy * 80 + gx) * (1 - top[4])) AS BIGINT) AS masked_sum
FROM painted_v GROUP BY page_id)"""


SQL["crop_targets"] = views(v.PAGES, v.LINES, _RECORDS) + f"SELECT * FROM {_crop_counts(True)} UNION ALL SELECT * FROM {_crop_counts(False)}"
