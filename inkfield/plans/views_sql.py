"""The stand-in tables again, as ANSI SQL for the oracle side."""

PAGES = """pages_v AS (
  SELECT o_orderkey AS page_id,
    CASE o_custkey % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'zh' ELSE 'ko' END AS language,
    400 AS width, 500 AS height, o_orderstatus = 'F' AS reviewed,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'negative' ELSE 'page' END AS kind
  FROM orders)"""

LINES = """lines_v AS (
  SELECT l_orderkey AS page_id, l_linenumber AS line_no,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT),
      CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS box_id,
    CAST((l_partkey % 40) * 8 AS DOUBLE) AS x, CAST((l_suppkey % 50) * 8 AS DOUBLE) AS y,
    16 + 2 * l_quantity AS w, CAST(16 + 3 * (l_partkey % 30) AS DOUBLE) AS h,
    CASE l_returnflag WHEN 'A' THEN 'bubble' WHEN 'N' THEN 'sfx' ELSE 'caption' END AS kind,
    5 * l_tax AS dark_share
  FROM lineitem)"""

REGIONS = LINES + """,
regions_v AS (
  SELECT *, dark_share >= 0.25 AS dark FROM lines_v)"""

DETECTIONS = """detections_v AS (
  SELECT l_orderkey AS page_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT),
      CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS det_id,
    CAST((l_partkey % 40) * 8 + CASE WHEN l_linenumber <= 4 THEN (l_suppkey % 7) - 3 ELSE 40 + l_suppkey % 61 END AS DOUBLE) AS dx,
    CAST((l_suppkey % 50) * 8 + CASE WHEN l_linenumber <= 4 THEN (l_partkey % 5) - 2 ELSE 55 - l_partkey % 83 END AS DOUBLE) AS dy,
    (16 + 2 * l_quantity) * (CAST(0.6 AS DOUBLE) + 6 * l_discount) AS dw,
    (16 + 3 * (l_partkey % 30)) * (CAST(0.6 AS DOUBLE) + 8 * l_tax) AS dh,
    CAST((7 * l_partkey + 13 * l_suppkey) % 1000 AS DOUBLE) / 1000 AS score,
    l_linestatus AS model
  FROM lineitem)"""

# Every overlapping pair with its common area.
PAIRS = """pairs_v AS (
  SELECT * FROM (
    SELECT r.box_id, d.det_id, r.page_id, r.x, r.y, r.w, r.h, r.kind, r.dark, d.dx, d.dy, d.dw, d.dh, d.score, d.model,
      greatest(0.0, least(r.x + r.w, d.dx + d.dw) - greatest(r.x, d.dx))
        * greatest(0.0, least(r.y + r.h, d.dy + d.dh) - greatest(r.y, d.dy)) AS common
    FROM regions_v r JOIN detections_v d ON r.page_id = d.page_id)
  WHERE common > 0)"""

# Coverage by sample columns: per column merge the row intervals, then add up.
COVERAGE = """axis_v AS (
  SELECT *, greatest(1, least(CAST(round_even(w, 0) AS INT), 512)) AS nc,
    greatest(1, least(CAST(round_even(h, 0) AS INT), 512)) AS nr FROM pairs_v),
columns_v AS (
  SELECT *, unnest(range(0, nc)) AS c FROM axis_v),
inside_v AS (
  SELECT *, x + (c + CAST(0.5 AS DOUBLE)) * w / nc AS cx FROM columns_v),
rows_v AS (
  SELECT box_id, model, score, c, nc, nr,
    list_filter(range(0, nr), lambda i: y + (i + CAST(0.5 AS DOUBLE)) * h / nr >= dy
      AND y + (i + CAST(0.5 AS DOUBLE)) * h / nr <= dy + dh) AS hit
  FROM inside_v WHERE cx >= dx AND cx <= dx + dw),
spans_v AS (
  SELECT box_id, model, score, c, nc, nr, hit[1] AS r0, hit[len(hit)] AS r1 FROM rows_v WHERE len(hit) > 0),
cover_v AS (
  SELECT box_id, sum(part) / any_value(CAST(nc * nr AS DOUBLE)) AS coverage FROM (
    SELECT box_id, c, nc, nr,
      greatest(0, r1 - greatest(r0 - 1, coalesce(max(r1) OVER (PARTITION BY box_id, c ORDER BY r0, r1
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))) AS part
    FROM (SELECT DISTINCT box_id, c, nc, nr, r0, r1 FROM spans_v))
  GROUP BY box_id)"""

MEASURES = """measures_v AS (
  SELECT r.*, coalesce(v.coverage, 0.0) AS coverage, coalesce(m.best_iou, 0.0) AS best_iou,
    coalesce(m.pieces, 0) AS pieces, coalesce(m.single, 0.0) AS single, coalesce(m.touching, 0) AS touching
  FROM regions_v r
  LEFT JOIN (
    SELECT box_id, max(common / (dw * dh + w * h - common)) AS best_iou,
      count(*) FILTER (common / greatest(w * h, 1) > 0.05) AS pieces,
      max(common / (w * h)) AS single, count(*) AS touching
    FROM pairs_v GROUP BY box_id) m ON r.box_id = m.box_id
  LEFT JOIN cover_v v ON r.box_id = v.box_id)"""


EVENTS = """events_v AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    epoch_us(ts) AS at_us FROM events)"""

SETTINGS = EVENTS + """,
settings_v AS (
  SELECT event_id, user_id, at_us,
    CASE WHEN (event_id + 1) % 4 = 0 THEN NULL WHEN k % 10 = 9 THEN CAST('NaN' AS DOUBLE) ELSE value / 100 END AS threshold,
    CASE WHEN (event_id + 2) % 4 = 0 THEN NULL ELSE ['local', 'cloud', 'other'][k % 3 + 1] END AS provider,
    CASE WHEN (event_id + 3) % 4 = 0 THEN NULL WHEN k % 7 = 0 THEN ' ' ELSE concat(' key-', k % 5, ' ', chr(10)) END AS api_key,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE ['ja', 'zh', 'ko', 'xx'][k % 4 + 1] END AS source,
    CASE WHEN (event_id + 1) % 4 = 0 THEN NULL ELSE ['en', 'id'][k % 2 + 1] END AS target
  FROM events_v),
patches_v AS (
  SELECT event_id, user_id, at_us,
    CASE WHEN threshold IS NULL THEN NULL WHEN isnan(threshold) OR isinf(threshold) THEN 0.6
      ELSE least(0.95, greatest(0.05, threshold)) END AS threshold,
    CASE WHEN provider IS NULL OR provider IN ('local', 'cloud') THEN provider ELSE 'local' END AS provider,
    regexp_replace(api_key, '^\\s+|\\s+$', '', 'g') AS api_key,
    CASE WHEN source IS NULL OR source IN ('ja', 'zh', 'ko') THEN source ELSE 'ja' END AS source,
    CASE WHEN target IS NULL OR target IN ('en', 'id') THEN target ELSE 'en' END AS target
  FROM settings_v),
state_rows_v AS (
  SELECT event_id, user_id, at_us,
    coalesce(last_value(threshold IGNORE NULLS) OVER w, 0.6) AS threshold,
    coalesce(last_value(provider IGNORE NULLS) OVER w, 'local') AS provider,
    coalesce(last_value(api_key IGNORE NULLS) OVER w, '') AS api_key,
    coalesce(last_value(source IGNORE NULLS) OVER w, 'ja') AS source,
    coalesce(last_value(target IGNORE NULLS) OVER w, 'en') AS target
  FROM patches_v
  WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

TILES = """tiles_v AS (
  SELECT l_orderkey AS doc_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT),
      CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS tile_id,
    CAST(400 * (l_suppkey % 2) + l_partkey % 4 AS DOUBLE) AS x, CAST(150 * (l_linenumber - 1) AS DOUBLE) AS y,
    CAST(320 + l_partkey % 3 AS DOUBLE) AS w,
    CAST(CASE WHEN l_partkey % 11 = 0 THEN 450 WHEN l_partkey % 5 = 0 THEN 145 ELSE 150 END AS DOUBLE) AS h,
    CASE WHEN l_quantity < 3 THEN 1 ELSE 800 END AS natural_width,
    CASE WHEN l_quantity < 3 THEN 1 ELSE 600 END AS natural_height
  FROM lineitem)"""

# Per queried tile: its column, the seams broken in it, and the run it belongs to.
STRIPS = TILES + """,
column_v AS (
  SELECT q.tile_id AS query_id, q.doc_id, t.tile_id, t.x, t.y, t.w, t.h,
    lag(t.y + t.h) OVER (PARTITION BY q.tile_id ORDER BY t.y, t.tile_id) AS bottom_above
  FROM tiles_v q JOIN tiles_v t ON q.doc_id = t.doc_id AND abs(t.x - q.x) <= 2 AND abs(t.w - q.w) <= 2),
runs_v AS (
  SELECT *, sum(CASE WHEN bottom_above IS NULL OR abs(y - bottom_above) > 2 THEN 1 ELSE 0 END)
    OVER (PARTITION BY query_id ORDER BY y, tile_id) AS run,
    row_number() OVER (PARTITION BY query_id ORDER BY y, tile_id) AS place FROM column_v),
own_v AS (SELECT query_id, run, place FROM runs_v WHERE tile_id = query_id),
strips_v AS (
  SELECT o.query_id AS tile_id, any_value(r.doc_id) AS doc_id, count(*) AS tiles,
    any_value(o.place) - min(r.place) AS position,
    arg_max(r.y + r.h, r.place) - min(r.y) AS height
  FROM own_v o JOIN runs_v r ON r.query_id = o.query_id AND r.run = o.run
  GROUP BY o.query_id HAVING count(*) >= 3)"""

DRAWN = """drawn_v AS (
  SELECT o_orderkey AS doc_id, CAST(50 + 40 * (o_custkey % 17) AS DOUBLE) AS dx, CAST(40 * (o_custkey % 9) AS DOUBLE) AS dy,
    CAST(120 + o_custkey % 200 AS DOUBLE) AS dw, CAST(100 + o_custkey % 150 AS DOUBLE) AS dh FROM orders)"""

IMAGES = """images_v AS (
  SELECT o_orderkey AS doc_id, CAST(10 + o_custkey % 30 AS DOUBLE) AS "left", CAST(20 + o_custkey % 40 AS DOUBLE) AS top,
    CAST(300 + o_custkey % 100 AS DOUBLE) AS width, CAST(400 + o_custkey % 120 AS DOUBLE) AS height,
    CAST(o_custkey % 4 AS DOUBLE) AS border, CAST(o_custkey % 3 AS DOUBLE) AS padding,
    CAST(600 + o_custkey % 500 AS DOUBLE) AS natural_width, CAST(700 + o_custkey % 300 AS DOUBLE) AS natural_height,
    ['fill', 'contain', 'cover', 'none', 'scale-down'][o_orderkey % 5 + 1] AS object_fit,
    ['50%', 'left', 'bottom', '25%', '12px'][o_orderkey % 5 + 1] AS along_x,
    ['50%', 'top', 'right', '80%', 'auto'][o_custkey % 5 + 1] AS along_y
  FROM orders)"""


def views(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
