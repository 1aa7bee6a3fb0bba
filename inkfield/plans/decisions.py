"""Filters, routing, ranking, settings, strips and targets by name, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.operators import decide as de, sequences as sq, spatial as sp
from inkfield.plans import standins as st, views_sql as v
from inkfield.plans.registry import SQL, query, rounded
from inkfield.plans.views_sql import views



@query
def above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.above_threshold(st.detections(spark, sf_dir), de.DEFAULT_THRESHOLD).select("det_id", "score")


SQL["above_threshold"] = views(v.DETECTIONS) + "SELECT det_id, score FROM detections_v WHERE score >= 0.6::DOUBLE"


@query
def pages_without_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.pages_without_regions(st.pages(spark, sf_dir), st.detections(spark, sf_dir), 0.6).select("page_id", "language")


SQL["pages_without_regions"] = views(v.PAGES, v.DETECTIONS) + """
SELECT page_id, language FROM pages_v p
WHERE NOT EXISTS (SELECT 1 FROM detections_v d WHERE d.page_id = p.page_id AND d.score >= 0.6::DOUBLE)"""


@query
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.candidate_gate(st.tiles(spark, sf_dir)).select("tile_id", "doc_id")


SQL["candidate_gate"] = views(v.TILES) + """
SELECT tile_id, doc_id FROM tiles_v WHERE least(w, h) >= 300 AND greatest(w, h) >= 400
  AND natural_width > 1 AND natural_height > 1"""


@query
def settings_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = de.clean_settings(st.settings_patches(spark, sf_dir))
    return rounded(cleaned.select("event_id", *de.SETTING_FIELDS))


SQL["settings_clean"] = views(v.SETTINGS) + """
SELECT event_id, round(1e-9 + coalesce(threshold, 0.6), 6) AS threshold, coalesce(provider, 'local') AS provider,
  coalesce(api_key, '') AS api_key, coalesce(source, 'ja') AS source, coalesce(target, 'en') AS target FROM patches_v"""


@query
def settings_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(de.settings_state(st.settings_patches(spark, sf_dir), st.event_bucket()).drop("at_us"))


SQL["settings_state"] = views(v.SETTINGS) + """
SELECT event_id, user_id, round(1e-9 + threshold, 6) AS threshold, provider, api_key, source, target FROM state_rows_v"""


@query
def settings_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = de.settings_state(st.settings_patches(spark, sf_dir), st.event_bucket())
    return de.settings_changes(states, st.event_bucket())


SQL["settings_changes"] = views(v.SETTINGS) + """
SELECT event_id, user_id,
  coalesce((provider, api_key, source, target) <> lag((provider, api_key, source, target)) OVER w, false) AS rebuild,
  coalesce(source <> lag(source) OVER w, false) AS reload
FROM state_rows_v WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)"""


@query
def latest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = st.events(spark, sf_dir).withColumn("page", F.col("k") % 20)
    return de.latest_keys(touches, "user_id", "page", ["at_us", "event_id"])


SQL["latest_keys"] = views(v.EVENTS) + """
SELECT user_id, page, CAST(place AS INT) AS place FROM (
  SELECT user_id, page, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM (
    SELECT user_id, k % 20 AS page, max((at_us, event_id)) AS last FROM events_v GROUP BY ALL)) WHERE place <= 3"""


@query
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = st.detections(spark, sf_dir).selectExpr("det_id", "page_id", "dx - 20.25 AS x", "dy AS y", "dw AS w", "dh AS h")
    sized = boxes.join(st.pages(spark, sf_dir).select("page_id", "width", "height"), "page_id")
    clamped = de.clamp_boxes(sized, F.col("width"), F.col("height"))
    return clamped.select("det_id", *(F.col(c).cast("long").alias(c) for c in "xywh"))


SQL["clamped_boxes"] = views(v.PAGES, v.DETECTIONS) + """
SELECT det_id, CAST(l AS BIGINT) AS x, CAST(t AS BIGINT) AS y, CAST(r - l AS BIGINT) AS w, CAST(b - t AS BIGINT) AS h FROM (
  SELECT det_id, greatest(0, least(width, floor(dx - 20.25 + 0.5))) AS l, greatest(0, least(height, floor(dy + 0.5))) AS t,
    greatest(0, least(width, floor(dx - 20.25 + dw + 0.5))) AS r, greatest(0, least(height, floor(dy + dh + 0.5))) AS b
  FROM detections_v JOIN pages_v USING (page_id)) WHERE r - l >= 1 AND b - t >= 1"""


@query
def source_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = de.to_source_boxes(st.drawn(spark, sf_dir), st.images(spark, sf_dir))
    return boxes.select("doc_id", "clipped", *(F.col(c).cast("long").alias(c) for c in "xywh"))


SQL["source_boxes"] = views(v.DRAWN, v.IMAGES) + """, inner_v AS (
  SELECT *, width - 2 * border - 2 * padding AS iw, height - 2 * border - 2 * padding AS ih FROM images_v),
fit_v AS (
  SELECT *, CASE object_fit WHEN 'contain' THEN least(iw / natural_width, ih / natural_height)
      WHEN 'cover' THEN greatest(iw / natural_width, ih / natural_height) WHEN 'none' THEN 1.0
      WHEN 'scale-down' THEN least(1.0, least(iw / natural_width, ih / natural_height)) ELSE iw / natural_width END AS fx,
    CASE object_fit WHEN 'contain' THEN least(iw / natural_width, ih / natural_height)
      WHEN 'cover' THEN greatest(iw / natural_width, ih / natural_height) WHEN 'none' THEN 1.0
      WHEN 'scale-down' THEN least(1.0, least(iw / natural_width, ih / natural_height)) ELSE ih / natural_height END AS fy
  FROM inner_v WHERE iw > 0 AND ih > 0),
paint_v AS (
  SELECT *, natural_width * fx AS pw, natural_height * fy AS ph FROM fit_v),
place_v AS (
  SELECT *, "left" + border + padding + CASE along_x WHEN 'left' THEN 0 WHEN 'bottom' THEN iw - pw
      WHEN '50%' THEN (iw - pw) * 50 / 100 WHEN '25%' THEN (iw - pw) * 25 / 100 ELSE 12 END AS px,
    top + border + padding + CASE along_y WHEN 'top' THEN 0 WHEN 'right' THEN ih - ph
      WHEN '50%' THEN (ih - ph) * 50 / 100 WHEN '80%' THEN (ih - ph) * 80 / 100 ELSE (ih - ph) / 2 END AS py FROM paint_v),
raw_v AS (
  SELECT doc_id, natural_width AS nw, natural_height AS nh, (dx - px) * (natural_width / pw) AS l,
    (dy - py) * (natural_height / ph) AS t, (dx - px) * (natural_width / pw) + dw * (natural_width / pw) AS r,
    (dy - py) * (natural_height / ph) + dh * (natural_height / ph) AS b FROM drawn_v JOIN place_v USING (doc_id)),
clip_v AS (
  SELECT *, greatest(0, least(nw, l)) AS x0, greatest(0, least(nh, t)) AS y0, greatest(0, least(nw, r)) AS x1,
    greatest(0, least(nh, b)) AS y1 FROM raw_v)
SELECT doc_id, CAST(floor(x0 + 0.5) AS BIGINT) AS x, CAST(floor(y0 + 0.5) AS BIGINT) AS y,
  CAST(floor(x1 - x0 + 0.5) AS BIGINT) AS w, CAST(floor(y1 - y0 + 0.5) AS BIGINT) AS h,
  l < -1 OR t < -1 OR r > nw + 1 OR b > nh + 1 AS clipped
FROM clip_v WHERE x1 - x0 > 0 AND y1 - y0 > 0"""


@query
def weak_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = st.events(spark, sf_dir).selectExpr("event_id", "-value / 200 AS confidence")
    return rounded(de.weak_readings(readings))


SQL["weak_readings"] = views(v.EVENTS) + """
SELECT event_id, round(1e-9 + -value / 200, 6) AS confidence FROM events_v WHERE -value / 200 < -0.5"""


@query
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = st.lines(spark, sf_dir).withColumnRenamed("box_id", "region_id")
    fields = lines.selectExpr("region_id", "0.5 + dark_share AS coverage")
    balloons = lines.where("kind = 'bubble' AND dark_share < 0.1").select("region_id")
    return de.route_regions(lines, fields, balloons).groupBy("kind", "route").agg(F.count(F.lit(1)).alias("regions"))


SQL["routing"] = views(v.LINES) + """
SELECT kind, CASE WHEN kind = 'bubble' AND dark_share < 0.1 THEN 'fill' WHEN 0.5 + dark_share < 0.73::DOUBLE THEN 'label'
  ELSE 'erase' END AS route, count(*) AS regions FROM lines_v GROUP BY ALL"""


@query
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that cannot run and replies that failed, counted by reason."""
    events = st.events(spark, sf_dir).select("event_id", "k", (F.col("event_id") % 3 != 0).alias("webgpu"))
    settings = de.clean_settings(st.settings_patches(spark, sf_dir)).join(events, "event_id")
    requests = de.classify_requests(settings).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    replies = events.selectExpr(
        "element_at(array(400, 401, 403, 429, 500, 503, 404), k % 7 + 1) AS status",
        "CASE WHEN event_id % 2 = 0 THEN 'API key not valid' ELSE 'bad argument' END AS detail",
    )
    failed = de.classify_failures(replies).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return requests.select(F.lit("request").alias("stage"), "reason", "n").unionAll(
        failed.select(F.lit("reply"), "category", "n")
    )


SQL["failures"] = views(v.SETTINGS) + """
SELECT 'request' AS stage, CASE WHEN p = 'cloud' AND a = '' THEN 'no-api-key' WHEN p = 'cloud' THEN 'ok'
    WHEN t <> 'en' THEN 'cloud-only-target' WHEN event_id % 3 = 0 THEN 'no-webgpu' ELSE 'ok' END AS reason, count(*) AS n
FROM (SELECT event_id, coalesce(provider, 'local') AS p, coalesce(api_key, '') AS a, coalesce(target, 'en') AS t FROM patches_v)
GROUP BY ALL
UNION ALL
SELECT 'reply', CASE k % 7 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'key-rejected' ELSE 'other' END
  WHEN 1 THEN 'key-refused' WHEN 2 THEN 'key-refused' WHEN 3 THEN 'rate-limit' WHEN 4 THEN 'server'
  WHEN 5 THEN 'server' ELSE 'other' END AS reason, count(*) FROM events_v GROUP BY ALL"""


@query
def plate_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    tones = st.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "CAST(l_partkey % 256 AS DOUBLE) AS r", "CAST((l_suppkey * 7) % 256 AS DOUBLE) AS g",
        "CAST((l_partkey * 3 + l_suppkey) % 256 AS DOUBLE) AS b",
    )
    return de.plate_styles(tones).groupBy("r", "g", "b", "ink", "alpha").agg(F.count(F.lit(1)).alias("n"))


SQL["plate_style"] = """WITH t AS (
  SELECT CAST(l_partkey % 256 AS DOUBLE) AS r, CAST((l_suppkey * 7) % 256 AS DOUBLE) AS g,
    CAST((l_partkey * 3 + l_suppkey) % 256 AS DOUBLE) AS b FROM lineitem),
lin AS (SELECT *, list_transform([r, g, b], lambda c: CASE WHEN c / 255 <= 0.04045 THEN c / 255 / 12.92
  ELSE pow((c / 255 + 0.055) / 1.055, 2.4) END) AS l FROM t),
inked AS (SELECT *, 0.2126 * l[1] + 0.7152 * l[2] + 0.0722 * l[3] > 0.1791 AS black FROM lin),
worst AS (SELECT *, list_transform([r, g, b], lambda c: CASE
    WHEN (0.82 * c + 0.18 * CASE WHEN black THEN 0 ELSE 255 END) / 255 <= 0.04045
    THEN (0.82 * c + 0.18 * CASE WHEN black THEN 0 ELSE 255 END) / 255 / 12.92
    ELSE pow(((0.82 * c + 0.18 * CASE WHEN black THEN 0 ELSE 255 END) / 255 + 0.055) / 1.055, 2.4) END) AS m FROM inked),
lum AS (SELECT *, 0.2126 * m[1] + 0.7152 * m[2] + 0.0722 * m[3] AS w FROM worst)
SELECT r, g, b, CASE WHEN black THEN '#000000' ELSE '#ffffff' END AS ink,
  CASE WHEN (CASE WHEN black THEN (w + 0.05) / 0.05 ELSE 1.05 / (w + 0.05) END) < 4.5 THEN 1.0::DOUBLE ELSE 0.82::DOUBLE END AS alpha,
  count(*) AS n FROM lum GROUP BY ALL"""


@query
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.ranked(st.detections(spark, sf_dir)).select("det_id", "score")


SQL["ranked"] = views(v.DETECTIONS) + "SELECT det_id, score FROM detections_v ORDER BY score DESC, det_id"


@query
def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sq.strips(st.tiles(spark, sf_dir))
    return found.select("tile_id", "tiles", F.col("position").cast("long"), "height")


SQL["strips"] = views(v.STRIPS) + """
SELECT tile_id, tiles, CAST(position AS BIGINT) AS position, height FROM strips_v"""


@query
def best_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = st.tiles(spark, sf_dir)
    viewport = (F.lit(0.0), (100 * (F.col("doc_id") % 3)).cast("double"), F.lit(700.0), F.lit(600.0))
    return de.best_targets(tiles, sq.strips(tiles, keep=de.TARGET_COLUMNS), viewport)


SQL["best_targets"] = views(v.STRIPS) + """
SELECT doc_id, tile_id, visible_area, whole FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY whole DESC, visible_area DESC, tile_id) AS place FROM (
    SELECT t.doc_id, t.tile_id, least(t.w, t.h) >= 300 AND greatest(t.w, t.h) >= 400 AS whole,
      coalesce(least(t.w, s.height) >= 300 AND greatest(t.w, s.height) >= 400, false) AS slice,
      greatest(0.0, least(t.x + t.w, 700) - greatest(t.x, 0))
        * greatest(0.0, least(t.y + t.h - 100 * (t.doc_id % 3), 600) - greatest(t.y - 100 * (t.doc_id % 3), 0)) AS visible_area
    FROM tiles_v t LEFT JOIN strips_v s ON s.tile_id = t.tile_id
    WHERE natural_width > 1 AND natural_height > 1)
  WHERE (whole OR slice) AND visible_area > 0) WHERE place = 1"""


@query
def tiles_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.tiles_touched(st.tiles(spark, sf_dir), st.drawn(spark, sf_dir), ["doc_id"]).select("doc_id", "tile_id")


SQL["tiles_touched"] = views(v.TILES, v.DRAWN) + """
SELECT t.doc_id, t.tile_id FROM tiles_v t JOIN drawn_v d USING (doc_id)
WHERE least(x + w, dx + dw) - greatest(x, dx) > 0 AND least(y + h, dy + dh) - greatest(y, dy) > 0"""


@query
def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = st.tiles(spark, sf_dir).where(de.has_pixels()).withColumn(
        "place", F.conv(F.substring(F.md5("tile_id"), 1, 15), 16, 10).cast("long")
    )
    return sp.owner_of(tiles, st.drawn(spark, sf_dir), ["doc_id"], ["doc_id"], ["place"]).select("doc_id", "area", "place")


SQL["owners"] = views(v.TILES, v.DRAWN) + """
SELECT doc_id, area, place FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, place) AS r FROM (
    SELECT doc_id, CAST('0x' || substr(md5(tile_id), 1, 15) AS BIGINT) AS place,
      greatest(0.0, least(x + w, dx + dw) - greatest(x, dx)) * greatest(0.0, least(y + h, dy + dh) - greatest(y, dy)) AS area
    FROM tiles_v JOIN drawn_v USING (doc_id) WHERE natural_width > 1 AND natural_height > 1) WHERE area > 0) WHERE r = 1"""


@query
def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.strided(st.pages(spark, sf_dir), "page_id").select("page_id", "kind")


SQL["strided"] = views(v.PAGES) + """
SELECT page_id, kind FROM (SELECT *, row_number() OVER (ORDER BY page_id) AS r FROM pages_v) WHERE (r - 1) % 5 = 0"""


@query
def quota_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit reaches past the pages by a twentieth, so some negatives come twice."""
    pages = st.pages(spark, sf_dir)
    n = pages.where("kind = 'page'").count()
    return de.quota_head(pages, "page_id", n + n // 20).select("page_id", "kind")


SQL["quota_head"] = views(v.PAGES) + """
, n_v AS (SELECT count(*) + count(*) // 20 AS n FROM pages_v WHERE kind = 'page')
SELECT page_id, kind FROM (SELECT *, row_number() OVER (ORDER BY kind <> 'page', page_id) AS r FROM pages_v), n_v WHERE r <= n
UNION ALL SELECT page_id, kind FROM (
  SELECT *, row_number() OVER (ORDER BY page_id) AS r FROM pages_v WHERE kind <> 'page'), n_v WHERE r <= greatest(1, n // 10)"""
