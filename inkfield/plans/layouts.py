"""Text layout by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.operators import layout as lo
from inkfield.plans import standins as st
from inkfield.plans.registry import SQL, query, rounded
from inkfield.session import spread


@query
def line_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into lines of 320 pixels at size 12."""
    packed = lo.pack_text(spread(st.table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text", 320, 12)
    return packed.select("doc_id", F.col("line").cast("long"), "text", "m")


_M = ("(length({0}) * 550 + (length({0}) - length(translate({0}, 'iljI.,;:!''|', ''))) * -270"
      " + (length({0}) - length(translate({0}, 'mwMW', ''))) * 280)")
WORDS = r"""word_v AS (
  SELECT doc_id, i, word, """ + _M.format("word") + r""" AS m FROM (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
      SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)))"""
SQL["line_pack"] = "WITH RECURSIVE " + WORDS + """,
fold_v AS (
  SELECT doc_id, i, m AS held, 0 AS line FROM word_v WHERE i = 1
  UNION ALL
  SELECT w.doc_id, w.i, CASE WHEN (f.held + 280 + w.m) * 12 / 1000 > 320 THEN w.m ELSE f.held + 280 + w.m END,
    CASE WHEN (f.held + 280 + w.m) * 12 / 1000 > 320 THEN f.line + 1 ELSE f.line END
  FROM fold_v f JOIN word_v w ON w.doc_id = f.doc_id AND w.i = f.i + 1)
SELECT f.doc_id, CAST(line AS BIGINT) AS line, string_agg(word, ' ' ORDER BY f.i) AS text, CAST(max(held) AS BIGINT) AS m
FROM fold_v f JOIN word_v w ON w.doc_id = f.doc_id AND w.i = f.i GROUP BY f.doc_id, line"""


@query
def weighted_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in two by weights 3 and 2."""
    weights = F.array(F.lit(3.0), F.lit(2.0))
    parts = lo.split_by_weight(lo.words_of(F.col("text")), weights)
    return spread(st.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.posexplode(parts).alias("part", "text")).select(
        "doc_id", F.col("part").cast("long"), F.md5("text").alias("digest"))


SQL["weighted_split"] = "WITH " + WORDS + r""",
end_v AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS fin,
    count(*) OVER (PARTITION BY doc_id) AS n FROM word_v),
all_v AS (SELECT *, max(fin) OVER (PARTITION BY doc_id) AS total FROM end_v),
rank_v AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY kind, off, i) AS place FROM (
    SELECT *, abs(fin - CAST(0.6 AS DOUBLE) * total) AS off, CASE
      WHEN regexp_matches(word, '[.!?…」』"''。！？]$') AND abs(fin - CAST(0.6 AS DOUBLE) * total) <= CAST(0.15 AS DOUBLE) * total THEN 0
      WHEN regexp_matches(word, '[,;:)]$') AND abs(fin - CAST(0.6 AS DOUBLE) * total) <= CAST(0.25 AS DOUBLE) * total THEN 1 ELSE 2 END AS kind
    FROM all_v WHERE i < n)),
cut_v AS (SELECT doc_id, i AS cut FROM rank_v WHERE place = 1)
SELECT w.doc_id, CAST(CASE WHEN w.i <= coalesce(cut, w.i) THEN 0 ELSE 1 END AS BIGINT) AS part, md5(string_agg(word, ' ' ORDER BY w.i)) AS digest
FROM word_v w LEFT JOIN cut_v c ON c.doc_id = w.doc_id GROUP BY ALL"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a translation for a box of the pages."""
    texts = spread(st.requests(spark, sf_dir), "page_id", "position")
    return texts.select(
        "page_id", "position", F.col("source").alias("text"),
        (F.col("position") * 37 % 320).cast("double").alias("x"), (F.col("position") * 53 % 400).cast("double").alias("y"),
        (60 + F.col("page_id") % 90).cast("double").alias("w"), (40 + F.col("page_id") % 70).cast("double").alias("h"),
    )


# The words of every line with its box, and folds of them at a size: lines, last width, greatest width.
_PLACED = r"""placed_v AS (
  SELECT page_id, position, list_filter(string_split_regex(source, '\s+'), lambda t: t <> '') AS words,
    CAST(position * 37 % 320 AS DOUBLE) AS x, CAST(position * 53 % 400 AS DOUBLE) AS y,
    CAST(60 + page_id % 90 AS DOUBLE) AS w, CAST(40 + page_id % 70 AS DOUBLE) AS h FROM (
    SELECT doc_id AS page_id, unnest(parts) AS source, generate_subscripts(parts, 1) - 1 AS position
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""
_FOLD = ("CASE WHEN len(words) = 0 THEN {{'held': 0, 'line': 0, 'wide': 0}} ELSE list_reduce("
         "list_transform(words, lambda t: {{'held': " + _M.format("t") + ", 'line': 1, 'wide': " + _M.format("t") + "}}), lambda a, b:"
         " CASE WHEN (a.held + 280 + b.held) * {size} / 1000 <= {width}"
         " THEN {{'held': a.held + 280 + b.held, 'line': a.line, 'wide': greatest(a.wide, a.held + 280 + b.held)}}"
         " ELSE {{'held': b.held, 'line': a.line + 1, 'wide': greatest(a.wide, b.held)}} END) END")


def _fit(jobs: str, name: str) -> str:
    """View ``name``: the largest size at which the words of a job fit its box, else the least size, spilling."""
    return f"""{name}_size_v AS (
  SELECT *, unnest(range(0, 1 + CAST(floor(least(28.0, greatest(10.0, h)) - 10) AS BIGINT))) AS step FROM {jobs}),
{name}_try_v AS (
  SELECT *, {_FOLD.format(size="size", width="w")} AS f FROM (
    SELECT * EXCLUDE (step), CAST(least(28, greatest(10, h)) - step AS DOUBLE) AS size FROM {name}_size_v)),
{name}_best_v AS (
  SELECT page_id, position, part, max(size) AS best, arg_max(f.line, size) AS n FROM {name}_try_v
  WHERE f.wide * size / 1000 <= w AND f.line * size * CAST(1.15 AS DOUBLE) <= h GROUP BY ALL),
{name}_wide_v AS (
  SELECT *, least(greatest(w, coalesce(list_max(list_transform(words, lambda t: {_M.format("t")})), 0) * CAST(10 AS DOUBLE) / 1000), w * 2.5) AS wide FROM {jobs}),
{name}_spill_v AS (
  SELECT *, f.line * CAST(10 AS DOUBLE) * CAST(1.15 AS DOUBLE) AS high FROM (
    SELECT *, {_FOLD.format(size="CAST(10 AS DOUBLE)", width="wide")} AS f FROM {name}_wide_v)),
{name} AS (
  SELECT page_id, position, part, CASE WHEN len(words) = 0 THEN 10 ELSE coalesce(best, 10) END AS size,
    CASE WHEN len(words) = 0 THEN 0 ELSE coalesce(n, f.line) END AS lines, spilt AS overflowed,
    CASE WHEN spilt THEN x + (w - wide) / 2 ELSE x END AS x, CASE WHEN spilt THEN y + (h - high) / 2 ELSE y END AS y,
    CASE WHEN spilt THEN wide ELSE w END AS w, CASE WHEN spilt THEN high ELSE h END AS h
  FROM (SELECT *, len(words) > 0 AND best IS NULL AS spilt FROM {name}_spill_v LEFT JOIN {name}_best_v USING (page_id, position, part)))"""


_SHOWN = """page_id, CAST(position AS INT) AS position, CAST(size AS DOUBLE) AS size, CAST(lines AS INT) AS lines, round(1e-9 + x, 6) AS x,
  round(1e-9 + y, 6) AS y, round(1e-9 + w, 6) AS w, round(1e-9 + h, 6) AS h, overflowed"""
_LABELS = f"""note_v AS (
  SELECT *, least(260, greatest(80, w * CAST(1.2 AS DOUBLE))) AS room, unnest(range(10, 17)) AS s FROM placed_v),
set_v AS (SELECT * EXCLUDE (s), CAST(s AS DOUBLE) AS size, {_FOLD.format(size="CAST(s AS DOUBLE)", width="room")} AS f FROM note_v),
label_v AS (
  SELECT *, f.line * size * CAST(1.15 AS DOUBLE) AS high, f.wide * size / 1000 AS own FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, position
      ORDER BY CASE WHEN f.line <= 3 AND f.wide * size / 1000 <= room THEN -size ELSE 0 END, size) AS place FROM set_v) WHERE place = 1),
labelled_v AS (
  SELECT page_id, position, size, f.line AS lines, own > room AS overflowed, least(room, own) AS w, high AS h,
    least(greatest(0, x + (w - least(room, own)) / 2), greatest(0, 400 - least(room, own))) AS x,
    CASE WHEN y + h + 4 + high + 4 <= 500 THEN y + h + 4 WHEN y - 4 - high - 4 >= 0 THEN y - 4 - high ELSE greatest(0, y + h - high) END AS y
  FROM label_v)"""


@query
def fit_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    fit = lo.fit_text(lo.words_of(F.col("text")), *(F.col(c) for c in "xywh"))
    rows = placed.select("page_id", "position", fit.alias("f"))
    return rounded(rows.select(
        "page_id", "position", "f.size", F.size("f.lines").alias("lines"), "f.x", "f.y", "f.w", "f.h", "f.overflowed"))


SQL["fit_layout"] = f"""WITH {_PLACED}, job_v AS (SELECT *, 0 AS part FROM placed_v), {_fit("job_v", "fit_v")}
SELECT {_SHOWN} FROM fit_v"""


@query
def fit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    label = lo.fit_label(lo.words_of(F.col("text")), *(F.col(c) for c in "xywh"), F.lit(400.0), F.lit(500.0))
    rows = placed.select("page_id", "position", label.alias("f"))
    return rounded(rows.select(
        "page_id", "position", "f.size", F.size("f.lines").alias("lines"), "f.x", "f.y", "f.w", "f.h", "f.overflowed"))


SQL["fit_labels"] = f"WITH {_PLACED}, {_LABELS} SELECT {_SHOWN} FROM labelled_v"


@query
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(*(F.col(c) for c in "xywh"))
    below = F.struct(F.col("x"), (F.col("y") + F.col("h")).alias("y"), F.col("w"), F.col("h"))
    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    regions = _placed(spark, sf_dir).withColumns({
        "lobes": F.when(F.col("position") % 4 == 0, F.array(box, below)).when(F.col("position") % 4 == 1, F.array(box)).otherwise(none),
        "label": F.col("position") % 4 == 2, "coverage": (F.col("page_id") % 10) / 10,
        "ground": F.struct(F.lit(240.0).alias("r"), F.lit(240.0).alias("g"), F.lit(235.0).alias("b")),
        "page_width": F.lit(400.0), "page_height": F.lit(500.0),
    })
    plan = lo.render_plan(regions)
    return rounded(plan.select(
        "page_id", "position", "label", "plated", "overflowed", "tone_coverage", F.size("blocks").alias("blocks"), "first.size"))


# A balloon of two equal lobes: its words are cut near the middle, and both ways are fitted.
SQL["render_plan"] = f"""WITH {_PLACED}, {_LABELS},
end_v AS (
  SELECT page_id, position, i, word, n, sum(length(word) + 1) OVER (PARTITION BY page_id, position ORDER BY i) - 1 AS fin,
    sum(length(word) + 1) OVER (PARTITION BY page_id, position) - 1 AS total
  FROM (SELECT page_id, position, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM placed_v WHERE position % 4 = 0)),
cut_v AS (SELECT page_id, position, i AS cut FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, position ORDER BY CASE
      WHEN regexp_matches(word, '[.!?…」』"''。！？]$') AND off <= CAST(0.15 AS DOUBLE) * total THEN 0
      WHEN regexp_matches(word, '[,;:)]$') AND off <= CAST(0.25 AS DOUBLE) * total THEN 1 ELSE 2 END, off, i) AS place
  FROM (SELECT *, abs(fin - 0.5 * total) AS off FROM end_v WHERE i < n)) WHERE place = 1),
job_v AS (
  SELECT *, 0 AS part FROM placed_v WHERE position % 4 <> 2
  UNION ALL SELECT p.page_id, p.position, p.words[:cut], x, y, w, h, 1 FROM placed_v p JOIN cut_v USING (page_id, position)
  UNION ALL SELECT p.page_id, p.position, p.words[cut + 1:], x, y + h, w, h, 2 FROM placed_v p JOIN cut_v USING (page_id, position)),
{_fit("job_v", "fit_v")},
both_v AS (
  SELECT page_id, position, max(size) FILTER (part = 0) AS one, bool_or(overflowed) FILTER (part = 0) AS over,
    max(size) FILTER (part = 1) AS first, min(size) FILTER (part > 0) AS least, bool_or(overflowed) FILTER (part > 0) AS over_split
  FROM fit_v GROUP BY page_id, position),
laid_v AS (
  SELECT page_id, position, CASE WHEN used THEN first ELSE one END AS size, CASE WHEN used THEN over_split ELSE over END AS overflowed,
    CASE WHEN used THEN 2 ELSE 1 END AS blocks
  FROM (SELECT *, coalesce(least >= one AND (over OR NOT over_split), FALSE) AS used FROM both_v)
  UNION ALL SELECT page_id, position, size, overflowed, 1 FROM labelled_v WHERE position % 4 = 2)
SELECT page_id, CAST(position AS INT) AS position, position % 4 = 2 AS label,
  position % 4 = 2 OR (position % 4 = 3 AND page_id % 10 / 10 < CAST(0.73 AS DOUBLE)) AS plated, overflowed,
  CASE WHEN position % 4 >= 2 THEN round(1e-9 + page_id % 10 / 10, 6) ELSE 1.0 END AS tone_coverage, CAST(blocks AS INT) AS blocks,
  CAST(size AS DOUBLE) AS size FROM laid_v"""
