"""The SQL each query must equal, runnable on the given tables."""

from __future__ import annotations

from inkfield.plans import views_sql as v
from inkfield.plans.registry import SQL
from inkfield.plans.views_sql import views


_BOXES = [v.REGIONS, v.DETECTIONS, v.PAIRS]
_MEASURED = [*_BOXES, v.COVERAGE, v.MEASURES]

SQL["region_measures"] = views(*_MEASURED) + """
SELECT box_id, round(1e-9 + coverage, 6) AS coverage, round(1e-9 + best_iou, 6) AS best_iou, pieces,
  round(1e-9 + single, 6) AS single, touching FROM measures_v"""

_TALLY = """
SELECT CASE WHEN grouping(kind) = 0 THEN kind WHEN grouping(background) = 0 THEN background
    WHEN grouping(language) = 0 THEN language ELSE 'all' END AS slice,
  count(*) AS regions,
  count(*) FILTER (coverage >= 0.5) AS hits,
  round(1e-9 + count(*) FILTER (coverage >= 0.5) / count(*), 6) AS recall,
  round(1e-9 + sum(coverage) / count(*), 6) AS mean_coverage,
  round(1e-9 + count(*) FILTER (best_iou >= 0.5) / count(*), 6) AS iou_recall,
  count(*) FILTER (pieces > 1) AS fragmented
FROM (SELECT m.kind, CASE WHEN dark THEN 'dark bg' ELSE 'light bg' END AS background, p.language,
    coverage, best_iou, pieces FROM measures_v m JOIN pages_v p ON m.page_id = p.page_id)
GROUP BY GROUPING SETS ((kind), (background), (language), ())"""

SQL["slice_tally"] = views(v.PAGES, *_MEASURED) + _TALLY

SQL["best_match"] = views(*_BOXES) + """
SELECT r.box_id, round(1e-9 + coalesce(b.best.iou, 0.0), 6) AS iou, b.best.score AS score,
  b.best.dx AS dx, b.best.dy AS dy, round(1e-9 + b.best.dw, 6) AS dw, round(1e-9 + b.best.dh, 6) AS dh
FROM regions_v r LEFT JOIN (
  SELECT box_id, max_by({'iou': common / (w * h + dw * dh - common), 'score': score, 'dx': dx, 'dy': dy, 'dw': dw, 'dh': dh},
    {'a': common / (dw * dh + w * h - common), 'b': score, 'c': -dx, 'd': -dy, 'e': -dw, 'f': -dh}) AS best
  FROM pairs_v GROUP BY box_id) b ON r.box_id = b.box_id"""

SQL["overlap_pairs"] = views(*_BOXES) + """
SELECT box_id, det_id, round(1e-9 + common, 6) AS common, round(1e-9 + common / (w * h + dw * dh - common), 6) AS iou,
  round(1e-9 + common / least(w * h, dw * dh), 6) AS containment, round(1e-9 + common / (dw * dh), 6) AS detection_inside
FROM pairs_v"""

SQL["containment_pairs"] = views(*_BOXES) + """
SELECT box_id, det_id FROM pairs_v WHERE common / (dw * dh) >= 0.5"""

_SPURIOUS = """near_v AS (
  SELECT det_id, count(*) FILTER (common / (w * h) >= 0.5) AS held,
    bool_or(common / (w * h) >= 0.25 OR common / (dw * dh) >= 0.25) AS near
  FROM pairs_v GROUP BY det_id),
flags_v AS (
  SELECT d.*, NOT coalesce(n.near, false) AS spurious, coalesce(n.held, 0) AS held
  FROM detections_v d LEFT JOIN near_v n ON d.det_id = n.det_id)"""

SQL["spurious"] = views(*_BOXES, _SPURIOUS) + "SELECT det_id, model FROM flags_v WHERE spurious"
SQL["merged"] = views(*_BOXES, _SPURIOUS) + """
SELECT det_id, CAST(held AS BIGINT) AS regions_held FROM flags_v WHERE held > 1"""
SQL["fragments"] = views(*_MEASURED) + """
SELECT box_id, pieces, round(1e-9 + single, 6) AS single, single < 0.9 AS true_split
FROM measures_v WHERE pieces > 1"""
SQL["detection_totals"] = views(*_BOXES, _SPURIOUS) + """
SELECT count(*) AS detections, count(*) FILTER (spurious) AS spurious, count(*) FILTER (held > 1) AS merged,
  round(1e-9 + count(*) FILTER (spurious) / greatest(1, count(*)), 6) AS spurious_rate FROM flags_v"""
SQL["page_report"] = views(v.PAGES, *_MEASURED) + """
SELECT p.page_id, p.language, coalesce(r.regions, 0) AS regions, coalesce(r.missed, 0) AS missed,
  coalesce(d.detections, 0) AS detections
FROM pages_v p
LEFT JOIN (SELECT page_id, count(*) AS regions, count(*) FILTER (coverage < 0.5) AS missed
  FROM measures_v GROUP BY page_id) r ON p.page_id = r.page_id
LEFT JOIN (SELECT page_id, count(*) AS detections FROM detections_v GROUP BY page_id) d ON p.page_id = d.page_id"""
SQL["misses"] = views(*_MEASURED) + """
SELECT page_id, kind, dark, CAST(round_even(x, 0) AS BIGINT) AS x, CAST(round_even(y, 0) AS BIGINT) AS y,
  CAST(round_even(w, 0) AS BIGINT) AS w, CAST(round_even(h, 0) AS BIGINT) AS h, round(1e-9 + coverage, 2) AS coverage
FROM measures_v WHERE coverage < 0.5 AND dark"""

# The sweep: every detection of score >= t counts at t. A region's state is
# worked out once for each distinct level its detections reach and holds for
# the thresholds above the level before.
_SWEEP = """levels_v AS (
  SELECT row_number() OVER (ORDER BY threshold) AS i, threshold FROM (
    SELECT unnest([CAST(0.05 AS DOUBLE)] || list_transform(range(10, 96), lambda i: round(CAST(0.01 AS DOUBLE) * i, 2))) AS threshold)),
reach_v AS (
  SELECT s.score, count(*) AS level FROM (SELECT DISTINCT score FROM detections_v) s
  JOIN levels_v t ON t.threshold <= s.score GROUP BY s.score),
steps_v AS (
  SELECT *, coalesce(lag(level) OVER (PARTITION BY box_id, model ORDER BY level), 0) AS below FROM (
    SELECT DISTINCT p.box_id, p.model, r.level FROM pairs_v p JOIN reach_v r ON p.score = r.score)),
state_v AS (
  SELECT z.box_id, z.model, z.level, z.below, max(common / (dw * dh + w * h - common)) AS best_iou,
    count(*) FILTER (common / greatest(w * h, 1) > 0.05) AS pieces, max(common / (w * h)) AS single
  FROM steps_v z JOIN pairs_v p ON p.box_id = z.box_id AND p.model = z.model
  JOIN reach_v r ON p.score = r.score AND r.level >= z.level GROUP BY ALL),
shown_cover_v AS (
  SELECT box_id, model, level, sum(part) / any_value(CAST(nc * nr AS DOUBLE)) AS coverage FROM (
    SELECT box_id, model, level, c, nc, nr,
      greatest(0, r1 - greatest(r0 - 1, coalesce(max(r1) OVER (PARTITION BY box_id, model, level, c ORDER BY r0, r1
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))) AS part
    FROM (SELECT DISTINCT z.box_id, z.model, z.level, s.c, s.nc, s.nr, s.r0, s.r1
      FROM steps_v z JOIN spans_v s ON s.box_id = z.box_id AND s.model = z.model
      JOIN reach_v r ON s.score = r.score AND r.level >= z.level))
  GROUP BY box_id, model, level),
sliced_v AS (
  SELECT box_id, unnest(['all', kind, CASE WHEN dark THEN 'dark bg' ELSE 'light bg' END]) AS slice FROM regions_v),
sizes_v AS (SELECT slice, count(*) AS n FROM sliced_v GROUP BY slice),
hits_v AS (
  SELECT z.slice, s.model, t.threshold, sum(coalesce(c.coverage, 0.0)) AS coverage,
    count(*) FILTER (c.coverage >= 0.5) AS hits, count(*) FILTER (best_iou >= 0.5) AS iou_hits,
    count(*) FILTER (pieces > 1) AS fragmented, count(*) FILTER (pieces > 1 AND single < 0.9) AS true_split
  FROM state_v s JOIN sliced_v z ON s.box_id = z.box_id
  JOIN levels_v t ON t.i > s.below AND t.i <= s.level
  LEFT JOIN shown_cover_v c ON s.box_id = c.box_id AND s.model = c.model AND s.level = c.level
  GROUP BY ALL),
counts_v AS (
  SELECT m.model, t.threshold, count(f.det_id) AS detections, count(f.det_id) FILTER (f.spurious) AS spurious
  FROM (SELECT DISTINCT model FROM detections_v) m CROSS JOIN levels_v t
  LEFT JOIN flags_v f ON f.model = m.model AND f.score >= t.threshold GROUP BY ALL),
sweep_v AS (
  SELECT k.model, k.threshold, z.slice, z.n, coalesce(h.hits, 0) / greatest(1, z.n) AS recall,
    coalesce(h.coverage, 0.0) / greatest(1, z.n) AS mean_coverage,
    coalesce(h.iou_hits, 0) / greatest(1, z.n) AS iou_recall,
    coalesce(h.fragmented, 0) AS fragmented, coalesce(h.true_split, 0) AS true_split,
    k.detections, k.spurious, k.spurious / greatest(1, k.detections) AS spurious_rate
  FROM counts_v k CROSS JOIN sizes_v z
  LEFT JOIN hits_v h ON h.model = k.model AND h.threshold = k.threshold AND h.slice = z.slice)"""
_SWEPT = views(*_MEASURED, _SPURIOUS, _SWEEP)

SQL["sweep"] = _SWEPT + """
SELECT model, threshold, slice, n, round(1e-9 + recall, 6) AS recall, round(1e-9 + mean_coverage, 6) AS mean_coverage,
  round(1e-9 + iou_recall, 6) AS iou_recall, fragmented, true_split, detections, spurious,
  round(1e-9 + spurious_rate, 6) AS spurious_rate FROM sweep_v"""
SQL["sweep_cumulative"] = _SWEPT + """
SELECT model, threshold, detections, spurious, round(1e-9 + spurious / greatest(1, detections), 6) AS spurious_rate
FROM counts_v"""
_POINTS = """, limits_v AS (SELECT unnest([0.05, 0.2, 0.25, 0.3, 0.4, 0.6]::DOUBLE[]) AS ceiling),
table_v AS (
  SELECT model, threshold, spurious_rate, max(recall) FILTER (slice = 'sfx') AS sfx_recall,
    max(recall) FILTER (slice = 'dark bg') AS dark_recall, max(recall) FILTER (slice = 'all') AS all_recall
  FROM sweep_v GROUP BY ALL),
ranked_v AS (
  SELECT c.ceiling, m.model, t.threshold, t.sfx_recall, t.dark_recall, t.all_recall,
    row_number() OVER (PARTITION BY c.ceiling, m.model ORDER BY t.sfx_recall DESC, t.dark_recall DESC, t.threshold) AS place
  FROM limits_v c CROSS JOIN (SELECT DISTINCT model FROM table_v) m
  LEFT JOIN table_v t ON t.model = m.model AND t.spurious_rate <= c.ceiling + 1e-9),
points_v AS (SELECT * FROM ranked_v WHERE place = 1)"""
SQL["operating_point"] = _SWEPT.rstrip() + _POINTS + """
SELECT model, ceiling, threshold, round(1e-9 + sfx_recall, 6) AS sfx_recall, round(1e-9 + dark_recall, 6) AS dark_recall,
  round(1e-9 + all_recall, 6) AS all_recall FROM points_v"""
SQL["pareto"] = _SWEPT.rstrip() + _POINTS + """,
winners_v AS (
  SELECT * FROM points_v a WHERE threshold IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM points_v b WHERE b.ceiling = a.ceiling AND b.threshold IS NOT NULL
      AND (b.sfx_recall > a.sfx_recall OR b.dark_recall > a.dark_recall)))
SELECT p.ceiling, CASE WHEN count(p.threshold) = 0 THEN '-'
  WHEN (SELECT count(*) FROM winners_v w WHERE w.ceiling = p.ceiling) = 1
  THEN (SELECT max(model) FROM winners_v w WHERE w.ceiling = p.ceiling) ELSE 'split' END AS verdict
FROM points_v p GROUP BY p.ceiling"""
SQL["fixed_report"] = _SWEPT + """
SELECT slice, """ + ", ".join(
    f"round(1e-9 + max({c}) FILTER (model = '{m}'), 6) AS {m}_{n}" if n in ("recall", "cov", "iou")
    else f"CAST(max({c}) FILTER (model = '{m}') AS BIGINT) AS {m}_{n}"
    for m in "FO"
    for c, n in (("recall", "recall"), ("mean_coverage", "cov"), ("iou_recall", "iou"), ("spurious", "spurious"),
                 ("detections", "detections"), ("fragmented", "frag"), ("true_split", "split"))
) + " FROM sweep_v WHERE threshold = 0.25::DOUBLE GROUP BY slice"


def _tally_of(model: str) -> str:
    """One model's tally as a derived table: the shared views with only its detections."""
    found = v.DETECTIONS[:-1] + f" WHERE l_linestatus = '{model}')"
    return "(" + views(v.PAGES, v.REGIONS, found, v.PAIRS, v.COVERAGE, v.MEASURES) + _TALLY.replace(
        "round(1e-9 + count(*) FILTER (coverage >= 0.5) / count(*), 6)", "count(*) FILTER (coverage >= 0.5) / count(*)"
    ).replace("round(1e-9 + sum(coverage) / count(*), 6)", "sum(coverage) / count(*)").replace(
        "round(1e-9 + count(*) FILTER (best_iou >= 0.5) / count(*), 6)", "count(*) FILTER (best_iou >= 0.5) / count(*)"
    ) + ")"


SQL["compare_models"] = f"""
SELECT list_position(['bubble', 'sfx', 'caption', 'dark bg', 'light bg', 'ja', 'ko', 'zh', 'all'], slice) - 1 AS position,
  slice, b.regions AS n, """ + ", ".join(
    f"round(1e-9 + b.{c}, 6) AS before_{c}, round(1e-9 + a.{c}, 6) AS after_{c}, round(1e-9 + a.{c} - b.{c}, 6) AS delta_{c}"
    for c in ("recall", "mean_coverage", "iou_recall")
) + f" FROM {_tally_of('F')} b JOIN {_tally_of('O')} a USING (slice)"

SQL["parity"] = views(v.DETECTIONS) + """, moved_v AS (
  SELECT * REPLACE (dx + CASE WHEN score > 0.9 THEN 2e-6 ELSE 5e-7 END AS dx) FROM detections_v
  WHERE NOT (model = 'O' AND score < 0.01)),
a AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY dx, dy, dw, dh, score, det_id) AS position,
  count(*) OVER (PARTITION BY page_id) AS n FROM detections_v),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY dx, dy, dw, dh, score, det_id) AS position,
  count(*) OVER (PARTITION BY page_id) AS n FROM moved_v)
SELECT a.page_id, CAST(a.position AS INT) AS position, 'value' AS reason FROM a JOIN b
  ON a.page_id = b.page_id AND a.position = b.position AND a.n = b.n
  WHERE abs(a.dx - b.dx) > 1e-6 OR abs(a.dy - b.dy) > 1e-6 OR abs(a.dw - b.dw) > 1e-6 OR abs(a.dh - b.dh) > 1e-6
    OR abs(a.score - b.score) > 1e-5
UNION ALL
SELECT page_id, NULL, 'count' FROM (SELECT page_id, n FROM a GROUP BY ALL) l
  FULL JOIN (SELECT page_id, n AS m FROM b GROUP BY ALL) r USING (page_id)
  WHERE coalesce(n, 0) <> coalesce(m, 0)"""
