"""Detection scoring: tallies by slice, reports, threshold sweeps, model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkfield.functions import geometry as g
from inkfield.operators import spatial as sp
from inkfield.session import same_columns, spread

# Fixed values the results depend on.
DARK_SHARE = 0.25
THRESHOLDS = [0.05] + [round(0.01 * i, 2) for i in range(10, 96)]
CEILINGS = [0.009, 0.019, 0.028, 0.035, 0.043, 0.07]
SWEEP_SLICES = ["bubble", "sfx", "caption", "dark bg", "light bg", "all"]
SLICE_ORDER = ["bubble", "sfx", "caption", "dark bg", "light bg", "ja", "ko", "zh", "all"]


def dark_flag(recorded: Column, measured: Column | None = None) -> Column:
    """Recorded dark share when there is one, else the measured, against the limit."""
    share = recorded if measured is None else F.coalesce(recorded, measured)
    return share >= DARK_SHARE


def background(dark: Column) -> Column:
    return F.when(dark, "dark bg").otherwise("light bg")


def slice_tally(regions: DataFrame, detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Count, hits, IoU hits, mean coverage and fragments per kind, background, language and all.

    Regions collapse to (page, box, kind, dark) with a count, the measures join
    on the box, and the slices are grouping sets over a table of at most
    kinds x backgrounds x languages rows.
    """
    labelled = sp.collapse(regions, [*sp.REGION_KEY, "kind", "dark"], "n")
    measures = sp.region_measures(regions, detections)
    n = F.col("n")
    hit = F.coalesce("coverage", F.lit(0.0)) >= sp.COVER_HIT
    cells = (
        sp.join_boxes(labelled, measures)
        .join(pages.select("page_id", "language"), "page_id")
        .groupBy("kind", "dark", "language")
        .agg(
            F.sum(n).alias("regions"),
            F.sum(F.when(hit, n).otherwise(0)).alias("hits"),
            F.sum(F.when(F.col("best_iou") >= sp.IOU_HIT, n).otherwise(0)).alias("iou_hits"),
            F.sum(F.coalesce("coverage", F.lit(0.0)) * n).alias("coverage"),
            F.sum(F.when(F.col("pieces") > 1, n).otherwise(0)).alias("fragmented"),
        )
    )
    sums = ["regions", "hits", "iou_hits", "coverage", "fragmented"]
    spark = regions.sparkSession
    slices = spark.sql(
        "SELECT CASE grouping_id(kind, background, language) WHEN 3 THEN kind WHEN 5 THEN background"
        " WHEN 6 THEN language ELSE 'all' END AS slice, "
        + ", ".join(f"sum({c}) AS {c}" for c in sums)
        + " FROM {cells} GROUP BY kind, background, language"
        " GROUPING SETS ((kind), (background), (language), ())",
        cells=cells.withColumn("background", background(F.col("dark"))),
    )
    return slices.select(
        "slice", "regions", "hits", (F.col("hits") / F.col("regions")).alias("recall"),
        (F.col("coverage") / F.col("regions")).alias("mean_coverage"),
        (F.col("iou_hits") / F.col("regions")).alias("iou_recall"), "fragmented",
    )


def detection_totals(regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections, spurious, their rate over at least 1, and merged: one row."""
    n = F.col("copies")
    return (
        sp.detection_flags(regions, detections)
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("detections"),
            F.coalesce(F.sum(F.when(F.col("spurious"), n).otherwise(0)), F.lit(0)).alias("spurious"),
            F.coalesce(F.sum(F.when(F.col("merged"), n).otherwise(0)), F.lit(0)).alias("merged"),
        )
        .withColumn("spurious_rate", F.col("spurious") / F.greatest(F.lit(1), F.col("detections")))
    )


def page_report(pages: DataFrame, regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Regions, detections and missed regions of every page, empty pages included."""
    labelled = sp.join_boxes(sp.collapse(regions, sp.REGION_KEY, "n"), sp.region_measures(regions, detections))
    missed = F.coalesce("coverage", F.lit(0.0)) < sp.COVER_HIT
    per_page = labelled.groupBy("page_id").agg(
        F.sum("n").alias("regions"), F.sum(F.when(missed, F.col("n")).otherwise(0)).alias("missed")
    )
    found = detections.groupBy("page_id").agg(F.count(F.lit(1)).alias("detections"))
    return (
        pages.select("page_id", "language")
        .join(per_page, "page_id", "left")
        .join(found, "page_id", "left")
        .fillna(0, ["regions", "missed", "detections"])
    )


def misses(regions: DataFrame, detections: DataFrame, wanted: str = "all") -> DataFrame:
    """Regions covered less than half, of one slice, with rounded geometry."""
    rows = sp.with_measures(regions, detections).where(F.col("coverage") < sp.COVER_HIT)
    if wanted == "dark":
        rows = rows.where("dark")
    elif wanted != "all":
        rows = rows.where(F.col("kind") == wanted)
    sides = [g.half_even(F.col(c)).cast("long").alias(c) for c in "xywh"]
    return rows.select("page_id", "kind", "dark", *sides, "coverage")


# --- sweep over thresholds -------------------------------------------------


def _at_every_step(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Each row once per threshold, with its step number."""
    levels = F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(float(t)).alias("threshold"))
                       for i, t in enumerate(thresholds)))
    return df.withColumn("_level", F.explode(levels)).select(*df.columns, "_level.*")


def step_of(score: Column, thresholds: Sequence[float] = THRESHOLDS) -> Column:
    """Number of thresholds at or below the score: it counts at steps 1..that.

    A halving chain of comparisons, so it stays in generated code.
    """
    levels = sorted(float(t) for t in thresholds)

    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(score >= levels[middle], halve(middle + 1, hi)).otherwise(halve(lo, middle))

    return halve(0, len(levels))


def _region_steps(regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Changes of each region's state as the threshold falls, per (region box, model, step)."""
    return _pair_steps(sp.measured_pairs(regions, detections, ["model", "step"]))


def _pair_steps(measured: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """The same from the measured pairs, per labels of the region too.

    A detection with step s counts at thresholds 1..s, so going down from the
    highest step each region gains detections; those of step 0 come last and
    say nothing of the steps above. Pairs are dealt by region box once, with
    what the steps ask of a measure in place of the measure; the windows below
    run over at most one row per threshold.
    """
    keys = ["_box", *sp.REGION_KEY, *labels, "model"]
    # Rectangles reached so far: where at every step one of them is the hull of all, its cells are their union and no column is enumerated.
    until = W.partitionBy(*keys).orderBy(F.desc("step")).rangeBetween(W.unboundedPreceding, W.currentRow)
    cells, real = sp.rect_cells(), sp.rect_cells() > 0
    asked = measured.select(
        *keys[1:], "step", "c0", "c1", "r0", "r1",
        (F.col("iou") >= sp.IOU_HIT).alias("iou_hit"), (F.col("region_inside") >= sp.WHOLE_SHARE).alias("whole"),
        F.when(F.col("piece") > sp.FRAGMENT_SHARE, F.col("copies")).otherwise(0).alias("pieces"),
    )
    pairs = sp.laid_out(asked).select(
        "*", F.max(cells).over(until).alias("largest"),
        *(f(F.when(real, F.col(c))).over(until).alias(f"hull_{c}") for f, c in ((F.min, "c0"), (F.max, "c1"), (F.min, "r0"), (F.max, "r1"))),
    ).withColumn("several", F.max(F.coalesce(sp.rect_cells("hull_"), F.lit(0)) != F.col("largest")).over(W.partitionBy(*keys)))
    per_column = W.partitionBy(*keys, "col").orderBy(F.desc("step"))
    # Pairs of one step see each other's cells: the first of them has the gain, whichever it is, and no row a column is grouped.
    falling = per_column.rangeBetween(W.unboundedPreceding, W.currentRow)
    words = [f"m{i}" for i in range(g.MASK_WORDS)]
    measure = F.col("col").isNull()
    flags = (
        sp.with_columns_of(pairs, F.col("several"))
        .select(*keys, "col", "step", "iou_hit", "whole", "pieces", "largest", "several", *(F.bit_or(w).over(falling).alias(w) for w in words))
        .withColumn("size", F.when(measure, F.when(F.col("several"), 0).otherwise(F.col("largest"))).otherwise(sp.mask_size()))
        .withColumn("gain", F.col("size") - F.coalesce(F.lag("size").over(per_column), F.lit(0)))
        .groupBy(*keys, "step")
        .agg(
            *(F.max(F.when(measure, F.col(c).cast("int"))).alias(c) for c in ("iou_hit", "whole")),
            F.sum(F.when(measure, F.col("pieces"))).alias("pieces"), F.sum("gain").alias("gain"),
        )
    )
    so_far = W.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(F.desc("step"))
    covered = F.sum("gain").over(so_far) / sp.grid_cells()
    pieces = F.sum("pieces").over(so_far)
    states = flags.select(
        *keys, "step",
        covered.alias("coverage"),
        (covered >= sp.COVER_HIT).cast("int").alias("hits"),
        F.max("iou_hit").over(so_far).alias("iou_hits"),
        (pieces > 1).cast("int").alias("fragmented"),
        ((pieces > 1) & (F.max("whole").over(so_far) == 0)).cast("int").alias("true_split"),
    )
    values = ["coverage", "hits", "iou_hits", "fragmented", "true_split"]
    return states.select(
        *keys, "step",
        *((F.col(v) - F.coalesce(F.lag(v).over(before), F.lit(0))).alias(v) for v in values),
    )


def _near_counts(pairs: DataFrame) -> DataFrame:
    """Detections that are not spurious per model and step.

    With ``same_columns`` the boxes are dealt once for this reading of the pairs and the other one.
    """
    whole = same_columns(pairs.select(*pairs.columns[: pairs.columns.index("iou")]))
    return (
        pairs.where(sp.near_boxes(g.box(), g.box("d")) & whole)
        .select("page_id", *sp.DETECTION_BOX, "model", "step", "copies").distinct()
        .groupBy("model", "step").agg(F.sum("copies").alias("near"))
    )


def sweep(regions: DataFrame, detections: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Every slice metric at every threshold and model, without a join to the thresholds.

    Each region adds its change of state at the step it happens; the value at a
    threshold is the sum of all changes at that step or above. Detection and
    spurious counts accumulate the same way. Boxes are joined once: regions'
    states and the detections near a region are two readings of the pairs.
    """
    scored = detections.withColumn("step", step_of(F.col("score"), thresholds))
    values = ["coverage", "hits", "iou_hits", "fragmented", "true_split"]
    n = F.col("n")
    pairs = sp.measured_pairs(regions, scored, ["model", "step"], ["kind", "dark"])
    changes = (
        _pair_steps(pairs, ["kind", "dark", "n"])
        .groupBy("model", "kind", "dark", "step")
        .agg(*(F.sum(F.col(v) * n).alias(v) for v in values))
    )
    in_slices = F.explode(F.array(F.lit("all"), F.col("kind"), background(F.col("dark")))).alias("slice")
    sized = (
        sp.collapse(regions, ["kind", "dark"], "n")
        .select("n", in_slices).groupBy("slice").agg(F.sum("n").alias("n"))
    )
    by_slice = (
        changes.select("model", "step", *values, in_slices)
        .groupBy("model", "slice", "step").agg(*(F.sum(v).alias(v) for v in values))
    )
    counts = (
        sp.collapse(scored, ["model", "step"], "detections")
        .join(_near_counts(pairs), ["model", "step"], "left")
        .select("model", "step", "detections", (F.col("detections") - F.coalesce("near", F.lit(0))).alias("spurious"))
    )
    # models x slices x thresholds: bounded by the model count, never by the rows.
    slices = F.explode(F.array(*(F.lit(name) for name in SWEEP_SLICES))).alias("slice")
    frame = (
        _at_every_step(counts.select("model").distinct(), thresholds)
        .select("*", slices)
        .join(sized, "slice", "left")
        .fillna(0, ["n"])
    )
    at_or_above = W.partitionBy("model", "slice").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    running = (
        frame.join(by_slice, ["model", "slice", "step"], "left")
        .join(counts, ["model", "step"], "left")
        .fillna(0, [*values, "detections", "spurious"])
        .select(
            "model", "threshold", "slice", "n",
            *(F.sum(v).over(at_or_above).alias(v) for v in [*values, "detections", "spurious"]),
        )
    )
    least = F.greatest(F.lit(1), n)
    return running.select(
        "model", "threshold", "slice", "n",
        (F.col("hits") / least).alias("recall"),
        (F.col("coverage") / least).alias("mean_coverage"),
        (F.col("iou_hits") / least).alias("iou_recall"),
        F.col("fragmented").cast("long"), F.col("true_split").cast("long"),
        "detections", "spurious",
        (F.col("spurious") / F.greatest(F.lit(1), F.col("detections"))).alias("spurious_rate"),
    )


def sweep_counts(regions: DataFrame, detections: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Detections and spurious at each threshold: a histogram and a running sum."""
    scored = detections.withColumn("step", step_of(F.col("score"), thresholds))
    copies = F.col("copies")
    counts = (
        sp.detection_flags(regions, scored, ["model", "step"])
        .groupBy("model", "step")
        .agg(
            F.sum(copies).alias("detections"),
            F.sum(F.when(F.col("spurious"), copies).otherwise(0)).alias("spurious"),
        )
    )
    frame = _at_every_step(counts.select("model").distinct(), thresholds)
    at_or_above = W.partitionBy("model").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    return (
        frame.join(counts, ["model", "step"], "left")
        .fillna(0, ["detections", "spurious"])
        .select(
            "model", "threshold",
            F.sum("detections").over(at_or_above).alias("detections"),
            F.sum("spurious").over(at_or_above).alias("spurious"),
        )
        .withColumn("spurious_rate", F.col("spurious") / F.greatest(F.lit(1), F.col("detections")))
    )


def operating_points(swept: DataFrame, ceilings: Sequence[float] = CEILINGS) -> DataFrame:
    """Per model and ceiling the threshold of best sfx, then dark recall whose spurious rate fits.

    The lowest threshold wins ties; a model with nothing fitting has null picks.
    """
    recall = swept.groupBy("model", "threshold", "spurious_rate").agg(
        F.max(F.when(F.col("slice") == "sfx", F.col("recall"))).alias("sfx_recall"),
        F.max(F.when(F.col("slice") == "dark bg", F.col("recall"))).alias("dark_recall"),
        F.max(F.when(F.col("slice") == "all", F.col("recall"))).alias("all_recall"),
    )
    limits = F.explode(F.array(*(F.lit(float(c)) for c in ceilings))).alias("ceiling")
    fits = F.col("spurious_rate") <= F.col("ceiling") + 1e-9
    pick = F.max_by(
        F.struct("threshold", "sfx_recall", "dark_recall", "all_recall"),
        F.when(fits, F.struct("sfx_recall", "dark_recall", -F.col("threshold"))),
    )
    return (
        recall.select("*", limits)
        .groupBy("model", "ceiling")
        .agg(pick.alias("pick"), F.max(fits).alias("fitting"))
        .select("model", "ceiling", F.when(F.col("fitting"), F.col("pick")).alias("pick"))
        .select("model", "ceiling", "pick.*")
    )


def pareto_verdict(points: DataFrame) -> DataFrame:
    """Per ceiling the one model at least as good as all others on both recalls, ``split`` or ``-``."""
    best = points.groupBy("ceiling").agg(
        F.max("sfx_recall").alias("best_sfx"), F.max("dark_recall").alias("best_dark")
    )
    wins = (F.col("sfx_recall") >= F.col("best_sfx")) & (F.col("dark_recall") >= F.col("best_dark"))
    return (
        points.join(best, "ceiling")
        .groupBy("ceiling")
        .agg(
            F.count_if(wins).alias("winners"),
            F.max(F.when(wins, F.col("model"))).alias("winner"),
            F.count("threshold").alias("fitting"),
        )
        .select(
            "ceiling",
            F.when(F.col("fitting") == 0, "-").when(F.col("winners") == 1, F.col("winner"))
            .otherwise("split").alias("verdict"),
        )
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Slices present in both tallies with their deltas, in report order."""
    order = F.array_position(F.array(*(F.lit(s) for s in SLICE_ORDER)), F.col("slice")).cast("int") - 1
    names = ["recall", "mean_coverage", "iou_recall"]
    b = before.select("slice", F.col("regions").alias("n"), *(F.col(c).alias(f"before_{c}") for c in names))
    a = after.select("slice", *(F.col(c).alias(f"after_{c}") for c in names))
    return (
        b.join(a, "slice")
        .withColumn("position", order)
        .select(
            "position", "slice", "n",
            *(F.col(f"{side}_{c}") for c in names for side in ("before", "after")),
            *((F.col(f"after_{c}") - F.col(f"before_{c}")).alias(f"delta_{c}") for c in names),
        )
    )


def fixed_report(swept: DataFrame, threshold: float, models: Sequence[str]) -> DataFrame:
    """Slices by models side by side at one threshold."""
    return (
        swept.where(F.round(F.col("threshold") * 1000).cast("long") == round(threshold * 1000))  # by step: a computed input is never equal
        .groupBy("slice")
        .pivot("model", list(models))
        .agg(
            F.first("recall").alias("recall"),
            F.first("mean_coverage").alias("cov"),
            F.first("iou_recall").alias("iou"),
            F.first("spurious").alias("spurious"),
            F.first("detections").alias("detections"),
            F.first("fragmented").alias("frag"),
            F.first("true_split").alias("split"),
        )
    )


def parity(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str],
           tolerances: dict[str, float], extent: float = 64.0) -> DataFrame:
    """Rows of two result sets that differ by more than their tolerance, paired by position.

    Within a key both sides are put in ``order``, whose first column is a
    number: a key's rows are ranked in stretches of ``extent`` of it. Keys whose
    row counts differ are reported once with both counts and no pairing.

    Both sides are dealt once by key and stretch. A position is the rank there
    and the rows of the side's earlier stretches, which are counted before the
    shuffle. A pair whose rows are of one stretch meets where it is; only what
    differs or is next to an edge goes on to meet by position. Columns of the
    order behind all that are compared decide between equal values only and are
    not sent.
    """
    values, parts, order = list(tolerances), [*key, "_stretch"], list(order)
    if set(values) <= set(order):
        order = order[: max(order.index(v) for v in values) + 1]
    counts = (
        left.groupBy(*key).agg(F.count(F.lit(1)).alias("left_rows"))
        .join(right.groupBy(*key).agg(F.count(F.lit(1)).alias("right_rows")), list(key), "full_outer")
        .fillna(0, ["left_rows", "right_rows"])
    )
    first = F.col(order[0])
    stretch = F.when(F.isnan(first.cast("double")), 2**63 - 1).otherwise(F.coalesce(F.floor(first / extent), F.lit(-(2**63))))  # as they sort

    def side(rows: DataFrame, second: bool) -> DataFrame:
        return rows.select(*dict.fromkeys([*key, *order, *values]), stretch.alias("_stretch"), F.lit(second).alias("_second"))

    both = side(left, False).unionByName(side(right, True))
    second, sides = F.col("_second"), ["_a", "_b"]
    of_key = W.partitionBy(*key)
    earlier = of_key.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    before = (
        both.groupBy(*parts).agg(F.count_if(~second).alias("_a"), F.count_if(second).alias("_b"))
        .select(
            *parts, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sides),
            (F.sum("_a").over(of_key) == F.sum("_b").over(of_key)).alias("_even"),
        )
        .where("_even")
    )
    rank = F.row_number().over(W.partitionBy(*parts, "_second").orderBy(*order))
    placed = spread(both, *parts).withColumn("_rank", rank).join(before, parts).withColumn(
        "position", (F.col("_rank") + F.when(second, F.col("_b_before")).otherwise(F.col("_a_before"))).cast("int"))
    met = placed.groupBy(*parts, "position").agg(
        F.count(F.lit(1)).alias("_met"),
        *(F.max(F.when(second == is_second, F.col(v))).alias(f"{name}_{v}") for name, is_second in (("a", False), ("b", True)) for v in values),
    )
    off = F.lit(False)
    for v, tolerance in tolerances.items():
        off = off | (F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) > tolerance)
    moved = (
        met.where((F.col("_met") < 2) | off)
        .groupBy(*key, "position").agg(*(F.max(f"{name}_{v}").alias(f"{name}_{v}") for name in "ab" for v in values))
        .where(off)
        .select(*key, "position", F.lit("value").alias("reason"))
    )
    uneven = counts.where("left_rows <> right_rows").select(
        *key, F.lit(None).cast("int").alias("position"), F.lit("count").alias("reason")
    )
    return moved.unionByName(uneven)
