"""Joins of box tables by geometry, and the measures taken over the joined pairs.

A region table has ``page_id, x, y, w, h`` and a detection table ``page_id, dx,
dy, dw, dh`` (more columns ride along). A measure of a region depends only on
its box, so equal boxes on a page are collapsed to one row with a count before
the join and every measure is keyed by (page, box): copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkfield.functions import geometry as g
from inkfield.session import spread

REGION_KEY = ["page_id", "x", "y", "w", "h"]
DETECTION_BOX = ["dx", "dy", "dw", "dh"]

COVER_HIT = 0.5        # a region counts as found
IOU_HIT = 0.5
PRECISION_HIT = 0.25   # below this inside share, both ways, a detection is spurious
FRAGMENT_SHARE = 0.05  # share of a region a piece must hold
WHOLE_SHARE = 0.9      # a single detection covering this much is not a split

CELL = 512.0
TILE_CELL = 2048.0      # of documents: a tile that spans cells is sent once for each


def _to_cells(df: DataFrame, b: g.Box, cell: float) -> DataFrame:
    """One row per grid cell the box reaches; boxes without area reach none."""
    return (
        df.where((b.w > 0) & (b.h > 0))
        .withColumn("_cx", F.explode(F.sequence(F.floor(b.x / cell), F.floor(b.right / cell))))
        .withColumn("_cy", F.explode(F.sequence(F.floor(b.y / cell), F.floor(b.bottom / cell))))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = ("page_id",),
    left_prefix: str = "",
    right_prefix: str = "d",
    cell: float = CELL,
) -> DataFrame:
    """Pairs of boxes with positive common area, within equal ``on`` columns.

    The equi key is (on, grid cell), so a page holding a large part of all rows
    spreads over its cells, and adaptive execution can split a heavy cell. A
    pair found in several cells is kept in the one holding the top left corner
    of its common area.
    """
    a, b = g.box(left_prefix), g.box(right_prefix)
    keys = [*on, "_cx", "_cy"]
    pairs = _to_cells(left, a, cell).join(_to_cells(right, b, cell), keys)
    owner = (F.floor(F.greatest(a.x, b.x) / cell) == F.col("_cx")) & (
        F.floor(F.greatest(a.y, b.y) / cell) == F.col("_cy")
    )
    return pairs.where(owner & (g.intersection(a, b) > 0)).drop("_cx", "_cy")


def collapse(df: DataFrame, columns: Sequence[str], count: str) -> DataFrame:
    """Equal rows as one row with a count, combined before the shuffle."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))


def measured_pairs(regions: DataFrame, detections: DataFrame, extra: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """Distinct region boxes joined to distinct detection boxes, with every pair measure.

    With ``labels`` a region box comes once for each of its labels, with their count ``n``.
    """
    boxes = collapse(regions, [*REGION_KEY, *labels], "n") if labels else regions.select(*REGION_KEY).distinct()
    found = collapse(detections, ["page_id", *DETECTION_BOX, *extra], "copies")
    region, det = g.box(), g.box("d")
    shared = g.intersection(det, region)
    c0, c1 = g.sample_range(region.x, region.w, det.x, det.right)
    r0, r1 = g.sample_range(region.y, region.h, det.y, det.bottom)
    return overlap_join(boxes, found).select(
        *boxes.columns,
        *DETECTION_BOX,
        *extra,
        "copies",
        g.iou(det, region).alias("iou"),
        (shared / F.greatest(region.area, F.lit(1.0))).alias("piece"),
        g.encloses(det, region).alias("region_inside"),
        g.encloses(region, det).alias("detection_inside"),
        c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1"),
    )


def near_boxes(region: g.Box, det: g.Box) -> Column:
    """Whether either box has PRECISION_HIT of it in the other: the detection is not spurious."""
    return (g.encloses(det, region) >= PRECISION_HIT) | (g.encloses(region, det) >= PRECISION_HIT)


def rect_cells(prefix: str = "") -> Column:
    c0, c1, r0, r1 = (F.col(prefix + n) for n in ("c0", "c1", "r0", "r1"))
    return F.when((c1 >= c0) & (r1 >= r0), (c1 - c0 + 1).cast("long") * (r1 - r0 + 1)).otherwise(F.lit(0).cast("long"))


def grid_cells() -> Column:
    """Number of sample points of a region."""
    return (g.sample_count(F.col("w")).cast("long") * g.sample_count(F.col("h")))


def box_number() -> Column:
    """A long made from a region's box.

    Spark normalises floating-point keys anew in every grouping, window and
    join, so a layout by them is not seen again; a layout by this number is.
    """
    return F.xxhash64("page_id", *(F.col(c) + 0.0 for c in REGION_KEY[1:]))  # + 0.0: the two zeros are one


def laid_out(pairs: DataFrame) -> DataFrame:
    """Pairs dealt by ``_box`` once: whatever is grouped by it and more columns stays where it is."""
    return spread(pairs.withColumn("_box", box_number()), "_box")


def join_boxes(rows: DataFrame, measures: DataFrame, how: str = "left") -> DataFrame:
    """Region rows with what was measured of their box, by ``_box`` alone so that the measures are not dealt again.

    The box itself is compared by order, as equality would make it a key of the join.
    """
    theirs = measures.withColumnsRenamed({c: f"_of_{c}" for c in ["_box", *REGION_KEY]})
    same = F.col("_box") == F.col("_of__box")
    for c in REGION_KEY:
        same = same & (F.col(c) <= F.col(f"_of_{c}")) & (F.col(c) >= F.col(f"_of_{c}"))
    return rows.withColumn("_box", box_number()).join(theirs, same, how).drop("_box", *(f"_of_{c}" for c in ["_box", *REGION_KEY]))


def with_columns_of(pairs: DataFrame, wanted: Column) -> DataFrame:
    """Every pair once with a null ``col``, and where ``wanted`` once per sample column it covers, with its row masks.

    So one grouping by (region, col) makes both the measures of a region (the
    group of the null) and the unions of its columns.
    """
    covered = F.when(wanted & (F.col("c1") >= F.col("c0")), F.sequence("c0", "c1")).otherwise(F.array().cast("array<int>"))
    masks = g.row_masks(F.col("r0"), F.col("r1"))
    return pairs.withColumns({f"m{i}": m for i, m in enumerate(masks)}).withColumn(
        "col", F.explode(F.concat(F.array(F.lit(None).cast("int")), covered)))


def column_unions() -> list[Column]:
    return [F.bit_or(f"m{i}").alias(f"m{i}") for i in range(g.MASK_WORDS)]


def mask_size(prefix: str = "m") -> Column:
    total = F.bit_count(F.col(f"{prefix}0"))
    for word in range(1, g.MASK_WORDS):
        total = total + F.bit_count(F.col(f"{prefix}{word}"))
    return total.cast("long")


def region_measures(regions: DataFrame, detections: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per region box (and ``by``): coverage, best_iou, pieces, single, detections touching, and its ``_box``.

    Boxes no detection overlaps give no row; see ``with_measures``. Pairs are
    dealt by region box once and all steps keep that layout, ``join_boxes`` of
    the result too. The common case, one detection holding all
    others' part of the region, has none of its sample columns enumerated.
    """
    keys = ["_box", *REGION_KEY, *by]
    of_region = W.partitionBy(*keys)
    real = rect_cells() > 0
    pairs = laid_out(measured_pairs(regions, detections, by)).select(
        "*", F.max(rect_cells()).over(of_region).alias("largest"),
        *(f(F.when(real, F.col(c))).over(of_region).alias(f"hull_{c}") for f, c in ((F.min, "c0"), (F.max, "c1"), (F.min, "r0"), (F.max, "r1"))),
    )
    several = F.coalesce(rect_cells("hull_"), F.lit(0)) != F.col("largest")
    measure, column = F.col("col").isNull(), F.col("col").isNotNull()
    return (
        with_columns_of(pairs, several)
        .groupBy(*keys, "col")
        .agg(
            F.max("iou").alias("best_iou"),
            F.sum(F.when(F.col("piece") > FRAGMENT_SHARE, F.col("copies")).otherwise(0)).alias("pieces"),
            F.max("region_inside").alias("single"),
            F.sum("copies").alias("touching"),
            F.max("largest").alias("largest"),
            *column_unions(),
        )
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(column, mask_size())), F.max("largest")).alias("covered"),
            *(F.max(F.when(measure, F.col(c))).alias(c) for c in ("best_iou", "pieces", "single", "touching")),
        )
        .select(*keys, (F.col("covered") / grid_cells()).alias("coverage"), "best_iou", "pieces", "single", "touching")
    )


def with_measures(regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Every region row with its measures; zeros where no detection overlaps."""
    measures = region_measures(regions, detections)
    zeros = {"coverage": 0.0, "best_iou": 0.0, "pieces": 0, "single": 0.0, "touching": 0}
    return join_boxes(regions, measures).fillna(zeros)


def best_match(regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Per region the detection of greatest IoU, the highest score then smallest box first on ties.

    Unmatched regions keep a null detection and an IoU of 0.
    """
    boxes = regions.select(*REGION_KEY).distinct()
    found = detections.groupBy("page_id", *DETECTION_BOX).agg(F.max("score").alias("score"))
    region, det = g.box(), g.box("d")
    best = (
        overlap_join(boxes, found)
        .withColumn("iou", g.iou(det, region))
        .groupBy(*REGION_KEY)
        .agg(
            F.max_by(
                F.struct("iou", "score", *DETECTION_BOX),
                F.struct("iou", "score", *(-F.col(c) for c in DETECTION_BOX)),
            ).alias("best")
        )
        .select(*REGION_KEY, "best.*")
    )
    return regions.join(best, REGION_KEY, "left").fillna({"iou": 0.0})


def containment_pairs(outer: DataFrame, inner: DataFrame, share: float) -> DataFrame:
    """Pairs in which at least ``share`` of the inner box (``d`` prefix) lies in the outer."""
    return overlap_join(outer, inner).where(g.encloses(g.box(), g.box("d")) >= share)


def detection_flags(regions: DataFrame, detections: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct detection boxes with ``copies``, ``spurious`` and ``merged`` flags.

    Spurious: no region shares PRECISION_HIT of either box. Merged: the box
    holds COVER_HIT of two or more regions (copies of a region each count). A
    page without regions has only spurious detections.
    """
    labelled = collapse(regions, REGION_KEY, "region_copies")
    found = collapse(detections, ["page_id", *DETECTION_BOX, *extra], "copies")
    boxes = found.select("page_id", *DETECTION_BOX).distinct()
    region, det = g.box(), g.box("d")
    near = near_boxes(region, det)
    held = F.when(g.encloses(det, region) >= COVER_HIT, F.col("region_copies")).otherwise(0)
    hits = (
        overlap_join(labelled, boxes)
        .groupBy("page_id", *DETECTION_BOX)
        .agg(F.max(near).alias("near"), F.sum(held).alias("held"))
    )
    return found.join(hits, ["page_id", *DETECTION_BOX], "left").select(
        "page_id", *DETECTION_BOX, *extra, "copies",
        (~F.coalesce("near", F.lit(False))).alias("spurious"),
        (F.coalesce("held", F.lit(0)) > 1).alias("merged"),
        F.coalesce("held", F.lit(0)).alias("held"),
    )


def spurious(detections: DataFrame, regions: DataFrame) -> DataFrame:
    """Detection rows that match no region (anti join)."""
    flags = detection_flags(regions, detections).where(~F.col("spurious"))
    return detections.join(flags, ["page_id", *DETECTION_BOX], "left_anti")


def merged(detections: DataFrame, regions: DataFrame) -> DataFrame:
    """Detection rows covering two or more regions, with how many."""
    flags = detection_flags(regions, detections).where("merged")
    return detections.join(
        flags.select("page_id", *DETECTION_BOX, F.col("held").alias("regions_held")),
        ["page_id", *DETECTION_BOX],
    )


def fragments(regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Regions lying in more than one piece; ``true_split`` when no single box covers them."""
    return (
        with_measures(regions, detections)
        .where("pieces > 1")
        .withColumn("true_split", F.col("single") < WHOLE_SHARE)
    )


def tiles_touched(tiles: DataFrame, drawn: DataFrame, on: Sequence[str], cell: float = TILE_CELL) -> DataFrame:
    """Tiles with strictly positive overlap with a drawn rectangle of the same document."""
    return overlap_join(tiles, drawn, on=on, cell=cell)


def owner_of(
    tiles: DataFrame, drawn: DataFrame, on: Sequence[str], drawn_key: Sequence[str],
    tile_order: Sequence[str], cell: float = TILE_CELL,
) -> DataFrame:
    """Per drawn rectangle the tile holding most of it, the first in order on ties; none at zero overlap."""
    area = g.intersection(g.box(), g.box("d"))
    first = F.struct(F.col("area"), *(-F.col(c) for c in tile_order))
    return (
        overlap_join(tiles, drawn, on=on, cell=cell)
        .withColumn("area", area)
        .groupBy(*drawn_key)
        .agg(F.max_by(F.struct("area", *tile_order), first).alias("owner"))
        .select(*drawn_key, "owner.*")
    )
