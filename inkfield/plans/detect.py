"""Detection evaluation by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.functions import geometry as g
from inkfield.operators import evaluate as ev, spatial as sp
from inkfield.plans import standins as st
from inkfield.plans.registry import query, rounded


@query
def slice_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.slice_tally(st.regions(spark, sf_dir), st.detections(spark, sf_dir), st.pages(spark, sf_dir)))


@query
def region_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.with_measures(st.regions(spark, sf_dir), st.detections(spark, sf_dir))
    return rounded(rows.select("box_id", "coverage", "best_iou", "pieces", "single", "touching"))


@query
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.best_match(st.regions(spark, sf_dir), st.detections(spark, sf_dir))
    return rounded(rows.select("box_id", "iou", "score", "dx", "dy", "dw", "dh"))


@query
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, det = g.box(), g.box("d")
    return rounded(
        sp.overlap_join(st.regions(spark, sf_dir), st.detections(spark, sf_dir)).select(
            "box_id", "det_id",
            g.intersection(region, det).alias("common"),
            g.iou(region, det).alias("iou"),
            g.containment(region, det).alias("containment"),
            g.encloses(region, det).alias("detection_inside"),
        )
    )


@query
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sp.containment_pairs(st.regions(spark, sf_dir), st.detections(spark, sf_dir), 0.5)
    return pairs.select("box_id", "det_id")


@query
def spurious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.spurious(st.detections(spark, sf_dir), st.regions(spark, sf_dir)).select("det_id", "model")


@query
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.merged(st.detections(spark, sf_dir), st.regions(spark, sf_dir))
    return rows.select("det_id", F.col("regions_held").cast("long"))


@query
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.fragments(st.regions(spark, sf_dir), st.detections(spark, sf_dir))
    return rounded(rows.select("box_id", "pieces", "single", "true_split"))


@query
def detection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.detection_totals(st.regions(spark, sf_dir), st.detections(spark, sf_dir)))


@query
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.page_report(st.pages(spark, sf_dir), st.regions(spark, sf_dir), st.detections(spark, sf_dir))


@query
def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.misses(st.regions(spark, sf_dir), st.detections(spark, sf_dir), "dark"), 2)


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sweep(st.regions(spark, sf_dir), st.detections(spark, sf_dir))


@query
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_swept(spark, sf_dir))


@query
def sweep_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.sweep_counts(st.regions(spark, sf_dir), st.detections(spark, sf_dir)))


# The stand-in detections are mostly noise: ceilings around their spurious rates.
STANDIN_CEILINGS = [0.05, 0.2, 0.25, 0.3, 0.4, 0.6]


@query
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.operating_points(_swept(spark, sf_dir), STANDIN_CEILINGS))


@query
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pareto_verdict(ev.operating_points(_swept(spark, sf_dir), STANDIN_CEILINGS))


@query
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, pages = (f(spark, sf_dir) for f in (st.regions, st.detections, st.pages))
    first, *_, last = _models(found)
    before = ev.slice_tally(regions, found.where(F.col("model") == first), pages)
    after = ev.slice_tally(regions, found.where(F.col("model") == last), pages)
    return rounded(ev.compare(before, after))


def _models(rows: DataFrame) -> list[str]:
    """Names of all models in order, a handful."""
    return sorted(r[0] for r in rows.select("model").distinct().collect())


@query
def fixed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = _swept(spark, sf_dir)
    return rounded(ev.fixed_report(swept, 0.25, _models(swept)))


@query
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.detections(spark, sf_dir)
    moved = found.withColumn(
        "dx", F.col("dx") + F.when(F.col("score") > 0.9, 2e-6).otherwise(5e-7)
    ).where(~((F.col("model") == "O") & (F.col("score") < 0.01)))
    return ev.parity(
        found, moved, ["page_id"], ["dx", "dy", "dw", "dh", "score", "det_id"],
        {"dx": 1e-6, "dy": 1e-6, "dw": 1e-6, "dh": 1e-6, "score": 1e-5},
    )
