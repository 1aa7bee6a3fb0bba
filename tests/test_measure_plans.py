"""Measures keep one layout: shuffles of their plans, both zeros, rows without a box."""

import pytest
from pyspark.sql import functions as F

from inkfield.operators import evaluate as ev, spatial as sp
from inkfield.plans.catalog import QUERIES

BOX = "page_id LONG, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"


@pytest.mark.parametrize("name, most", [("region_measures", 6), ("slice_tally", 11), ("sweep", 26)])
def test_shuffles_without_broadcast(spark, name, most):
    """As on large tables: no side is small enough to be broadcast."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") <= most


def test_both_zeros_and_boxes_with_nulls(spark):
    regions = spark.createDataFrame([(1, 0.0, -0.0, 10.0, 10.0), (1, -0.0, 0.0, 10.0, 10.0), (1, None, 0.0, 5.0, 5.0), (None, 0.0, 0.0, 5.0, 5.0)], BOX)
    found = spark.createDataFrame([(1, -0.0, 0.0, 5.0, 10.0), (1, 0.0, -0.0, 5.0, 10.0)], BOX).toDF("page_id", "dx", "dy", "dw", "dh")
    rows = sp.with_measures(regions, found).select("page_id", "x", "coverage", "touching", F.col("best_iou").alias("iou")).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, 0.0, 0.5, 2, 0.5), (1, -0.0, 0.5, 2, 0.5), (1, None, 0.0, 0, 0.0), (None, 0.0, 0.0, 0, 0.0)], key=repr)


def test_no_detections_and_no_regions(spark):
    regions = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], BOX)
    none = spark.createDataFrame([], BOX)
    assert [r.coverage for r in sp.with_measures(regions, none.toDF("page_id", "dx", "dy", "dw", "dh")).collect()] == [0.0]
    assert sp.with_measures(none, regions.toDF("page_id", "dx", "dy", "dw", "dh")).count() == 0


def test_sweep_columns_only_where_needed(spark, monkeypatch):
    """Detections that grow as the threshold falls are one another's hull: no sample column is made; crossing ones still are."""
    seen = []
    whole = sp.with_columns_of
    monkeypatch.setattr(sp, "with_columns_of", lambda pairs, wanted: seen.append(whole(pairs, wanted)) or seen[-1])
    regions = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0)], "page_id int, x double, y double, w double, h double")
    schema = "page_id int, dx double, dy double, dw double, dh double, model string, step int"
    growing = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 5.0, "a", 9), (1, 5.0, 5.0, 10.0, 5.0, "a", 9), (1, 5.0, 0.0, 10.0, 10.0, "a", 4), (1, 0.0, 0.0, 20.0, 20.0, "a", 2)], schema)
    crossing = spark.createDataFrame([(1, 0.0, 5.0, 20.0, 5.0, "b", 9), (1, 5.0, 0.0, 5.0, 20.0, "b", 3)], schema)
    got = [(r.model, r.step, round(r.coverage * 400)) for r in ev._region_steps(regions, growing.unionByName(crossing)).collect()]
    assert sorted(got) == [("a", 2, 300), ("a", 4, 50), ("a", 9, 50), ("b", 3, 75), ("b", 9, 100)]
    assert {r["model"] for r in seen[0].where("col IS NOT NULL").select("model").distinct().collect()} == {"b"}


def test_sweep_deals_its_boxes_once(spark):
    """Regions' states and the spurious counts read the same shuffles of the boxes; each is written once."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    of_pages = [line for line in plan.splitlines() if "Exchange hashpartitioning(page_id" in line and "ReusedExchange" not in line]
    assert len(of_pages) <= 5  # regions, detections, both by cell, detections with what is near
    assert plan.count("ReusedExchange") >= 2
