"""Parity of two result sets: positions across stretches, and what is shuffled."""

import random

from pyspark.sql import functions as F

from inkfield.operators import evaluate as ev

SCHEMA = "page int, x double, y double, name string"


def wanted(left, right):
    """By sorting each page in memory."""
    out = []
    for page in {r[0] for r in left + right}:
        a, b = (sorted((r for r in rows if r[0] == page), key=lambda r: r[1:]) for rows in (left, right))
        if len(a) != len(b):
            out.append((page, None, "count"))
        else:
            out += [(page, n + 1, "value") for n, (p, q) in enumerate(zip(a, b)) if abs(p[1] - q[1]) > 0.5 or abs(p[2] - q[2]) > 0.5]
    return sorted(out, key=repr)


def test_pairs_meet_across_stretches(spark):
    draw = random.Random(5)
    left = [(page, draw.choice([63.9, 64.0, 64.2, draw.uniform(-200, 200)]), float(draw.randint(0, 3)), f"n{i}") for page in range(6) for i in range(40)]
    moved = [(p, x + draw.choice([0, 0, 0.3, -0.3, 0.7, 70]), y, name) for p, x, y, name in left if not (p == 3 and y == 0)]
    got = ev.parity(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(moved, SCHEMA), ["page"], ["x", "y", "name"], {"x": 0.5, "y": 0.5})
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(left, moved)


def test_sides_are_dealt_once_without_names(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = spark.createDataFrame([(1, 1.0, 1.0, "a")], SCHEMA).where(F.col("page") > 0)
    try:
        plan = ev.parity(rows, rows.withColumn("x", F.col("x") + 1), ["page"], ["x", "y", "name"], {"x": 0.5, "y": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    dealt = [line for line in plan.splitlines() if "Repartition" in line]
    assert len(dealt) == 1 and "row_number" in plan
    assert plan.count("name#") == plan.count("LogicalRDD [")  # read, and dropped at once


def test_rows_without_key_or_number(spark):
    left = [(None, 1.0, 1.0, "a"), (1, None, 1.0, "b"), (1, 5.0, 1.0, "c"), (2, float("nan"), 1.0, "d"), (2, 900.0, 1.0, "e")]
    right = [(None, 1.0, 1.0, "a"), (1, None, 1.0, "b"), (1, 9.0, 1.0, "c"), (2, float("nan"), 1.0, "d"), (2, 901.0, 1.0, "e")]
    got = ev.parity(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["page"], ["x", "y", "name"], {"x": 0.5, "y": 0.5})
    rows = sorted(map(tuple, got.collect()), key=repr)
    # NaN less NaN is no number, which is more than any tolerance here as in SQL.
    assert rows == sorted([(None, None, "count"), (None, None, "count"), (1, 2, "value"), (2, 1, "value"), (2, 2, "value")], key=repr)
