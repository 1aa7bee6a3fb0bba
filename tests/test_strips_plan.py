"""Strips send their tiles few times, and null keys stay a group of their own."""

from pyspark.sql import functions as F

from inkfield.operators import sequences as sq
from inkfield.operators.ordered import islands


def test_strips_make_their_tiles_twice_at_most(spark):
    """Tiles joined with their columns, for the rows and for the summaries of their buckets."""
    tiles = spark.createDataFrame(
        [(d, f"{d}-{n}", 0.0, 100.0 * n, 300.0, 100.0) for d in (1, None) for n in range(4)] + [(2, "2-0", 0.0, 0.0, 300.0, 100.0), (2, "2-1", 0.0, 100.0, 300.0, 100.0)],
        "doc_id long, tile_id string, x double, y double, w double, h double")
    found = sq.strips(tiles)
    assert sorted((r.tile_id, r.tiles, r.position, r.height) for r in found.collect()) == [(f"1-{n}", 4, n, 400.0) for n in range(4)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 5


def test_islands_of_null_keys(spark):
    rows = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (0, 0, 1), (0, 1, 9), (0, 6, 10)], "k int, at int, v int")
    out = islands(rows, ["k"], ["at"], F.floor(F.col("at") / 2), lag={"before": "v"}, opens=F.col("v") - F.col("before") > 1, rank="n")
    assert sorted(((r.k if r.k is not None else -1), r.at, r.before, r.island, r.n) for r in out.collect()) == [
        (-1, 0, None, 0, 1), (-1, 1, 1, 0, 2), (0, 0, None, 0, 1), (0, 1, 1, 1, 2), (0, 6, 9, 1, 3)]


def test_strips_across_buckets(spark):
    """Runs that go on over bucket borders, through buckets without an own tile of the column, against sorting in memory."""
    import random

    draw, rows = random.Random(8), []
    for doc in range(5):
        for left in (0.0, 30.0, 31.0, 63.0):
            y = 0.0
            for n in range(40):
                h = draw.choice([10.0, 20.0, 90.0])
                rows.append((doc, f"{doc}-{left}-{n}", left + draw.choice([0, 0, 1, 2]), y + draw.choice([0, 0, 1]), 300.0 + draw.choice([0, 2]), h, n))
                y += h + draw.choice([0, 0, 0, 0, 0, 50])
    tiles = spark.createDataFrame(rows, "doc_id int, tile_id string, x double, y double, w double, h double, n int")
    want = []
    for doc, name, x, y, w, h, n in rows:
        held = sorted((r for r in rows if r[0] == doc and abs(r[2] - x) <= 2 and abs(r[4] - w) <= 2), key=lambda r: (r[3], r[1]))
        runs = [[held[0]]]
        for above, r in zip(held, held[1:]):
            runs.append([r]) if abs(r[3] - above[3] - above[5]) > 2 else runs[-1].append(r)
        run = next(run for run in runs if any(r[1] == name for r in run))
        if len(run) >= 3:
            place = [r[1] for r in run].index(name)
            want.append((name, n, len(run), place, run[-1][3] + run[-1][5] - min(r[3] for r in run)))
    for bucket_height in (64.0, 256.0, 1e6):
        got = sq.strips(tiles, bucket_height, keep=["n"]).select("tile_id", "n", "tiles", "position", "height").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_tiles_are_dealt_once(spark):
    """The runs and what joins them over buckets read one shuffle of the tiles; no id is joined with itself."""
    from inkfield.plans.catalog import QUERIES

    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["best_targets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line and "ReusedExchange" not in line]
    assert len(dealt) == 1 and "hashpartitioning(tile_id" not in plan
