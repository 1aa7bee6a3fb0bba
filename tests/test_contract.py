"""Queries against their SQL on the smallest test data."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
CHECKED = [
    "slice_tally", "region_measures", "spurious", "settings_state", "strips", "reply_parse", "request_plan", "label_build",
    "wide_text", "label_union", "quota_head", "split", "stage_by_language", "stage_stub", "components_by_join", "component_boxes", "max_rect", "otsu", "line_pack", "repeat_guard", "gap_segments", "stream_rebuild",
    "crop_plan", "crop_targets", "reading_order", "fit_layout", "fit_labels", "render_plan", "balloons", "balloon_lobes",
    "fields_around", "parity", "lobe_order", "sweep", "page_report", "misses", "fragments",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def bag(frame):
    frame = frame[sorted(frame.columns)]
    return sorted([tuple(plain(v) for v in row) for row in frame.itertuples(index=False)], key=repr)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 9


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    ours = contract.queries()[name](spark, FOLDER).toPandas()
    wanted = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(wanted.columns)
    assert bag(ours) == bag(wanted)


def test_streams_do_not_depend_on_arrivals(spark):
    """One arrival, and many out of order, give the same rows."""
    from pyspark.sql import functions as F

    from inkfield.plans.streams import drain
    from inkfield.streaming import jobs

    said = [(1, 0, "progress"), (1, 5, "result"), (1, 7, "progress"), (2, 3, "progress"), (2, 90, "progress"), (3, 4, "error"), (3, 4, "progress"), (9, 500, "progress")]
    rows = spark.createDataFrame([(r, 1_000_000 * (1000 + s), t) for r, s, t in said], "request_id LONG, at_us LONG, type STRING")
    rows = rows.withColumn("at", F.timestamp_micros("at_us"))
    want = {(1, 1_000_000, "result", 1), (2, 1_003_000, "abandoned", 1), (2, 1_090_000, "abandoned", 1), (3, 1_004_000, "error", 1)}
    for arrives, arrivals in ((F.lit(0), 1), (F.col("at_us"), 4), (F.col("at_us") - 8_000_000 * F.col("request_id"), 6)):
        got = drain(rows, arrives, lambda s: jobs.request_lifecycle(s, "100 seconds", 60_000), "append", arrivals)
        assert {tuple(r) for r in got.select("request_id", "opened_ms", "status", "progress").collect()} == want


def test_requests_call_no_python_and_part_after_the_silence(spark, tmp_path):
    """A silence of exactly the patience, in milliseconds, joins; one millisecond more parts."""
    from pyspark.sql import functions as F

    from inkfield.plans.streams import drain
    from inkfield.streaming import jobs

    said = [(1, 0, "progress"), (1, 60_000_999, "progress"), (1, 120_001_000, "error"), (9, 500_000_000, "progress")]
    rows = spark.createDataFrame([(r, 1_000_000_000 + us, t) for r, us, t in said], "request_id LONG, at_us LONG, type STRING").withColumn("at", F.timestamp_micros("at_us"))
    plans = []

    def job(stream):
        ended = jobs.request_lifecycle(stream, "100 seconds", 60_000)
        plans.append(ended._jdf.queryExecution().analyzed().toString())
        return ended

    got = drain(rows, F.col("at_us"), job, "append", 2).select("request_id", "opened_ms", "status", "progress").collect()
    assert {tuple(r) for r in got} == {(1, 1_000_000, "abandoned", 2), (1, 1_120_001, "error", 0)}
    assert "InPandas" not in plans[0]
