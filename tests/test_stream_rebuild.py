"""The rebuild stream calls no Python for a group; rows come out in order however they arrive."""

import tempfile

from pyspark.sql import functions as F

from inkfield.plans import streams
from inkfield.plans.catalog import QUERIES
from inkfield.streaming import jobs


def test_no_python_for_a_group(spark, monkeypatch):
    plans = []

    def seen(rows, arrives, job, mode, **more):
        inbox = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        plans.append(job(spark.readStream.schema(rows.schema).parquet(inbox))._jdf.queryExecution().analyzed().toString())
        return rows.withColumn("rebuild", F.lit(False))

    monkeypatch.setattr(streams, "drain", seen)
    QUERIES["stream_rebuild"](spark, "/root/testdata/sf0.001")
    assert plans and "Pandas" not in plans[0]


def test_settled_rows(spark):
    """A row that is there twice is given twice; what the watermark has not passed is held; late arrivals take their place."""
    minute = 60_000_000
    rows = spark.createDataFrame(
        [(1, "a", 0, 0), (1, "b", 5 * minute, 1), (1, "c", 2 * minute, 2), (1, "c", 2 * minute, 2), (2, "d", 7 * minute, 2), (2, "e", 10 * minute, 3), (1, "f", 8 * minute, 3)],
        "user_id long, event string, at_us long, arrives long").withColumn("at", F.timestamp_micros("at_us"))
    out = streams.drain(rows.drop("arrives").join(rows.select("event", "arrives").distinct(), "event"), F.col("arrives"),
                        lambda s: jobs.settled_stream(s.drop("arrives"), "user_id", "3 minutes"), "append", arrivals=3)
    assert sorted((r.user_id, r.event, r.at_us // minute) for r in out.collect()) == [(1, "a", 0), (1, "b", 5), (1, "c", 2), (1, "c", 2)]
