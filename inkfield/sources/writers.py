"""Sinks: label sets, sweep stores, metric logs, run reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.sources.json_files import as_json, located, parsed, read_items, write_items

ROLES = ("text", "ignore", "background")


def write_labels(records: DataFrame, path: str, key: str = "page_id") -> None:
    """Records in (kind, key) order over range-partitioned files."""
    records.repartitionByRange("kind", key).sortWithinPartitions("kind", key).write.mode("overwrite").parquet(path)


def incremental(spark: SparkSession, store: str, requested: Sequence[str], compute: Callable[[list[str]], DataFrame]) -> DataFrame:
    """A store by model: only models not in it are computed; the result keeps the requested order.

    Each model is its own partition, overwritten alone, so a failed run leaves
    the others whole.
    """
    try:
        have = {row[0] for row in spark.read.parquet(store).select("model").distinct().collect()}  # one per model
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        have = set()
    todo = [m for m in requested if m not in have]
    if todo:
        compute(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(store)
    names = F.array(*(F.lit(m) for m in requested))
    stored = spark.read.parquet(store).withColumn("model", F.col("model").cast("string"))
    return stored.where(F.col("model").isin(list(requested))).withColumn("model_order", F.array_position(names, F.col("model")))


def append_metrics(rows: DataFrame, path: str, run: str) -> None:
    """The rows of one run (an epoch, say) in the log; the same run again adds nothing."""
    write_items(rows.select(as_json(*rows.columns)), path, run, "lines")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's rows; schema as of a STRUCT."""
    return parsed(read_items(spark, path, "lines"), f"STRUCT<{schema}>").select("v.*")


def page_records(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """One record a page with its boxes as arrays of four by role, in reading order of their places.

    A record is a page with all its boxes, as the stored form is; no more than
    one page's boxes are ever held together.
    """
    corner = F.array(*(F.col(c).cast("double") for c in "xywh"))
    of_page = boxes.groupBy("page_id").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("y", "x", "w", "h", corner.alias("box"))))).alias(role) for role in ROLES)
    )
    empty = F.array().cast("array<array<double>>")
    return pages.join(of_page, "page_id", "left").withColumns({role: F.coalesce(F.transform(role, lambda s: s["box"]), empty) for role in ROLES})


def write_records(records: DataFrame, path: str, run: str) -> None:
    """Page records in (kind, page) order, each file an array of its range."""
    ordered = records.repartitionByRange("kind", "page_id").sortWithinPartitions("kind", "page_id")
    write_items(ordered.select(as_json(*records.columns)), path, run)


def write_run_report(outputs: DataFrame, path: str, run: str) -> None:
    """Model outputs with errors and times, a line each; a run that is there already stays as it is."""
    write_items(outputs.select(as_json(*outputs.columns)), path, run, "lines")


def stored(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """One file a row, under a name of the attempt's own, so that a repeated task never meets a half-written one."""
    system, root = located(path)
    system.create_dir(root, recursive=True)
    for batch in batches:
        places = []
        for content in batch.column("content"):
            name = uuid.uuid4().hex
            places.append(f"{path}/{name}")
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(content.as_buffer() or b"")
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(places, pa.string())], ["name", "location"])


def write_payloads(payloads: DataFrame, path: str) -> DataFrame:
    """Each row's content as a file; gives the index of names and locations, kept beside the files, which alone says what counts."""
    index = f"{path}/index"
    payloads.select("name", "content").mapInArrow(lambda b: stored(b, f"{path}/files"), "name string, location string").write.parquet(index)
    return payloads.sparkSession.read.parquet(index)
