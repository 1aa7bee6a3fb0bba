"""Exact dedup with a heavy-hitter split.

Misra-Gries counters over the digests name the few that may be frequent; an
exact count over just those confirms them. The confirmed ones, at most
``counters`` of them, go to every task and their copies are settled there with
no shuffle. No remaining digest holds more than 1 / (counters + 1) of the rows,
so an ordinary shuffle by digest is even.

Texts are equal when identical after lower-casing A-Z; a null text is empty. Of
equal texts the row with the largest id stays, a null id being the smallest; of
repeated rows with that id exactly one stays. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfield.llm.common import Bench, ascii_lower, given_id, ids_and_texts

#: Bound of the broadcast: so many rows of a 32-byte digest and three numbers, 64 KB.
COUNTERS = 1024


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def summarise(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One partition's Misra-Gries summary; a batch is added as a summary of its own is."""
    held: Counter = Counter()
    for batch in batches:
        for pair in batch.column(0).value_counts().to_pylist():
            held[pair["values"]] += pair["counts"]
        if len(held) > counters:
            taken = sorted(held.values(), reverse=True)[counters]
            held = Counter({k: n - taken for k, n in held.items() if n > taken})
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "n"])


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, copies, keep (id and row) of the digests that surely hold over 1 / (counters + 1) of the rows."""
    candidates = (
        digests.select("digest")
        .mapInArrow(lambda batches: summarise(batches, counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    )
    counted = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest").agg(F.count("*").alias("copies"), F.max(F.struct("doc_id", "row")).alias("keep"))
    )
    least = max(1, digests.count() // (counters + 1))
    return counted.where(F.col("copies") > least)


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    bench = Bench(docs.sparkSession, "exact-dedup")
    own = ids_and_texts(docs, doc_id, text)
    digests = bench.keep(
        own.select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    winners = bench.keep(heavy_winners(digests, counters), "winners")
    tried = digests.join(F.broadcast(winners), "digest", "left")
    frequent = tried.where(F.col("copies").isNotNull())
    rest = tried.where(F.col("copies").isNull()).drop("copies", "keep")
    groups = rest.groupBy("digest").agg(F.count("*").alias("copies"), F.max(F.struct("doc_id", "row")).alias("keep"))
    settled = frequent.select("digest", "doc_id", "row", "copies", "keep").unionByName(rest.join(groups, "digest"))
    return settled.select(
        given_id(),
        F.when(F.col("keep.doc_id") != F.lit(-(2**63)), F.col("keep.doc_id")).alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns.

    Losing copies of frequent texts go before the shuffle; the rest meet by digest.
    """
    bench = Bench(docs.sparkSession, "drop-copies")
    own = ids_and_texts(docs, doc_id, text)
    digests = bench.keep(
        own.select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    winners = bench.keep(heavy_winners(digests, counters).select(F.col("digest").alias("__digest"), F.col("keep.doc_id").alias("__keep")), "winners")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    marked = docs.withColumn("__own", digest_of(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    left = (
        marked.join(F.broadcast(winners), F.col("__own") == F.col("__digest"), "left")
        .where(F.col("__keep").isNull() | (F.col("__keep") == key))
    )
    first = F.row_number().over(Window.partitionBy("__own").orderBy(key.desc()))
    return left.withColumn("__first", first).where("__first = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
