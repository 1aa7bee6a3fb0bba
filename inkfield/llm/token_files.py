"""Token ids as flat binary files.

A shard is three flat little-endian files: the ids of its documents end to end
(unsigned 16 bit, or 32 bit for larger vocabularies), the 64-bit offsets of its
documents in the whole corpus (one more than documents), and their 64-bit
document ids. Documents are in ascending order of id over all shards. Where a
shard begins is the prefix sum of the sizes of the shards before it.

Files are written under names of the attempt's own, and only the index, written
by Spark from tasks that ended well, says which ones count; a task that is run
again leaves nothing that is read.

A null text is empty, a null id comes first; rows of one id are in an order of
their texts' hashes. An empty document has its end id alone. An empty table has
an empty index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inkfield.llm.common import Bench, blocks, given_id, ids_and_texts, mapped, opened, partitions, write_once
from inkfield.llm.tokens import encoder

#: Text bytes that are encoded at a time.
BLOCK = 4 << 20
SHARD = "part long, stem string, dtype string, n_docs long, n_tokens long"


def id_type(path: str, end_id: int) -> str:
    return "<u2" if max(encoder(path).whole.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """Every document's ids followed by the end id."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    lengths: list[np.ndarray] = []
    docs: list[np.ndarray] = []

    def id_bytes(dtype: str) -> Iterator[bytes]:
        for block in blocks(batches, BLOCK):
            ids, counts = encoder(tokenizer).encode(block.column("text"))
            lengths.append(counts + 1)
            docs.append(block.column("doc_id").to_numpy())
            yield with_end(ids, counts, end_id).astype(dtype).tobytes()

    dtype = id_type(tokenizer, end_id)
    stem = write_once(folder, "ids", id_bytes(dtype))
    if not lengths:
        system, root = opened(folder)
        system.delete_file(f"{root}/{stem}")
        return
    lengths, docs = np.concatenate(lengths), np.concatenate(docs)
    system, root = opened(folder)
    for kind, values in (("lengths", lengths), ("docs", docs)):
        with system.open_output_stream(f"{root}/{stem}.{kind}") as out:
            out.write(values.astype("<i8").tobytes())
    row = [[TaskContext.get().partitionId()], [stem], [dtype], [len(lengths)], [int(lengths.sum())]]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["part", "stem", "dtype", "n_docs", "n_tokens"])


def write_offsets(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Each shard's corpus-wide offsets, from where the shard begins and its documents' lengths."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths = mapped(folder, f"{row['stem']}.lengths", "<i8")
            offsets = row["base"] + np.concatenate([[0], np.cumsum(lengths)])
            name = write_once(folder, f"{row['stem']}.offsets", [offsets.astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pylist([row | {"offsets": name}])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of all documents; the index has a row per shard."""
    bench = Bench(docs.sparkSession, "token-files")
    own = ids_and_texts(docs, doc_id, text).withColumn("h", F.xxhash64("text"))
    sharded = own.repartitionByRange(partitions(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    shards = bench.keep(sharded.mapInArrow(lambda b: write_shard(b, folder, tokenizer, end_id), SHARD), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    placed = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return bench.keep(
        placed.repartition(partitions(docs)).mapInArrow(lambda b: write_offsets(b, folder), f"{SHARD}, base long, offsets string"), "index"
    )


def read_shard(folder: str, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets and document ids of one shard, memory-mapped."""
    return (
        mapped(folder, row["stem"], row["dtype"]),
        mapped(folder, row["offsets"], "<i8"),
        mapped(folder, f"{row['stem']}.docs", "<i8"),
    )


def checksums(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, offsets, docs = read_shard(folder, row)
            local = (offsets - row["base"]).tolist()
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local, local[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spread = index.repartition(partitions(index))
    return spread.mapInArrow(
        lambda b: checksums(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    ).select(given_id(), "start", "n_tokens", "ids_crc32")
