"""What several operators of this subpackage share: scratch tables, blocks of Arrow rows, files, id keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from inkfield.session import scratch_path

#: What a null id counts as inside an operator; it leaves as null again.
NO_ID = -(2**63)
#: Spark's setting by which the shuffle files of an execution are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Powers that a worker keeps from slice to slice, and by how many they grow.
KEPT_POWERS, KEPT_STEP = 5 << 19, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bench:
    """Tables that one run of an operator writes to the shared folder and reads again.

    Lineage ends at each: what a lost executor had computed is in the shared
    folder, and nothing is computed twice.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The shuffles that made the table go as soon as it is written."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Give up the rows of tables that no later step reads."""
        for name in names:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.root}/{name}")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def ids_and_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only the two columns that count, so that no other column's name can clash; null text is empty, null id is NO_ID."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def given_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name)).alias(name)


def partitions(df: DataFrame) -> int:
    """Tasks for a step that is asked for an explicit count."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column, end to end, and each row's offset (one more than rows)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def blocks(batches: Iterable[pa.RecordBatch], size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` text bytes; a longer text has a slice to itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that never cut a group of equal keys; a table holds a batch and the group at its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0].select(keys).slice(0, 1).equals(batch.select(keys).slice(batch.num_rows - 1, 1)):
            continue  # still one group
        same = np.ones(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        cut = batch.num_rows - int(same[::-1].argmin() if not same.all() else batch.num_rows)
        held[-1] = batch.slice(0, cut)
        yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it, for a folder of any store."""
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_once(folder: str, name: str, parts: Iterable[bytes]) -> str:
    """A file under a name of this attempt's own; only names that a finished task reports are ever read."""
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{root}/{name}") as out:
        for part in parts:
            out.write(part)
    return name


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the store is a file system, read as one buffer elsewhere."""
    system, root = opened(folder)
    path = f"{root}/{name}"
    if not system.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, with A-Z lower-cased, as 64-bit hashes.

    A word's hash is a polynomial over its bytes, cut out of one running sum
    over all bytes of the slice.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, column: pa.Array):
        data, self.offsets = text_bytes(column)
        powers, inverses = Words._powers, Words._inverses
        if len(powers) <= len(data):
            size = (len(data) // KEPT_STEP + 1) * KEPT_STEP
            powers, inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x)])) for x in (self.BASE, self.INVERSE))
            if size <= KEPT_POWERS:  # a worker that has met a very long text doesn't hold on to it
                Words._powers, Words._inverses = powers, inverses
        in_word = self.in_words(data)
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        starts, ends = in_word.copy(), in_word.copy()
        if len(data):
            starts[1:] &= ~in_word[:-1] | edge[1:-1]
            ends[:-1] &= ~in_word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        upper = (data >= 65) & (data <= 90)
        code = (data + (upper * np.uint8(32))).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers[: len(data)])])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverses[self.starts])
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, its first word

    @staticmethod
    def in_words(data: np.ndarray) -> np.ndarray:
        """Which bytes belong to words."""
        return ~((data == 32) | ((data >= 9) & (data <= 13)))

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 of the slice are left out."""
        n = max(0, len(self.hashes) - k + 1)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * self.BASE + self.hashes[i : i + n]
        return mix(total)


def struct_fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
