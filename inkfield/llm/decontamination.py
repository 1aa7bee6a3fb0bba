"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A benchmark item's
windows are its runs of ``span`` words; an item of fewer words, but not none, is one
window. A document word inside any occurrence of a window is hit.

1. Of every ``span - gram + 1`` neighbouring word grams the one of the smallest hash
   (the last of equals) is a fingerprint. Text that two sides share over ``span``
   words has the same grams there, so it chooses the same one on both. An item of
   fewer words is its own only fingerprint, and documents give all runs of that length.
2. The items' fingerprints fill a bit table, sized by their count and of 32 MB at
   most, which goes to every task. A document's fingerprints that are not in it are
   dropped where they arise; what the table lets pass is settled by the join alone.
3. A fingerprint carries the words around it that a window could still take in.
   Items' equal contexts are one row, a document's equal ones too. They are joined on
   the hash, and hits are extended word by word to both sides; ``span`` words in a row
   are an occurrence. So no text moves but around fingerprints, and each answer is exact.

A null or blank text has no words. Rows of one id are rows of their own, a null id
leaves as null. Items of one id count once and have all windows of their rows; a null
item_id counts as the empty string. Without items nothing is hit. An empty table gives
an empty result. A longer text than ``PIECE`` bytes is read in pieces that overlap by
the words of a window less one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfield.llm.common import LOWER, UPPER, Bench, Words, blocks, given_id, ids_and_texts, mix, text_bytes

SPAN, GRAM = 10, 6
PIECE, BLOCK = 1 << 20, 1 << 20
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
PRINTS = "row long, doc_id long, n_words long, hash long, at array<long>, before array<string>, gram array<string>, after array<string>"
NAMES = [c.split()[0] for c in PRINTS.split(", ")]
#: Bits a fingerprint of the table, and the least and most bits (32 MB).
ROOM, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


class Runs(Words):
    @staticmethod
    def in_words(data: np.ndarray) -> np.ndarray:
        return (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))

    def starting(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every k words of one text: the first one's number, the text's, and the hash."""
        hashes = self.runs(k)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(text[: len(hashes)] == text[k - 1 : k - 1 + len(hashes)])
        return at, text[at], mix(hashes[at] + np.uint64(salt))


def winnowed(hashes: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Which grams are the smallest, and the last of equals, of some ``window`` neighbours of their text.

    A gram is if the grams before and after it that it stands against make up a window with it.
    """
    size = len(hashes)
    reach = np.ones(size, np.int32)
    before, after = np.ones(size, bool), np.ones(size, bool)
    for d in range(1, min(window, size)):
        same = text[d:] == text[:-d]
        before[d:] &= same & (hashes[:-d] >= hashes[d:])
        before[:d] = False
        after[:-d] &= same & (hashes[d:] > hashes[:-d])
        after[-d:] = False
        reach += before
        reach += after
    return reach >= window


def pieces(column: pa.Array, span: int) -> Iterator[tuple[Runs, np.ndarray, bytes]]:
    """Words of a slice of texts, how many words of its text stand before each, and the lower-cased bytes they are cut from.

    A long text, which has a slice to itself, comes in pieces of which each begins ``span - 1`` words before the last one's end.
    """
    data, _ = text_bytes(column)
    if len(column) > 1 or len(data) <= PIECE:
        yield Runs(column), np.zeros(len(column), np.int64), data.tobytes().translate(LOWERED)
        return
    data, begin, base, size = data.tobytes(), 0, 0, PIECE
    while True:
        gap = NO_WORD.search(data, begin + size)
        end = gap.end() if gap else len(data)
        words = Runs(pa.array([data[begin:end]], pa.large_binary()))
        if end < len(data) and len(words.starts) < 2 * span:
            size *= 2  # hardly a word in it
            continue
        yield words, np.array([base]), data[begin:end].translate(LOWERED)
        if end == len(data):
            return
        base += len(words.starts) - (span - 1)
        begin += int(words.starts[len(words.starts) - (span - 1)]) if span > 1 else end - begin
        size = PIECE


def passed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    slot = hashes & np.uint64(64 * len(table) - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def prints(batches: Iterator[pa.RecordBatch], span: int, gram: int, short: list[int], table: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each text with its number of words, and one for each of its fingerprints with their places and context.

    Of items (no table) a text of fewer than ``span`` words is a fingerprint itself;
    of documents all runs of the ``short`` lengths are, and only what is in the table is given.
    """
    for block in blocks(batches, BLOCK):
        rows, ids = block.column("row").to_pylist(), block.column("doc_id").to_pylist()
        n_words = [0] * len(rows)
        found: dict[tuple, list[int]] = {}
        for words, base, data in pieces(block.column("text"), span):
            starts, ends, first, count = words.starts, words.ends, words.first, np.diff(words.first)
            for i, n in enumerate(count.tolist()):
                n_words[i] = int(base[i]) + n
            at, text, hashes = words.starting(gram)
            taken = winnowed(hashes, text, span - gram + 1)
            chosen = [(gram, span - gram, at[taken], text[taken], hashes[taken])]
            for k in short:
                at, text, hashes = words.starting(k, salt=k)
                if table is None:
                    taken = count[text] == k
                    at, text, hashes = at[taken], text[taken], hashes[taken]
                chosen.append((k, 0, at, text, hashes))
            for k, around, at, text, hashes in chosen:
                if table is not None:
                    taken = passed(table.value, hashes)
                    at, text, hashes = at[taken], text[taken], hashes[taken]
                for a, t, h in zip(at.tolist(), text.tolist(), hashes.view(np.int64).tolist()):
                    low, high = max(int(first[t]), a - around), min(int(first[t + 1]), a + k + around)
                    seen = tuple(data[x:y] for x, y in zip(starts[low:high].tolist(), ends[low:high].tolist()))
                    context = (t, h, seen[: a - low][::-1], seen[a - low : a - low + k], seen[a - low + k :])
                    found.setdefault(context, []).append(a - int(first[t]) + int(base[t]))
        of, hashes, *context = zip(*found) if found else [()] * 5
        at = [sorted(set(places)) for places in found.values()]
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array([*x, *(x[i] for i in of)], pa.int64()) for x in (rows, ids)),
                pa.array([*n_words, *(None for _ in of)], pa.int64()),
                pa.array([*none, *hashes], pa.int64()),
                pa.array([*none, *at], pa.list_(pa.int64())),
                *(pa.array([*none, *x], pa.list_(pa.binary())).cast(pa.list_(pa.string())) for x in context or [()] * 3),
            ],
            NAMES,
        )


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table in which the bit of each hash is set; of a bounded size, whatever their number."""
    bits = min(max(1 << (ROOM * hashes.count()).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def matching(a: str, b: str) -> Column:
    """How many words agree from the first on."""
    same = F.zip_with(F.col(a), F.col(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1)


def hits(docs: DataFrame, contexts: DataFrame, span: int) -> DataFrame:
    """row, context, at, low, high: where a document's fingerprint is, and how far the words agree before and after that place."""
    both = docs.alias("d").join(contexts.alias("i"), (F.col("d.hash") == F.col("i.hash")) & (F.col("d.gram") == F.col("i.gram")))
    size = F.size("d.gram")
    run = both.select(
        "row", "context", F.col("d.at").alias("at"), size.alias("size"), matching("d.before", "i.before").alias("low"), matching("d.after", "i.after").alias("after"),
        F.least(F.lit(span), F.size("i.before") + F.size("i.gram") + F.size("i.after")).alias("wanted"),
    )
    return run.where("low + size + after >= wanted").select("row", "context", "at", "low", (F.col("size") + F.col("after")).alias("high"))


def hit_words(found: DataFrame) -> DataFrame:
    """row, n_hit: words in the union of a document's hits."""
    each = found.select("row", F.explode("at").alias("at"), "low", "high")
    spans = each.groupBy("row", "at").agg(F.max("low").alias("low"), F.max("high").alias("high")).select("row", (F.col("at") - F.col("low")).alias("begin"), (F.col("at") + F.col("high")).alias("end"))
    earlier = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest("begin", F.least(F.col("end"), F.coalesce("earlier", "begin")))
    return spans.withColumn("earlier", earlier).groupBy("row").agg(F.sum(new).alias("n_hit"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = SPAN, gram: int = GRAM,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids (sorted)."""
    spark = docs.sparkSession
    bench = Bench(spark, "decontamination")
    items = bench.keep(
        benchmark.select(
            F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("doc_id"),
            F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"),
        ),
        "items",
    )
    of_items = bench.keep(items.drop("item").mapInArrow(lambda b: prints(b, span, gram, list(range(1, span))), PRINTS), "item-prints")
    short = [r[0] for r in of_items.where((F.col("n_words") > 0) & (F.col("n_words") < span)).select("n_words").distinct().collect()]  # under span numbers
    marked = of_items.where("hash IS NOT NULL").join(items.select("row", "item"), "row")
    keys = ["hash", "before", "gram", "after"]
    contexts = bench.keep(marked.select(*keys).distinct().withColumn("context", F.monotonically_increasing_id()), "contexts")
    held = bench.keep(marked.join(contexts, keys).select("context", "item").distinct(), "context-items")
    table = spark.sparkContext.broadcast(bit_table(contexts.select("hash").distinct()))
    own = ids_and_texts(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    of_docs = bench.keep(own.mapInArrow(lambda b: prints(b, span, gram, short, table), PRINTS), "prints")
    found = bench.keep(hits(of_docs.where("hash IS NOT NULL"), contexts, span), "hits")
    named = found.select("row", "context").distinct().join(held, "context").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    whole = of_docs.where("hash IS NULL").select("row", "doc_id", "n_words").join(hit_words(found), "row", "left").join(named, "row", "left")
    names = F.coalesce("item_ids", F.array().cast("array<string>"))
    return whole.select(
        given_id(), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), names.alias("item_ids"),
    )
