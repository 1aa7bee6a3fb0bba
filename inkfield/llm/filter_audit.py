"""Filter interaction audit: which filters overlap, and what each removes in every order of them.

Five filters, a bit each: A under 200 words; B fewer distinct words than half of
all; C over 3 in 100 code points are A-Z; D holds one of ``#$%&*|``; E identical
to the text of a smaller doc_id, anywhere in the table. Words are
``[^\\x20\\x09-\\x0D]+``, compared as they stand.

1. A to D are measured from the whole text where it is read; a row keeps its id, its part and a hash.
2. Hashes under which several ids stand name the rows that may have a copy. Only
   their texts move. For each text its smallest id is found, combined before the
   shuffle, and a left-semi join on hash, exact text and smaller id marks E.
3. The ids that fail E are united with the ids of the other failures, and the
   bits are combined per id, then counted per part: at most 32 combinations each.
4. All 120 orders are evaluated on the combinations alone.

A null text is empty: it fails A (no words) and not B or C (nought is not over
nought). A null part is the empty string. A row with a null id fails E never and
makes no other row fail it. Rows of one id are rows of their own and are not
copies of one another; repeated rows count each. A document is good (toxic) if any
label row of its id says so; null labels say nothing. An empty table gives an
empty result. Texts of any length are measured in slices; memory holds one text
and its distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkfield.llm.common import UPPER, Bench

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
SLICE = 1 << 20
CAPITALS, MARKS = UPPER.encode(), b"#$%&*|"


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The bytes in slices that end at a blank, so that no word is cut."""
    at = 0
    while at < len(data):
        to = at + size
        if to < len(data):
            blank = min((x for x in (data.find(b, to) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if x >= 0), default=len(data))
            to = blank
        yield data[at:to]
        at = to


def failures(text: str) -> int:
    """The bits of A to D."""
    data = text.encode()
    n, distinct = 0, set()
    for part in slices(data):
        words = part.split()  # of bytes: blanks are \x20 and \x09-\x0D
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marked = len(data.translate(None, MARKS)) < len(data)
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * capitals > 3 * len(text)) << 2 | marked << 3


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fails = pa.array([failures(value.as_py()) for value in batch.column("text")], pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "hash")), fails], ["doc_id", "part", "hash", "fails"])


def copies(own: DataFrame, marks: DataFrame, bench: Bench) -> DataFrame:
    """doc_id, part, hash of the rows whose text a smaller id has too."""
    held = marks.where("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = bench.keep(held.where("least < most").select("hash"), "shared")
    several = bench.keep(own.where("doc_id IS NOT NULL").join(shared, "hash", "left_semi"), "several")
    firsts = bench.keep(several.groupBy("hash", "text").agg(F.min("doc_id").alias("first")), "firsts")
    later = several.alias("a").join(
        firsts.alias("b"),
        (F.col("a.hash") == F.col("b.hash")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.doc_id")),
        "left_semi",
    )
    return later.select("doc_id", "part", "hash")


def combinations(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """part, fails (bits), and how many rows fail just these: n, good, toxic."""
    bench = Bench(docs.sparkSession, "filter-audit")
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    marks = bench.keep(own.mapInArrow(measured, "doc_id long, part string, hash long, fails int"), "marks")
    both = marks.withColumn("n", F.lit(1)).unionByName(
        copies(own, marks, bench).select("*", F.lit(COPY).alias("fails"), F.lit(0).alias("n"))
    )
    each = both.groupBy("doc_id", "part", "hash").agg(F.bit_or("fails").alias("fails"), F.sum("n").alias("n"))
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col(quality) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic) == 1, F.lit(False))).alias("toxic")
    )
    known = each.where("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "fails", "n", "good", "toxic")
    unknown = each.where("doc_id IS NULL").select("part", "fails", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(unknown).groupBy("part", "fails").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))
    )


def evaluated(combos: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counted combinations (32 a part, so 19,200 rows a part are summed)."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = combos.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    bit = sum((F.when(letter == x, 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))
    seen = steps.select("*", before.alias("before"), bit.alias("own")).select(
        "*", F.col("fails").bitwiseAND(F.col("before")).alias("earlier"), (F.col("fails").bitwiseAND(F.col("own")) > 0).alias("hit")
    )
    gone, rest = F.col("earlier") > 0, F.col("earlier") == 0

    def total(which: Column, what: str = "n") -> Column:
        return F.sum(F.when(which, F.col(what)).otherwise(0))

    share = F.expr("n * (120 div bit_count(fails))")  # a combination of k filters is removed by each in 120 / k of the orders
    return seen.groupBy("part", "filter_order", "step").agg(
        total(rest & ~F.col("hit")).alias("kept"),
        total(rest & F.col("hit")).alias("removed"),
        total(gone & F.col("hit")).alias("redundant"),
        total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(rest & F.col("hit"), "good").alias("good_lost"),
        total(rest & F.col("hit"), "toxic").alias("toxic_lost"),
        F.sum(F.when(F.col("hit"), share).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return evaluated(combinations(docs, labels, **columns))
