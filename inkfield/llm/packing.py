"""Best-fit packing with a grouping genetic algorithm on islands.

Documents become pieces of at most one sequence's length. Whole pieces are
sequences of their own; the others are dealt into blocks by a hash, so that no
source or length decides where a piece goes. Every block is evolved on several
islands: an individual is a list of bins, crossover injects well-filled bins of
one parent into the other, removes the bins that would repeat a piece, and puts
what was displaced where it fits best. Between epochs each island's elite moves
to the next island of its block. The bins that a block leaves with much room are
dissolved, and their pieces are dealt into fewer blocks and evolved again.

A null text is empty and still has its end id. Pieces of repeated rows are
packed once for each row. An empty table packs into nothing.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkfield.llm.common import Bench, blocks, given_id, ids_and_texts, partitions
from inkfield.llm.token_files import BLOCK, with_end
from inkfield.llm.tokens import encoder

#: Pieces of a block, islands of a block, individuals of an island, epochs, matings of an epoch, rounds of dissolving.
BLOCK_PIECES, ISLANDS, CROWD, EPOCHS, MATINGS, ROUNDS = 1500, 2, 4, 2, 6, 4
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, rows array<long>, lengths array<int>, crowd array<array<int>>"


def cut_documents(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document's ids; only the first one of a longer document may be shorter than a sequence."""
    for block in blocks(batches, BLOCK):
        ids, counts = encoder(tokenizer).encode(block.column("text"))
        ids, counts = with_end(ids, counts, end_id), counts + 1
        pieces = -(-counts // most)
        doc = np.repeat(np.arange(len(counts)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = counts - (pieces - 1) * most
        length = np.where(number == 0, first[doc], most)
        start = np.where(number == 0, 0, first[doc] + (number - 1) * most)
        at = (np.cumsum(counts) - counts)[doc] + start
        crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


class Bins:
    """One individual: bins of piece numbers, and how full each is."""

    def __init__(self, lengths: list[int], most: int, groups: list[list[int]] | None = None):
        self.lengths, self.most = lengths, most
        self.groups = groups or []
        self.fill = [sum(lengths[i] for i in g) for g in self.groups]

    def fit(self, pieces: list[int]) -> None:
        """Put pieces, longest first, each into the fullest bin that has room."""
        room = sorted((self.most - f, k) for k, f in enumerate(self.fill))
        for i in pieces:
            n = self.lengths[i]
            at = bisect_left(room, (n, -1))
            if at < len(room):
                left, k = room.pop(at)
                self.groups[k].append(i)
                self.fill[k] += n
                insort(room, (left - n, k))
            else:
                self.groups.append([i])
                self.fill.append(n)
                insort(room, (self.most - n, len(self.groups) - 1))

    def worth(self) -> tuple[int, float]:
        """Fewer bins first; of equal many, the ones that leave the room in fewer bins."""
        return -len(self.groups), sum(f * f for f in self.fill)

    def genes(self) -> list[int]:
        where = [0] * len(self.lengths)
        for k, group in enumerate(self.groups):
            for i in group:
                where[i] = k
        return where


def from_genes(lengths: list[int], most: int, genes: list[int]) -> Bins:
    groups: list[list[int]] = [[] for _ in range(max(genes, default=-1) + 1)]
    for i, k in enumerate(genes):
        groups[k].append(i)
    return Bins(lengths, most, [g for g in groups if g])


def mate(giver: Bins, taker: Bins, rng: np.random.Generator) -> Bins:
    """Inject well-filled bins of one parent into the other and repair what they displace."""
    full = [k for k, f in enumerate(giver.fill) if f >= 0.99 * giver.most] or [int(np.argmax(giver.fill))]
    chosen = rng.choice(full, max(1, int(len(full) * rng.uniform(0.1, 0.4))), replace=False).tolist()
    injected = [list(giver.groups[k]) for k in chosen]
    taken = {i for g in injected for i in g}
    kept, displaced = [], []
    spare = set(np.argsort(taker.fill)[: max(1, len(taker.fill) // 50)].tolist())  # its emptiest bins are mixed anew as well
    for k, group in enumerate(taker.groups):
        if k in spare or not taken.isdisjoint(group):
            displaced += [i for i in group if i not in taken]
        else:
            kept.append(list(group))
    child = Bins(taker.lengths, taker.most, injected + kept)
    child.fit(sorted(displaced, key=lambda i: -taker.lengths[i]))
    return child


def seeded(lengths: list[int], most: int, rng: np.random.Generator, crowd: int, first: bool) -> list[list[int]]:
    """Best-fit from the longest piece on, then the same on orders that are disturbed a little."""
    sizes = np.array(lengths, float)
    made = []
    for n in range(crowd):
        noise = 1.0 if first and n == 0 else rng.uniform(0.9, 1.1, len(sizes))
        one = Bins(lengths, most)
        one.fit(np.argsort(-sizes * noise, kind="stable").tolist())
        made.append(one.genes())
    return made


def evolve(lengths: list[int], most: int, crowd: list[list[int]], matings: int, rng: np.random.Generator) -> list[list[int]]:
    """Best first. The least fit individual gives way to a child that is fitter."""
    people = sorted((from_genes(lengths, most, g) for g in crowd), key=Bins.worth, reverse=True)
    for _ in range(matings):
        if -people[0].worth()[0] <= -(-sum(lengths) // most):
            break  # no packing has fewer bins
        a, b = rng.choice(len(people), 2, replace=len(people) < 2)
        child = mate(people[min(a, b)], people[max(a, b)], rng)
        if child.worth() > people[-1].worth():
            people[-1] = child
            people.sort(key=Bins.worth, reverse=True)
    return [p.genes() for p in people]


def islands(batches: Iterator[pa.RecordBatch], most: int, epoch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rng = np.random.default_rng([epoch, row["island"], row["block"] & 0xFFFFFFFF])
            crowd = row["crowd"] or seeded(row["lengths"], most, rng, CROWD, row["island"] == 0)
            crowd = evolve(row["lengths"], most, (crowd + [row["guest"]] if row["guest"] else crowd), MATINGS, rng)[:CROWD]
            del row["guest"]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            made = [*row.values()][:4] + [crowd]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, kinds)], ["block", "island", "rows", "lengths", "crowd"])


def settle(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """Per piece of the best individual of a block: its bin, its place, and whether the bin is full enough to stay."""
    for batch in batches:
        for row in batch.to_pylist():
            best = max((from_genes(row["lengths"], most, g) for g in row["elites"]), key=Bins.worth)
            out: list[tuple] = []
            for group, fill in zip(best.groups, best.fill):
                name, at = min(row["rows"][i] for i in group), 0
                for i in group:
                    out.append((row["rows"][i], row["lengths"][i], name, at, fill >= least))
                    at += row["lengths"][i]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], ["row", "length", "sequence_id", "offset", "stays"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark, bench, tasks = docs.sparkSession, Bench(docs.sparkSession, "packing"), partitions(docs)
    cut = ids_and_texts(docs, doc_id, text).mapInArrow(lambda b: cut_documents(b, tokenizer, end_id, most), PIECE)
    pieces = bench.keep(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    left = pieces.where(F.col("length") < most).select("row", F.col("length").cast("int").alias("length"))
    placed = []
    for number in range(ROUNDS):
        count = left.count()
        if not count:
            break
        n_blocks = math.ceil(count / BLOCK_PIECES)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(n_blocks)).cast("long"))
        state = (
            dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("p"))  # about BLOCK_PIECES
            .select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "p")
            .select("block", "island", F.col("p.row").alias("rows"), F.col("p.length").alias("lengths"), F.lit(None).cast("array<array<int>>").alias("crowd"))
        )
        for epoch in range(EPOCHS):
            if epoch:
                elites = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("crowd")[0].alias("guest"))
                state = state.join(elites, ["block", "island"])
            else:
                state = state.withColumn("guest", F.lit(None).cast("array<int>"))
            state = bench.keep(
                state.repartition(max(tasks, 1), "block", "island").mapInArrow(lambda b, e=epoch: islands(b, most, e), STATE), f"state-{number}-{epoch}"
            )
        last = n_blocks == 1 or number == ROUNDS - 1
        best = state.groupBy("block").agg(F.first("rows").alias("rows"), F.first("lengths").alias("lengths"), F.collect_list(F.col("crowd")[0]).alias("elites"))
        least = 0 if last else most - most // 64
        found = bench.keep(
            best.repartition(max(tasks, 1), "block").mapInArrow(lambda b, m=least: settle(b, most, m), "row long, length int, sequence_id long, offset long, stays boolean"),
            f"placed-{number}",
        )
        bench.drop(*(f"state-{number}-{e}" for e in range(EPOCHS)))
        placed.append(found.where("stays").select("row", "sequence_id", "offset"))
        left = found.where("NOT stays").select("row", "length")
        if last:
            break
    whole = pieces.where(F.col("length") == most).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for found in placed:
        whole = whole.unionByName(found)
    return pieces.join(whole, "row").select(given_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
