"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector. Learned filters run over windows of WIDTH bytes
at every byte of a text, their largest answers are kept for overlapping chunks
that cover the whole text, and the chunks' mean and largest answers are combined
into one probability of label 1. The network is fitted on the driver, on at most
``sample`` labelled documents of each class and none longer than ``longest``
bytes; every document is scored whole, inside tasks.

Null and empty texts have the score of one chunk of padding; a text shorter than
a window is padded. Repeated rows are scored alike. Of several labels of one
document the smallest counts; null labels are left out. Where one class has no
label, or no labelled document that can be learnt from, the score is the share of
label 1, and a half without any label. An empty table gives an empty one. A text of
any length is walked in slices, of which only the largest answers are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkfield.llm.common import blocks, given_id, ids_and_texts, text_bytes

#: Bytes of a window, numbers of a byte's vector, filters, and bytes of half a chunk.
WIDTH, DEPTH, FILTERS, HALF = 8, 6, 16, 128
#: Most labelled documents of a class to learn from, their most bytes, passes over them, documents of a step, rate.
SAMPLE, LONGEST, PASSES, STEP, RATE = 1000, 1 << 17, 10, 16, 0.01
#: Text bytes that are laid out at a time, and halves of chunks whose answers are held at a time.
BLOCK, WALK = 1 << 18, 256
PAD = 256
HOLD_OUT, KEEP_FROM = 2, 0.7


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HOLD_OUT, F.lit(False))


class Layout:
    """Texts side by side, each padded to whole halves of a chunk, so that no window mixes two texts."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        sizes = np.maximum(np.diff(offsets), 1)
        self.halves = -(-sizes // HALF)
        begins = np.concatenate([[0], np.cumsum(self.halves)]) * HALF
        self.codes = np.full(begins[-1] + WIDTH - 1, PAD, np.uint16)
        lengths = np.diff(offsets)
        for to, at, size in zip(begins[:-1].tolist(), offsets[:-1].tolist(), lengths.tolist()):
            self.codes[to : to + size] = data[at : at + size]
        self.first = np.cumsum(self.halves) - self.halves
        self.n = int(begins[-1])
        # Windows that run over a text's last half would see the next text; the bytes they begin with are in the window before.
        self.crossing = (begins[1:, None] - np.arange(1, WIDTH)[None, :]).ravel()
        last = np.cumsum(self.halves) - 1
        self.is_chunk = np.ones(int(self.halves.sum()), bool)
        self.is_chunk[last[self.halves > 1]] = False
        self.joins = np.ones(len(self.is_chunk), bool)  # chunks of two halves
        self.joins[last] = False
        self.chunks = np.maximum(self.halves - 1, 1)
        self.chunk_first = np.cumsum(self.chunks) - self.chunks


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"vectors": (257, DEPTH), "filters": (WIDTH * DEPTH, FILTERS), "mean": (FILTERS,), "largest": (FILTERS,)}
        scale = {"vectors": 0.5, "filters": 1 / np.sqrt(WIDTH * DEPTH), "mean": 0.3, "largest": 0.3}
        self.p = {k: rng.normal(0, scale[k], s).astype(np.float32) for k, s in shapes.items()}
        self.p |= {"bias": np.zeros(FILTERS, np.float32), "base": np.zeros(1, np.float32)}
        self.prior = 0.0

    def answers(self, x: Layout, begin: int, end: int) -> np.ndarray:
        """Every filter's answer at every byte of halves begin to end."""
        first, n = begin * HALF, (end - begin) * HALF
        seen = np.take(self.p["vectors"], x.codes[first : first + n + WIDTH - 1], axis=0)
        windows = np.lib.stride_tricks.as_strided(seen, (n, WIDTH * DEPTH), (seen.strides[0], seen.strides[1]))
        out = np.ascontiguousarray(windows) @ self.p["filters"]
        over = x.crossing[(x.crossing >= first) & (x.crossing < first + n)]
        out[over - first] = -1e9
        return out.reshape(-1, HALF, FILTERS)

    def halves(self, x: Layout, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Every filter's largest answer in every half and, if asked for, the byte of the half that has it."""
        total = x.n // HALF
        best = np.empty((total, FILTERS), np.float32)
        where = np.empty((total, FILTERS), np.int64) if places else None
        for at in range(0, total, WALK):
            answers = self.answers(x, at, min(at + WALK, total))
            best[at : at + WALK] = answers.max(axis=1)
            if places:
                where[at : at + WALK] = answers.argmax(axis=1)
        return best, where

    def pooled(self, halves: np.ndarray, x: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks from the largest answers of their halves, and each text's mean and largest chunk."""
        both = halves.copy()
        at = np.flatnonzero(x.joins)
        both[at] = np.maximum(halves[at], halves[at + 1])
        chunks = np.maximum(both[x.is_chunk] + self.p["bias"], 0)
        return chunks, np.add.reduceat(chunks, x.chunk_first) / x.chunks[:, None], np.maximum.reduceat(chunks, x.chunk_first)

    def logits(self, column: pa.Array) -> np.ndarray:
        x = Layout(column)
        _, mean, largest = self.pooled(self.halves(x)[0], x)
        return mean @ self.p["mean"] + largest @ self.p["largest"] + self.p["base"][0]

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.clip(self.logits(column).astype(np.float64) + self.prior, -30, 30)
        return 1 / (1 + np.exp(-z))

    def gradients(self, column: pa.Array, label: np.ndarray) -> dict[str, np.ndarray]:
        x = Layout(column)
        halves, where = self.halves(x, places=True)
        chunks, mean, largest = self.pooled(halves, x)
        z = mean @ self.p["mean"] + largest @ self.p["largest"] + self.p["base"][0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - label).astype(np.float32) / len(label)
        g = {"mean": dz @ mean, "largest": dz @ largest, "base": dz.sum(keepdims=True)}
        of = np.repeat(np.arange(len(label)), x.chunks)
        d = (dz / x.chunks)[of, None] * self.p["mean"]
        top = chunks == largest[of]
        d = d + np.where(top, dz[of, None] * self.p["largest"] / np.maximum(np.add.reduceat(top, x.chunk_first)[of], 1), 0)
        d = np.where(chunks > 0, d, 0).astype(np.float32)
        g["bias"] = d.sum(axis=0)
        place = np.flatnonzero(x.is_chunk)
        second = np.zeros(d.shape, bool)
        joined = x.joins[place]
        second[joined] = halves[place[joined] + 1] > halves[place[joined]]
        to_half = np.zeros_like(halves)
        to_half[place] += np.where(second, 0, d)
        to_half[place[joined] + 1] += np.where(second, d, 0)[joined]
        at = where + (np.arange(len(halves)) * HALF)[:, None]
        live = np.nonzero(to_half)
        codes = x.codes[at[live][:, None] + np.arange(WIDTH)]  # one window for each answer that counts
        weight = to_half[live]
        by_filter = np.zeros((FILTERS, WIDTH * DEPTH), np.float32)
        windows = self.p["vectors"][codes].reshape(len(weight), -1)
        for f in range(FILTERS):
            own = live[1] == f
            by_filter[f] = weight[own] @ windows[own]
        g["filters"] = by_filter.T
        back = (weight[:, None] * self.p["filters"].T[live[1]]).reshape(-1, DEPTH)
        g["vectors"] = np.stack([np.bincount(codes.ravel(), back[:, k], 257) for k in range(DEPTH)], 1).astype(np.float32)
        return g

    def fit(self, texts: list[str], labels: np.ndarray, passes: int = PASSES) -> Network:
        rng = np.random.default_rng(1)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn, steps = 0, passes * -(-len(texts) // STEP)
        for _ in range(passes):
            order = rng.permutation(len(texts))
            for at in range(0, len(texts), STEP):
                own = order[at : at + STEP]
                g = self.gradients(pa.array([texts[i] for i in own], pa.large_string()), labels[own])
                turn += 1
                rate = RATE * (1 - (turn - 1) / steps)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-7)).astype(np.float32)
        return self


class Constant:
    """What scores when there is nothing to tell two classes apart by."""

    def __init__(self, share: float):
        self.share = share

    def score(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.share)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Network | Constant:
    """A network from labels of documents that aren't held out.

    ``sample`` ids of each class, by the order of a hash, are joined to the
    texts; so many rows go to every task and so many texts to the driver.
    """
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Constant(next((float(k) for k in counts), 0.5))
    chosen = None
    for k in (0, 1):
        own = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = (
        ids_and_texts(docs, doc_id, text).join(F.broadcast(chosen), "doc_id")
        .where(F.octet_length("text") <= longest)
        .groupBy("doc_id", "label").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    )
    y = rows.column("label").to_numpy().astype(np.float32)
    if len(np.unique(y)) < 2:
        return Constant(counts[1] / (counts[0] + counts[1]))
    network = Network().fit(rows.column("text").to_pylist(), y)
    network.prior = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return network


def scores(batches: Iterator[pa.RecordBatch], model: Network | Constant) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK):
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.score(block.column("text")))], ["doc_id", "score"])


def classify(docs: DataFrame, model: Network | Constant, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = ids_and_texts(docs, doc_id, text).mapInArrow(lambda b: scores(b, model), "doc_id long, score double")
    return scored.select(
        given_id(), is_held_out(given_id()).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted")
    )


def marked(batches: Iterator[pa.RecordBatch], model: Network | Constant, text: str) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK, text):
        yield block.filter(pa.array(model.score(block.column(text)) >= KEEP_FROM))


def keep_good(docs: DataFrame, model: Network | Constant, text: str = "text") -> DataFrame:
    """The documents the network accepts, whole rows, with no shuffle."""
    return docs.mapInArrow(lambda b: marked(b, model, text), docs.schema)
