"""Substring dedup by collinear chaining.

Seeds are all k-mers of words. A seed's owner is its first document (smallest
id); every other occurrence is matched with the owner alone, so a passage that
thousands of documents share makes as many matches as it has occurrences.
Where the seeds of min_words words in a row are all shared but their owners
differ, those words as a whole are matched with their own first document, so
every equal stretch of min_words words is found whoever owns its seeds. The
matches of a document are chained for each owner: ordered in both texts, with a
cost for gaps, by a Fenwick tree of prefix maxima. A chain is extended and its
gaps are aligned word by word; what is long and similar enough in both texts is
a fuzzy passage. Of a document's chains those inside a heavier one's stretch come
second, and only where the first ones left no passage that holds them. A chain that is not similar enough as a whole is cut into the
longest stretches that are.

Words are split at blanks and compared with A-Z lower-cased. A null text has no
words. Rows of one id and one text are one document; rows of one id with other
texts are documents of their own. A null id is the smallest. Of documents that
hold a passage the first one keeps it. Of passages of the same two documents
one that lies inside another in the document's text is not given. Ties between owners cannot occur, and of
equal chains the earlier one is taken. An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkfield.llm.common import NO_ID, Bench, Words, blocks, given_id, ids_and_texts, mix, partitions, whole_groups

#: Words of a seed. n words of which a share of 0.8 is equal, the others replaced, have 4 equal ones in a row.
K = 4
#: Of steady matches each STEP-th is kept.
STEP = 8
#: Words of a passage and its share of equal words at least.
MIN_WORDS, IDENTITY = 50, 0.8
#: Words of a gap that a chain may bridge, and what each word from match to match costs in either text.
MAX_GAP, GAP_COST = 60, 0.05
BLOCK = 1 << 20
#: Text bytes that a bucket of seeds is to stand for, and the least and most bits of a bucket's number.
BUCKET_BYTES, BUCKET_BITS = 1 << 19, (6, 18)
#: A bucket of windows stands for as many buckets of seeds; matches of texts that are taken on at once.
WINDOW_BUCKETS, TAKEN = 8, 1 << 17
#: Bytes of a seed beside its bucket, and of one that goes with its text; occurrences that are sent on together.
SEED_BYTES, SHORT_SEED, SENT = 5, 4, 1 << 19
PACKED = "bucket int, ids binary, ths binary, held binary, pos binary, seeds binary"
SHARED = "part int, ids binary, ths binary, held binary, pos binary, seeds binary, owners binary, owner_ths binary, owner_pos binary"
MATCHES = "part int, ids binary, ths binary, held binary, pos binary, owners binary, owner_ths binary, owner_pos binary"
RUN = MATCHES + ", windows binary"
TEXT_MATCHES = ["doc_id", "th", "owners", "owner_ths", "pos", "owner_pos"]
MATCH_KEYS = ["doc_id", "th", "owner_id", "owner_th"]


def planes(values: np.ndarray, size: int | None = None) -> bytes:
    """The low bytes of numbers by place in the number, so that high ones compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)[:, :size].T.tobytes()


def numbers(raw: bytes, dtype, size: int | None = None) -> np.ndarray:
    size, whole = size or np.dtype(dtype).itemsize, np.dtype(dtype).itemsize
    given = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((given.shape[1], whole), np.uint8)
    out[:, :size] = given.T
    return out.view(dtype).ravel()


def steps(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def sums(raw: bytes, dtype) -> np.ndarray:
    return np.cumsum(numbers(raw, dtype), dtype=dtype)


def pack(key: np.ndarray, ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, more: list[tuple[np.ndarray, int | None]]) -> list[tuple]:
    """A row for each key of sorted keys: the documents of its numbers, how many each has, and the numbers."""
    begins = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    rows = []
    for x, y in zip(begins.tolist(), begins[1:].tolist()):
        firsts = np.append(np.flatnonzero(np.append(True, doc[x + 1 : y] != doc[x : y - 1])), y - x)
        mine = doc[x + firsts[:-1]]
        rows.append((int(key[x]), steps(ids[mine]), planes(ths[mine]), planes(np.diff(firsts).astype(np.int32)), *(planes(v[x:y], size) for v, size in more)))
    return rows


def by_part(ids: np.ndarray, ths: np.ndarray, pos: np.ndarray, more: list[tuple[np.ndarray, int | None]], parts: int) -> list[tuple]:
    """A row for each part of the documents, texts and places ascending."""
    part = (mix(ids.view(np.uint64) * Words.BASE + ths.view(np.uint32)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((pos, ths, ids, part))
    ids, ths, part = ids[order], ths[order], part[order]
    doc = np.cumsum(firsts(ids, ths)) - 1
    first = np.flatnonzero(firsts(ids, ths))
    return pack(part, ids[first], ths[first], doc, [(pos[order], None), *((v[order], size) for v, size in more)])


def packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * (len(names) - 1))], names)


def unpacked(table: pa.Table, more: list[tuple[str, type, int | None]]) -> list[np.ndarray]:
    """ids, ths and further columns of numbers, one of each for every occurrence."""
    def all_of(name, read):
        return np.concatenate([read(raw.as_buffer()) for raw in table.column(name)])

    held = all_of("held", lambda raw: numbers(raw, np.int32))
    ids, ths = all_of("ids", lambda raw: sums(raw, np.int64)), all_of("ths", lambda raw: numbers(raw, np.int32))
    return [np.repeat(ids, held), np.repeat(ths, held), *(all_of(name, lambda raw, k=kind, n=size: numbers(raw, k, n)) for name, kind, size in more)]


def seeds(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Every seed of each text, in one row for each bucket of seeds and block of texts."""
    for block in blocks(batches, 2 * BLOCK):
        words = Words(block.column("text"))
        runs = words.runs(K)
        counts = np.maximum(np.diff(words.first) - (K - 1), 0)  # seeds of each text
        if not counts.sum():
            continue
        doc = np.repeat(np.arange(block.num_rows), counts)
        pos = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        hashes = runs[words.first[:-1][doc] + pos]
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, doc, pos = bucket[order], doc[order], pos[order]
        rest = (hashes[order] << np.uint64(bits)) >> np.uint64(64 - 8 * SEED_BYTES)
        ids, ths = block.column("doc_id").to_numpy(), block.column("th").to_numpy()
        yield packed(pack(bucket, ids, ths, doc, [(pos, None), (rest, SEED_BYTES)]), PACKED)


def held_by_several(table: pa.Table) -> list[np.ndarray]:
    """Of the seeds of one bucket that two documents hold, every occurrence and the seed's owner."""
    ids, ths, pos, seed = unpacked(table, [("pos", np.int32, None), ("seeds", np.uint64, SEED_BYTES)])
    order = np.argsort(seed)
    ranked = seed[order]
    equal = ranked[1:] == ranked[:-1]
    order = order[np.append(False, equal) | np.append(equal, False)]
    order = order[np.lexsort((pos[order], ths[order], ids[order], seed[order]))]
    ids, ths, pos, seed = ids[order], ths[order], pos[order], seed[order]
    at = np.flatnonzero(np.append(np.ones(min(len(seed), 1), bool), seed[1:] != seed[:-1]))
    size = np.diff(np.append(at, len(seed)))
    last = at + size - 1
    several = np.repeat((ids[at] != ids[last]) | (ths[at] != ths[last]), size)
    owner = np.repeat(at, size)[several]
    short = mix(seed[several]) & np.uint64((1 << 8 * SHORT_SEED) - 1)
    return [ids[several], ths[several], pos[several], short, ids[owner], ths[owner], pos[owner]]


def shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of seeds that two documents hold, with the seed's owner, in rows for each part of the documents."""
    held: list[list[np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        ids, ths, pos, seed, owner, owner_th, owner_pos = map(np.concatenate, zip(*held))
        more = [(seed, SHORT_SEED), (owner, None), (owner_th, None), (owner_pos, None)]
        return packed(by_part(ids, ths, pos, more, parts), SHARED)

    for table in whole_groups(batches, ["bucket"]):
        buckets = table.column("bucket").to_numpy()
        begins = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets))
        for a, b in zip(begins, begins[1:]):
            found = held_by_several(table.slice(a, b - a))
            if len(found[0]):
                held.append(found)
            if sum(len(f[0]) for f in held) >= SENT:
                yield sent()
                held.clear()
    if held:
        yield sent()


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows begin a group of equal sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def steady(same: np.ndarray) -> np.ndarray:
    """How many rows in a row, up to each, go on from the one before."""
    n = np.arange(len(same))
    return n - np.maximum.accumulate(np.where(same, 0, n))


def runs_of_texts(batches: Iterator[pa.RecordBatch], min_words: int, parts: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The matches of each text's shared seeds with their owners, and, with a hash, the windows of min_words words that no one owner's matches cover.

    All seeds of such a window are shared. Which owner a seed has depends on
    the seed alone, so equal windows are given in all texts or in none. Matches
    inside a run of steady ones are left out but for each STEP-th. Matches are
    in rows for each part of the documents, windows in rows for each bucket of hashes.
    """
    numbered = [("pos", np.int32, None), ("seeds", np.int64, SHORT_SEED), ("owners", np.int64, None), ("owner_ths", np.int32, None), ("owner_pos", np.int32, None)]
    for table in whole_groups(batches, ["part"]):
        ids, ths, pos, *more = unpacked(table, numbered)
        order = np.lexsort((pos, ths, ids))
        ids, ths, pos, seed, owner, owner_th, owner_pos = (v[order] for v in (ids, ths, pos, *more))
        once = np.append(True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1]) | (pos[1:] != pos[:-1]))  # repeated rows of a document
        ids, ths, pos, seed, owner, owner_th, owner_pos = (v[once] for v in (ids, ths, pos, seed, owner, owner_th, owner_pos))
        near = np.append(False, (ids[1:] == ids[:-1]) & (ths[1:] == ths[:-1]) & (pos[1:] == pos[:-1] + 1))
        alike = near & np.append(False, (owner[1:] == owner[:-1]) & (owner_th[1:] == owner_th[:-1]) & (owner_pos[1:] == owner_pos[:-1] + 1))
        inner = alike & np.append(alike[1:], False) & (pos % STEP != 0)
        keep = ~inner & ((ids != owner) | (ths != owner_th))
        rows = []
        if keep.any():
            more = [(v[keep], None) for v in (owner, owner_th, owner_pos)]
            rows = [(*row, None) for row in by_part(ids[keep], ths[keep], pos[keep], more, parts)]
        span = max(min_words - K, 0)  # from a window's first seed to its last
        end = np.flatnonzero((steady(near) >= span) & (steady(alike) < span))
        if len(end):
            whole = np.zeros(len(end), np.uint64)
            for step in range(span + 1):
                whole = whole * Words.BASE + seed[end - span + step].view(np.uint64)
            whole, begin = mix(whole), end - span
            bucket = (whole >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")  # texts and places stay in order
            begin, new = begin[order], firsts(ids, ths)
            doc = np.cumsum(new) - 1
            held = pack(bucket[order], ids[new], ths[new], doc[begin], [(pos[begin], None), (whole[order], None)])
            rows += [(*row[:5], None, None, None, row[5]) for row in held]
        if rows:
            yield packed(rows, RUN)


def first_holders(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of the windows that two texts hold, every later text's matches with the first one's, in rows for each part of the documents."""
    for table in whole_groups(batches, ["part"]):
        ids, ths, pos, window = unpacked(table, [("pos", np.int32, None), ("windows", np.uint64, None)])
        order = np.lexsort((pos, ths, ids, window))
        ids, ths, pos, window = (v[order] for v in (ids, ths, pos, window))
        new = firsts(window)
        owner = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (ids != ids[owner]) | (ths != ths[owner])
        if later.any():
            owner = owner[later]
            yield packed(by_part(ids[later], ths[later], pos[later], [(v[owner], None) for v in (ids, ths, pos)], parts), MATCHES)


def texts_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of each text in one row. A window's match, n words on to its last seed, is one of each STEP-th of its seeds and of its last."""
    kinds = [("pos", np.int32), ("owners", np.int64), ("owner_ths", np.int32), ("owner_pos", np.int32)]
    for table in whole_groups(batches, ["part"]):
        ids, ths, *more = unpacked(table, [(name, kind, None) for name, kind in kinds])
        each = [len(raw.as_buffer()) // 4 for raw in table.column("pos")]
        n = np.repeat(table.column("n").to_numpy(), each)
        order = np.lexsort((ths, ids))
        ids, ths, x, owner, owner_th, y, n = (v[order] for v in (ids, ths, *more, n))
        begins = np.append(np.flatnonzero(firsts(ids, ths)), len(ids))
        cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(ids), TAKEN)), len(begins) - 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            some = slice(begins[a], begins[b])
            times = np.where(n[some] > 0, -(-n[some] // STEP) + 1, 1)
            row = np.repeat(np.arange(begins[a], begins[b]), times)
            on = np.minimum((np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)) * STEP, n[row])
            of = [owner[row], owner_th[row], (x[row] + on).astype(np.int32), (y[row] + on).astype(np.int32)]
            to = np.append(0, np.cumsum(times))[begins[a : b + 1] - begins[a]].tolist()
            rows = [(int(ids[t]), int(ths[t]), *(planes(v[p:q]) for v in of)) for t, p, q in zip(begins[a:b], to, to[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [pa.int64(), pa.int32()] + [pa.binary()] * 4)], TEXT_MATCHES)


class Fenwick:
    """Prefix maxima of scores by place, each with the match that has it."""

    def __init__(self, size: int):
        self.score, self.by = [float("-inf")] * (size + 1), [-1] * (size + 1)

    def put(self, place: int, score: float, by: int) -> None:
        place += 1
        while place < len(self.score):
            if score > self.score[place]:
                self.score[place], self.by[place] = score, by
            place += place & -place

    def best(self, place: int) -> tuple[float, int]:
        """Over all places before ``place``."""
        score, by = float("-inf"), -1
        while place > 0:
            if self.score[place] > score:
                score, by = self.score[place], self.by[place]
            place -= place & -place
        return score, by


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Chains of matches (x, y), as ``chained`` has them, from matches in any order."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    return [np.stack([x[c], y[c]], 1) for c in chained(x, y)]


def chained(x: np.ndarray, y: np.ndarray) -> list[np.ndarray | list[int]]:
    """Chains of sorted matches (x, y), ascending in both, best first, as places in x; no match is in two.

    Matches are first parted where neighbours in x are more than MAX_GAP words
    apart. The score of a chain is K for each match less GAP_COST for each word
    from match to match in either text. A match's best earlier one has the
    largest score plus GAP_COST (x + y), a prefix maximum over the ranks of y;
    where that one is too far off, those within MAX_GAP words of x are tried, of
    which a seed's one owner leaves about one for each word.
    """
    found = []
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x) > MAX_GAP) + 1):
        if len(part) < 2:
            continue
        dx, dy = np.diff(x[part]), np.diff(y[part])
        if ((dx > 0) & (dy > 0) & (dy <= MAX_GAP) & (GAP_COST * (dx + dy) < K)).all():  # each match adds to the one before: all are the chain
            found.append(part)
            continue
        start = int(part[0])
        places, rank = np.unique(y[part], return_inverse=True)
        rank, xs, ys = rank.tolist(), x[part].tolist(), y[part].tolist()
        tree = Fenwick(len(places))
        score, back = [float(K)] * len(xs), [-1] * len(xs)
        xa, ya, so_far, low = x[part], y[part], np.full(len(xs), float(K)), 0

        def joined(j: int, i: int) -> float:
            dx, dy = xs[j] - xs[i], ys[j] - ys[i]
            if i < 0 or not (0 < dx <= MAX_GAP and 0 < dy <= MAX_GAP):
                return 0.0
            return score[i] + K - GAP_COST * (dx + dy)

        i = 0
        while i < len(xs):
            j = i
            while xs[i] - xs[low] > MAX_GAP:
                low += 1
            while j < len(xs) and xs[j] == xs[i]:  # matches of one x don't follow each other
                by = tree.best(rank[j])[1]
                gain = joined(j, by)
                if gain == 0.0 and by >= 0:  # out of reach
                    dy = ys[j] - ya[low:i]
                    worth = np.where((dy > 0) & (dy <= MAX_GAP), so_far[low:i] + K - GAP_COST * (xs[j] - xa[low:i] + dy), 0.0)[::-1]
                    if len(worth) and worth[best := worth.argmax()] > gain:
                        by, gain = i - 1 - int(best), float(worth[best])
                if gain > K:
                    score[j] = so_far[j] = gain
                    back[j] = by
                j += 1
            for m in range(i, j):
                tree.put(rank[m], score[m] + GAP_COST * (xs[m] + ys[m]), m)
            i = j
        used = [False] * len(xs)
        for end in sorted(range(len(xs)), key=lambda m: (-score[m], m)):
            at, chain = end, []
            while at >= 0 and not used[at]:
                used[at] = True
                chain.append(at)
                at = back[at]
            if len(chain) > 1:
                found.append([m + start for m in reversed(chain)])
    return found


def fewest(min_words: int, identity: float) -> int:
    """Seeds of a passage at least, if its other words are replaced: each such word ends one run of equal words, and a run of n has n - K + 1."""
    other = int(min_words * (1 - identity) + 1e-9)
    return max(2, min_words - other - (K - 1) * (other + 1))


def weight(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matches that each step to the next one stands for."""
    dx, dy = np.diff(x), np.diff(y)
    return np.where((dx == dy) & (dx > 0) & (dx <= STEP), dx, 1)


def within_heavier(low: np.ndarray, high: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Which of a document's chains lie wholly inside the stretch of a heavier one that doesn't itself; of equal ones the earlier counts as heavier."""
    inside, kept = np.zeros(len(low), bool), Stretches()
    lows, highs = low.tolist(), high.tolist()
    for n in np.argsort(-worth, kind="stable").tolist():
        inside[n] = kept.hold(lows[n], highs[n])
        if not inside[n]:
            kept.put(lows[n], highs[n], ())
    return inside


CHAINS = "doc_id long, th int, owner_id long, owner_th int, xs array<array<int>>, ys array<array<int>>, second boolean"


def nested(values: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> pa.Array:
    """Lists of lists of numbers, by where each begins and the last ends."""
    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(values, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), lists)


def matches_of(table: pa.Table) -> list[np.ndarray]:
    """doc_id, th, owner_id, owner_th, pos and owner_pos of every match, sorted, none twice."""
    held, out = [], []
    for name, kind in (("owners", np.int64), ("owner_ths", np.int32), ("pos", np.int32), ("owner_pos", np.int32)):
        given = [numbers(raw.as_buffer(), kind) for raw in table.column(name)]
        held = [len(v) for v in given]
        out.append(np.concatenate([np.zeros(0, kind), *given]))
    owner, owner_th, x, y = out
    keys = [*(np.repeat(table.column(k).to_numpy(), held) for k in MATCH_KEYS[:2]), owner, owner_th]
    x, y = x.astype(np.int64), y.astype(np.int64)
    order = np.lexsort((y, x, *keys[::-1]))
    every = [v[order] for v in (*keys, x, y)]
    once = firsts(*every)  # a window's matches repeat those of its seeds
    return [v[once] for v in every]


def chain_matches(batches: Iterator[pa.RecordBatch], min_words: int, identity: float) -> Iterator[pa.RecordBatch]:
    """Per document and owner the chains that may become passages; ``second`` are those inside a heavier chain of the document."""
    least = fewest(min_words, identity)
    for table in whole_groups(batches, MATCH_KEYS[:2]):
        *keys, x, y = matches_of(table)
        dx, dy = np.diff(x), np.diff(y)
        new = firsts(*keys)
        new[1:] |= dx > MAX_GAP
        begins = np.append(np.flatnonzero(new), len(x))
        size = np.diff(begins)
        # Where each match adds to the one before, all are the chain.
        odd = np.append(0, np.cumsum((dx <= 0) | (dy <= 0) | (dy > MAX_GAP) | (GAP_COST * (dx + dy) >= K)))
        so_far = np.append(0, np.cumsum(weight(x, y)))
        whole = odd[begins[1:] - 1] == odd[begins[:-1]]
        # A step stands for STEP matches at most, and for no more than its words.
        most = np.where(whole, so_far[begins[1:] - 1] - so_far[begins[:-1]], np.minimum(x[begins[1:] - 1] - x[begins[:-1]], STEP * (size - 1))) + 1
        found = []
        for g in np.flatnonzero((size >= 2) & (most >= least)).tolist():
            a, b = int(begins[g]), int(begins[g + 1])
            found += [np.arange(a, b)] if whole[g] else [np.asarray(c) + a for c in chained(x[a:b], y[a:b])]
        if not found:
            continue
        place, ends = np.concatenate(found), np.cumsum([len(c) for c in found])
        begins = np.append(0, ends[:-1])
        so_far = np.append(0, np.cumsum(weight(x[place], y[place])))
        total = so_far[ends - 1] - so_far[begins] + 1
        fit = np.flatnonzero(total >= least)
        if not len(fit):
            continue
        head, tail = place[begins[fit]], place[ends[fit] - 1]
        of, worth, low, high = [k[head] for k in keys], total[fit], x[head], x[tail] + K
        each = np.append(np.flatnonzero(firsts(*of[:2])), len(fit))
        second = np.concatenate([within_heavier(low[s:e], high[s:e], worth[s:e]) for s, e in zip(each.tolist(), each[1:].tolist())])
        order = np.lexsort((np.arange(len(fit)), second, *of[::-1]))
        of, second = [k[order] for k in of], second[order]
        place = np.concatenate([found[n] for n in fit[order].tolist()])
        outer, inner = np.append(np.flatnonzero(firsts(*of, second)), len(fit)), np.append(0, np.cumsum((ends - begins)[fit[order]]))
        columns = [*(pa.array(k[outer[:-1]]) for k in of), nested(x[place], inner, outer), nested(y[place], inner, outer), pa.array(second[outer[:-1]])]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CHAINS.split(", ")])


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words of two short stretches under the best alignment."""
    if len(a) == len(b):
        same = int((a == b).sum())
        if same >= 0.5 * len(a):
            return same
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        grown = np.maximum(row[1:], row[:-1] + (b == word))
        row[1:] = np.maximum.accumulate(grown)
    return int(row[-1])


#: By how much an extension's score may fall.
DROP = 8


def extend(a: np.ndarray, b: np.ndarray, drop: int = DROP) -> tuple[int, int]:
    """How far two stretches go on together: words to the best score before it falls by ``drop``, and equal ones of them."""
    whole = min(len(a), len(b))
    if not whole:
        return 0, 0
    n = 64
    while True:  # most end soon: more words are looked at only where the score holds
        same = a[: min(n, whole)] == b[: min(n, whole)]
        score = np.cumsum(np.where(same, 1, -2))
        low = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= drop)
        if len(low) or n >= whole:
            break
        n *= 4
    if len(low):
        score = score[: low[0]]
    if not len(score) or score.max() <= 0:
        return 0, 0
    to = int(score.argmax()) + 1
    return to, int(same[:to].sum())


def passage(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int, int, int]:
    """Begin and end in both texts and the equal words of a chain's alignment."""
    xs, ys = np.asarray(xs), np.asarray(ys)
    dx, dy = np.diff(xs), np.diff(ys)
    straight, same = dx == dy, K
    turns = np.flatnonzero(np.append(True, straight[1:] != straight[:-1])) if len(dx) else dx
    for s, e in zip(turns.tolist(), [*turns[1:].tolist(), len(dx)]):
        odd = range(s, e)
        if straight[s]:  # words beside each other: those of each step at once
            equal = np.append(0, np.cumsum(a[xs[s] + K : xs[e] + K] == b[ys[s] + K : ys[e] + K]))
            each = np.diff(equal[xs[s : e + 1] - xs[s]])
            close = (dx[s:e] <= K) | (each - K >= 0.5 * (dx[s:e] - K))
            same += int(each[close].sum())
            odd = (s + np.flatnonzero(~close)).tolist()
        for n in odd:
            x0, y0, x1, y1 = xs[n], ys[n], xs[n + 1], ys[n + 1]
            if x1 - x0 < K or y1 - y0 < K:
                same += int(min(x1 - x0, y1 - y0))  # a repeat inside the seeds, its words counted once
            else:
                same += edits(a[x0 + K : x1], b[y0 + K : y1]) + K
    back, back_same = extend(a[: xs[0]][::-1], b[: ys[0]][::-1])
    on, on_same = extend(a[xs[-1] + K :], b[ys[-1] + K :])
    return int(xs[0] - back), int(xs[-1] + K + on), int(ys[0] - back), int(ys[-1] + K + on), same + back_same + on_same


def hopeless(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], min_words: int, identity: float) -> bool:
    """Whether a chain with all the words that it could have equal, and those equal beside it, can't make or hold a passage.

    Words are looked at as far as ``equal_words`` gets them. An extension goes
    further only if its first min_words words score above -8, which takes more
    equal ones than ``far``; with fewer on either side all that ``passage``
    counts is looked at.
    """
    x0, y0, x1, y1 = xs[0], ys[0], xs[-1] + K, ys[-1] + K
    head, tail = min(x0, y0, min_words), min(len(a) - x1, len(b) - y1, min_words)
    before, after = np.count_nonzero(a[x0 - head : x0] == b[y0 - head : y0]), np.count_nonzero(a[x1 : x1 + tail] == b[y1 : y1 + tail])
    far = (2 * min_words - DROP) / 3
    return max(before, after) <= far and before + after + min(x1 - x0, y1 - y0) < identity * min_words - 1e-9


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the equal words of two short stretches under the alignment that ``edits`` counts."""
    if len(a) == len(b):
        same = np.flatnonzero(a == b)
        if len(same) >= 0.5 * len(a):
            return same, same
    rows = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for n, word in enumerate(a):
        rows[n + 1, 1:] = np.maximum.accumulate(np.maximum(rows[n, 1:], rows[n, :-1] + (b == word)))
    i, j, found = len(a), len(b), []
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    pairs = np.array(found[::-1], np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def equal_words(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, bounds: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in both texts of the words that ``passage`` counts as equal, ascending."""
    x0, x1, y0, y1 = bounds
    head = np.flatnonzero(a[x0 : xs[0]] == b[y0 : ys[0]])
    seed, tail = np.arange(K), np.flatnonzero(a[xs[-1] + K : x1] == b[ys[-1] + K : y1])
    i, j = [x0 + head, xs[0] + seed], [y0 + head, ys[0] + seed]
    for x, y, u, v in zip(xs, ys, xs[1:], ys[1:]):
        if u - x == v - y and u - x <= K:
            at = np.flatnonzero(a[x + K : u + K] == b[y + K : v + K])
            i.append(x + K + at), j.append(y + K + at)
        elif u - x < K or v - y < K:
            at = np.arange(K - min(u - x, v - y), K)
            i.append(u + at), j.append(v + at)
        else:
            p, q = common(a[x + K : u], b[y + K : v])
            i += [x + K + p, u + seed]
            j += [y + K + q, v + seed]
    return np.concatenate([*i, xs[-1] + K + tail]), np.concatenate([*j, ys[-1] + K + tail])


def parts(i: np.ndarray, j: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int]]:
    """Stretches [s, e] of equal words (i, j), long and similar enough in both texts: the longest one, then those left and right of it.

    From s to e are e - s + 1 equal words, and as many as ``identity`` of the
    words in either text where e + 1 - identity (i[e] + 1) is at least
    s - identity i[s], and the same for j. Of the places after s, the last that
    meets both is looked for only where both meet it somewhere.
    """
    found, todo = [], [(0, len(i))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < identity * min_words:
            continue
        n, best = np.arange(lo, hi), None
        least = np.zeros(hi - lo, np.int64)
        last = np.full(hi - lo, hi - lo - 1)
        ends, begins = [], []
        for at in (i[lo:hi], j[lo:hi]):
            end, begin = n + 1 - identity * (at + 1), n - identity * at - 1e-9
            # The last place whose value is begin or more: suffix maxima fall, so they are searched from the end.
            falling = np.maximum.accumulate(end[::-1])
            last = np.minimum(last, hi - lo - 1 - np.searchsorted(falling, begin, "left"))
            least = np.maximum(least, np.searchsorted(at, at + min_words - 1, "left"))
            ends.append(end), begins.append(begin)
        spans = last - np.arange(hi - lo)
        for s in np.argsort(-spans, kind="stable"):
            if last[s] < least[s] or best and spans[s] <= best[1] - best[0]:
                if best and spans[s] <= best[1] - best[0]:
                    break
                continue
            fits = np.flatnonzero((ends[0][least[s] : last[s] + 1] >= begins[0][s]) & (ends[1][least[s] : last[s] + 1] >= begins[1][s]))
            if len(fits) and (not best or least[s] + fits[-1] - s > best[1] - best[0]):
                best = int(s), int(least[s] + fits[-1])
        if best:
            found.append((lo + best[0], lo + best[1]))
            todo += [(lo, lo + best[0]), (lo + best[1] + 1, hi)]
    return sorted(found)


PASSAGE = "doc_id long, th int, owner_id long, begin_word int, end_word int, begin_byte long, end_byte long, owner_begin_word int, owner_end_word int, n_same int"


class Stretches:
    """Stretches of a text of which none lies inside another, ascending, each with its row."""

    def __init__(self) -> None:
        self.begins, self.ends, self.rows = [], [], []

    def hold(self, low: int, high: int) -> bool:
        n = bisect_right(self.begins, low)
        return n > 0 and self.ends[n - 1] >= high

    def put(self, low: int, high: int, row: tuple) -> None:
        if not self.hold(low, high):
            inside = slice(bisect_left(self.begins, low), bisect_right(self.ends, high))
            self.begins[inside], self.ends[inside], self.rows[inside] = [low], [high], [row]


def align(batches: Iterator[pa.RecordBatch], min_words: int, identity: float) -> Iterator[pa.RecordBatch]:
    """Passages of each two documents, longest chain first; of those inside another in the document's text the outer one only.

    Words that repeat with a short period make chains at every period, each of
    which extends to the same end: only what no passage of the two holds is aligned.
    """
    for batch in batches:
        # Neither side's texts of a slice may be many: a short document can match a very long one.
        for block in blocks(blocks([batch], BLOCK), BLOCK, "owner_text"):
            # A text that stands in several rows is cut into words once.
            sides = [block.column(c).dictionary_encode() for c in ("text", "owner_text")]
            (mine, theirs), (own, other) = (Words(t.dictionary) for t in sides), (t.indices.to_pylist() for t in sides)
            out: list[tuple] = []
            for row, m, t in zip(block.drop_columns(["text", "owner_text"]).to_pylist(), own, other):
                a = mine.hashes[mine.first[m] : mine.first[m + 1]]
                b = theirs.hashes[theirs.first[t] : theirs.first[t + 1]]
                found = Stretches()
                for xs, ys in sorted(zip(row["xs"], row["ys"]), key=lambda c: (c[0][0] - c[0][-1], c[0][0], c[1][0])):
                    if found.hold(xs[0], xs[-1] + K) or hopeless(a, b, xs, ys, min_words, identity):
                        continue
                    *bounds, same = passage(a, b, xs, ys)
                    hits = [(*bounds, same)]
                    if min(bounds[1] - bounds[0], bounds[3] - bounds[2]) < min_words or same < identity * max(bounds[1] - bounds[0], bounds[3] - bounds[2]):
                        # What is not one passage may hold some, or be part of one that goes on past worse ends.
                        head, tail = min(xs[0], ys[0], min_words), min(len(a) - xs[-1], len(b) - ys[-1], min_words + K)
                        bounds = xs[0] - head, xs[-1] + tail, ys[0] - head, ys[-1] + tail
                        i, j = equal_words(a, b, np.array(xs), np.array(ys), bounds)
                        hits = [(int(i[s]), int(i[e]) + 1, int(j[s]), int(j[e]) + 1, e - s + 1) for s, e in parts(i, j, min_words, identity)]
                    for x0, x1, y0, y1, same in hits:
                        at, base = (mine.first[m] + x0, mine.first[m] + x1 - 1), mine.offsets[m]
                        found.put(x0, x1, (row["doc_id"], row["th"], row["owner_id"], x0, x1, int(mine.starts[at[0]] - base), int(mine.ends[at[1]] - base), y0, y1, same))
                out += found.rows
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                names = [f.split()[0] for f in PASSAGE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)


def text_hash(text: Column) -> Column:
    """Never 0."""
    return F.hash(text).bitwiseOR(F.lit(1))


def with_key(docs: DataFrame, bench: Bench, doc_id: str, text: str) -> DataFrame:
    """doc_id, th and text: the hash tells rows of one id apart and is 0 where the id is of one row only."""
    own = ids_and_texts(docs, doc_id, text)
    several = bench.keep(own.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several")), "several")
    return own.join(several, "doc_id", "left").select("doc_id", F.when(F.col("several"), text_hash(F.col("text"))).otherwise(0).alias("th"), "text")


def bucket_bits(own: DataFrame) -> int:
    """So many that a bucket stands for BUCKET_BYTES of text."""
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max((total // BUCKET_BYTES).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])


def find(docs: DataFrame, bench: Bench, doc_id: str, text: str, min_words: int, identity: float) -> DataFrame:
    own, tasks = with_key(docs, bench, doc_id, text), partitions(docs)
    bits, parts = bucket_bits(ids_and_texts(docs, doc_id, text)), 4 * tasks
    window_bits = max(bits - (WINDOW_BUCKETS.bit_length() - 1), BUCKET_BITS[0])
    runs = bench.keep(
        own.mapInArrow(lambda b: seeds(b, bits), PACKED).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(lambda b: shared(b, parts), SHARED).repartition(tasks, "part").sortWithinPartitions("part")
        .mapInArrow(lambda b: runs_of_texts(b, min_words, parts, window_bits), RUN),
        "runs",
    )
    windows = runs.where("windows IS NOT NULL").select("part", "ids", "ths", "held", "pos", "windows")
    whole = windows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(lambda b: first_holders(b, parts), MATCHES)
    of_seeds = runs.where("windows IS NULL").drop("windows")
    matches = of_seeds.withColumn("n", F.lit(0)).unionByName(whole.withColumn("n", F.lit(max(min_words - K, 0))))
    chained = bench.keep(
        matches.repartition(tasks, "part").sortWithinPartitions("part")
        .mapInArrow(lambda b: chain_matches(texts_of_parts(b), min_words, identity), CHAINS),
        "chained",
    )
    bench.drop("runs")
    wanted = chained.select("doc_id", "th").unionByName(chained.select(F.col("owner_id").alias("doc_id"), F.col("owner_th").alias("th"))).distinct()
    texts = bench.keep(own.join(wanted, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.first("text").alias("text")), "texts")
    theirs = texts.select(F.col("doc_id").alias("owner_id"), F.col("th").alias("owner_th"), F.col("text").alias("owner_text"))

    def aligned(rows: DataFrame, name: str) -> DataFrame:
        both = rows.select(*MATCH_KEYS, "xs", "ys").join(texts, ["doc_id", "th"]).join(theirs, ["owner_id", "owner_th"])
        return bench.keep(both.mapInArrow(lambda b: align(b, min_words, identity), PASSAGE), name)

    first = aligned(chained.where("NOT second"), "passages")
    # A chain inside a heavier one says nothing new if a passage was found there; else it has its turn.
    covered = first.groupBy("doc_id", "th").agg(F.collect_list(F.struct("begin_word", "end_word")).alias("covered"))
    free = F.filter(F.arrays_zip("xs", "ys"), lambda c: ~F.exists(F.coalesce("covered", F.array()), lambda p: (
        p["begin_word"] <= F.element_at(c["xs"], 1)) & (p["end_word"] >= F.element_at(c["xs"], -1) + K)))
    rest = (
        chained.where("second").join(covered, ["doc_id", "th"], "left").withColumn("free", free).where(F.size("free") > 0)
        .withColumns({"xs": F.col("free.xs"), "ys": F.col("free.ys")})
    )
    found = first.unionByName(aligned(rest, "more-passages"))
    bench.drop("chained", "texts")
    return found


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """One row per fuzzy passage of a document that an earlier document holds.

    doc_id and keep_id, the document that keeps it; its words and UTF-8 bytes
    in the text, [begin, end); its words in the other; equal words.
    """
    found = find(docs, Bench(docs.sparkSession, "substring-dedup"), doc_id, text, min_words, identity)
    return found.select(
        given_id(), F.when(F.col("owner_id") != NO_ID, F.col("owner_id")).alias("keep_id"), "begin_word", "end_word", "begin_byte", "end_byte",
        F.col("owner_begin_word").alias("keep_begin_word"), F.col("owner_end_word").alias("keep_end_word"), "n_same",
    )


def cut(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Texts without the stretches listed beside them; what is left is joined by the blanks around it."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for r, spans in enumerate(batch.column("__spans").to_pylist()):
            if spans:
                raw, kept, at = texts[r].encode(), [], 0
                for span in sorted((s["begin_byte"], s["end_byte"]) for s in spans):
                    kept.append(raw[at : max(at, span[0])])
                    at = max(at, span[1])
                texts[r] = b"".join([*kept, raw[at:]]).decode()
        place = batch.schema.get_field_index(text)
        yield batch.set_column(place, text, pa.array(texts, batch.schema.field(place).type)).drop_columns(["__spans"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """All documents, repeated passages cut out of all but the first holder; a column of text lengths follows."""
    found = find(docs, Bench(docs.sparkSession, "remove-repeats"), doc_id, text, min_words, identity)
    spans = found.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("begin_byte", "end_byte")).alias("__spans"))
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))
    hashed = text_hash(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    marked = docs.join(spans, (key == F.col("__id")) & F.col("__th").isin(F.lit(0), hashed), "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__spans")
    out = marked.mapInArrow(lambda b: cut(b, text), docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
