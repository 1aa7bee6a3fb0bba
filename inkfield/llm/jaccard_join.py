"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct shingles as 64-bit hashes. Documents of equal
sets are one class, and only classes are joined.

1. A class can have a partner only if enough of its smallest hashes occur in
   another class: two sets with an overlap of o share their first l common
   hashes within their first n - o + l. Classes for which they don't are done.
2. The others' shingles are put into one global order, rare ones first, which is
   cut into fragments of equally many occurrences. A class has a segment of its
   set in each fragment.
3. Pairs come from equal shingles among the first n - o + 1 of that order. A
   pair's overlap is counted in each fragment on its own and summed.
4. No group's pairs are all made: each shingle has a few leaders, and a round
   compares each class with the leaders that it shares most shingles with; links
   join components. When a round joins little more, the pairs left between
   different components are compared, all of them, so no link is lost.

A null text or one without words has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle. Rows of one id are rows of
their own; a null id is the smallest. Repeated rows are one class. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkfield.llm.common import NO_ID, Bench, Words, blocks, given_id, ids_and_texts, mix

BLOCK = 1 << 20
#: Fragments of the global order; rounds against leaders go on while they join this share of the classes.
FRAGMENTS, GOES_ON, ROUNDS = 4, 0.005, 4
#: Leaders of a shingle, and the most of them that a class is compared with in a round.
LEADERS = 3
#: A class is done with when its head shares less than one in so many of its shingles.
EARLY = 20
SETS = "doc_id long, n long, s1 long, s2 long, hashes array<long>"


def ceil_div(x: Column, by: int) -> Column:
    return F.ceil(x / F.lit(by)).cast("long")


def sets(batches: Iterator[pa.RecordBatch], size: int, percent: int | None) -> Iterator[pa.RecordBatch]:
    """Each text's set: its size, a 128-bit signature, and its hashes, all or only those that decide on a partner."""
    for block in blocks(batches, BLOCK):
        words = Words(block.column("text"))
        runs = {size: words.runs(size)}
        n, s1, s2, lists = [], [], [], []
        for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
            if b - a >= size:
                own = np.unique(runs[size][a : b - size + 1])
            elif b > a:
                if b - a not in runs:
                    runs[b - a] = words.runs(b - a)
                own = runs[b - a][a : a + 1]
            else:
                own = np.zeros(0, np.uint64)
            n.append(len(own))
            s1.append(own.sum(dtype=np.uint64))
            s2.append(np.bitwise_xor.reduce(mix(own)) if len(own) else np.uint64(0))
            if percent is not None:
                own = own[: len(own) - -(-percent * len(own) // 100) + -(-len(own) // EARLY)]
            lists.append(own)
        flat = np.concatenate(lists).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["doc_id", "n", "s1", "s2", "hashes"],
        )


def connected(edges: DataFrame, bench: Bench, name: str) -> DataFrame:
    """Components of links (a, b): node, comp, comp being the smallest node.

    Each round every node takes the smallest label around it and then that
    label's own label, so chains of n nodes take about log n rounds.
    """
    both = bench.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = bench.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        closer = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        stepped = bench.keep(
            closer.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("comp")), f"{name}-{turn}"
        )
        bench.drop(f"{name}-{turn - 1}")
        labels = stepped.select("node", "comp")
        if stepped.where("was <> comp").isEmpty():
            bench.drop(f"{name}-both")
            return labels


def needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of two sets of these sizes that makes a link."""
    return ceil_div((n + m) * percent, 100 + percent)


def linked_pairs(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs the linked ones: overlaps counted by fragment, then summed."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("hashes").alias("of_a"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("hashes").alias("of_b"))
    partial = (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", "least", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("overlap"))
    )
    return partial.groupBy("a", "b", "least").agg(F.sum("overlap").alias("overlap")).where("overlap >= least").select("a", "b")


def join_classes(classes: DataFrame, heads: DataFrame, own: DataFrame, bench: Bench, size: int, percent: int) -> DataFrame | None:
    """Components of classes by their links: node, comp; None when nothing can be linked. ``heads`` has their smallest hashes."""
    rows = heads.where("n > 0").select("node", F.explode("hashes").alias("h"))
    known = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h")
    alive = bench.keep(
        rows.join(known, "h").groupBy("node").agg(F.count("*").alias("met"))
        .join(classes.hint("merge"), "node").where(F.col("met") >= ceil_div(ceil_div(F.col("n") * percent, 100), EARLY)),
        "alive",
    )
    bench.drop("heads-of")
    # These sides grow with the documents, so they are merged at any size and never sent to every task.
    texts = own.join(alive.select(F.col("least").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    full = texts.mapInArrow(lambda b: sets(b, size, None), SETS)
    whole = bench.keep(
        full.join(alive.select("node", "n", "s1", "s2").hint("merge"), ["n", "s1", "s2"]).groupBy("node", "n").agg(F.first("hashes").alias("hashes")), "whole"
    )
    bench.drop()  # the texts' shuffle is large and done with
    rows = whole.select("node", "n", F.explode("hashes").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = bench.keep(
        rows.join(often, "h").select("node", "n", "h", F.shiftleft(F.least("df", F.lit((1 << 22) - 1)), 41).bitwiseOR(F.shiftrightunsigned("h", 23)).alias("key")),
        "shared",
    )
    bench.drop("whole")
    cuts = shared.agg(F.percentile_approx("key", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000).alias("c")).head()["c"]
    if not cuts:
        return None
    fragment = sum(((F.col("key") >= c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    segments = bench.keep(shared.groupBy("node", fragment.alias("fragment")).agg(F.collect_list("h").alias("hashes")), "segments")
    ordered = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("key", "h"))).alias("o"))
    alone = F.col("n") - F.size("o")  # shingles of no other class, first in the order
    first = (F.col("n") - ceil_div(F.col("n") * percent, 100) + 1 - alone).cast("int")
    heads = bench.keep(
        ordered.where(first > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("o", 1, first)).alias("i", "o"))
        .select("node", "n", F.col("o.h").alias("h"), (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), F.floor(F.col("alone") * 100 / F.col("n")).alias("own")),
        "heads",
    )
    bench.drop("shared")
    comps, links, turn, last = None, None, 0, False
    count = heads.select("node").distinct().count()
    while True:
        of = heads.withColumn("comp", F.col("node"))
        if comps is not None:
            of = heads.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        fields = ("node", "n", "comp", "rest")
        # The first leader is one with few shingles of its own: a group's plainest text is near to most of its copies.
        draw = [F.xxhash64("node", F.lit(turn * LEADERS + k)) for k in range(LEADERS)]
        leads = [F.min(F.struct(*([] if k else ["own"]), draw[k], *fields)).alias(f"lead_{k}") for k in range(LEADERS)]
        mixed = of.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *leads).where("low <> high")
        if last:
            mates = of.join(mixed.select("h"), "h", "left_semi").select("h", F.lit(0).alias("k"), *(F.col(c).alias(f"b_{c}") for c in fields))
        else:
            each = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"lead_{k}.{c}").alias(f"b_{c}") for c in fields)) for k in range(LEADERS)))
            mates = mixed.select("h", F.inline(each))
        least = needed(F.col("n"), F.col("b_n"), percent)
        # Each pair of components from one side when all are made; a leader is on the other side from the start.
        apart = F.col("comp") < F.col("b_comp") if last else F.col("comp") != F.col("b_comp")
        # What follows the first common shingle, it included, must be enough for a link.
        met = of.join(mates, "h").where(apart & (least <= F.least("rest", "b_rest"))).select("node", "k", "b_node", least.alias("least"))
        if not last:
            shared_most = F.max(F.struct("times", (-F.col("b_node")).alias("other"), "least")).alias("m")
            met = met.groupBy("node", "k", "b_node", "least").agg(F.count("*").alias("times")).groupBy("node", "k").agg(shared_most)
            met = met.select("node", (-F.col("m.other")).alias("b_node"), "m.least")
        pairs = bench.keep(met.select(F.least("node", "b_node").alias("a"), F.greatest("node", "b_node").alias("b"), "least").distinct(), f"pairs-{turn}")
        found = bench.keep(linked_pairs(pairs, segments, percent), f"links-{turn}")
        new = found.count()
        bench.drop(f"pairs-{turn}")
        if new:
            links = found if links is None else links.unionByName(found)
            comps = connected(links, bench, f"comps-{turn}")
        if last:
            bench.drop("segments", "heads")
            return comps
        turn += 1
        last = new <= GOES_ON * count or turn == ROUNDS


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and class_size, the rows of its class."""
    bench = Bench(docs.sparkSession, "jaccard-join")
    own = ids_and_texts(docs, doc_id, text)
    found = bench.keep(own.mapInArrow(lambda b: sets(b, size, percent), SETS), "found")
    heads = bench.keep(
        found.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"), F.first("hashes").alias("hashes"))
        .withColumn("node", F.monotonically_increasing_id()),
        "heads-of",
    )
    each, classes = bench.keep(found.drop("hashes"), "sets"), bench.keep(heads.drop("hashes"), "classes")
    bench.drop("found")
    comps = join_classes(classes, heads.select("node", "n", "hashes"), own, bench, size, percent)
    named = classes
    if comps is None:
        final = named.withColumn("component", F.col("least"))
    else:
        first = comps.join(named, "node").groupBy("comp").agg(F.min("least").alias("first"))
        linked = comps.join(first, "comp").select("node", "first")
        final = named.join(linked, "node", "left").withColumn("component", F.coalesce("first", "least"))
    final = bench.keep(final.select("n", "s1", "s2", "class_size", "component"), "final")
    out = each.join(final, ["n", "s1", "s2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "class_size",
    )
    out = bench.keep(out, "components")
    bench.drop("sets", "classes", "alive", "final")
    return out.select(given_id(), "n_shingles", given_id("component_id"), "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their component, all columns; rows that share this id all stay."""
    found = components(docs, doc_id, text, size, percent)
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))
    lost = found.where(key("doc_id") != key("component_id")).select(key("doc_id").alias("__lost")).distinct()
    return docs.join(lost, key(f"`{doc_id}`") == F.col("__lost"), "left_anti")
