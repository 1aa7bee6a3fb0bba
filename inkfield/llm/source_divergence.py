"""Source divergence audit: how the terms of each source differ from its language and from its other sources.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A language
keeps its V terms that at least ``least_docs`` of its documents hold. A group (a
source of a language), and a language as a whole, gives a kept term
p = 1 + floor(10^9 * (count + 1) / (N + V)), N its occurrences of kept terms; one
group differs from another (q) by f = floor((p - q)^2 / q) at a term.

- Terms are counted where texts are read, so a row leaves a task once per group and term.
- A group's terms are ranked by count cells: terms of equal (group count, language
  count) have one value. Cells of equal value are merged, the cumulative
  multiplicity shows which values reach the last rank, and only those cells are
  expanded into terms, in UTF-8 order.
- For pairs of sources, terms of equal counts in all sources are one cell too. A
  task takes the cells of a slice of a language's terms and sums f for every pair
  of its sources, so no row is made for a pair at a term.

All arithmetic is on integers. Null text, lang and source are empty strings; a
document without terms still makes its group occur. Repeated rows are documents of
their own; ids are not read. Without kept terms all pair values are 0 and there is no
term row. Equal values rank by UTF-8 order. An empty table gives an empty result. A
text of any length is counted in slices.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfield.llm.common import LOWER, UPPER, Bench
from inkfield.llm.filter_audit import slices

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms that a task counts before it passes them on; cells of a slice of a language.
HELD, CELLS = 200_000, 10_000
#: Bytes of terms as they are: A-Z as a-z, all other signs of ASCII as blanks.
TERMS = bytes(
    c if c >= 128 or 97 <= c <= 122 else LOWER.encode()[UPPER.encode().index(c)] if 65 <= c <= 90 else 32 for c in range(256)
)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a null term says that the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, source, term, n, d[term]) for (lang, source), (c, d) in held.items() for term, n in c.items()]
        rows += [(lang, source, None, 0, 0) for lang, source in held]
        lang, source, term, n, d = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
            ["lang", "source", "term", "n", "d"],
        )

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for part in slices(text.as_py().encode().translate(TERMS)):
                terms = part.split()
                n.update(terms)
                own.update(terms)
            d.update(own)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def probability(count: str, total: str, kept: str) -> Column:
    """p in exact integers of any size; null where nothing is kept."""
    return F.expr(
        f"1 + CAST({SCALE} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(20,0)) + CAST(1 AS DECIMAL(1,0)))"
        f" div nullif(CAST({total} AS DECIMAL(20,0)) + CAST({kept} AS DECIMAL(20,0)), 0)"
    )


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


class Counts:
    """The counted terms of a table, written once and read by both parts."""

    def __init__(self, docs: DataFrame, text: str, lang: str, source: str, least_docs: int):
        bench = Bench(docs.sparkSession, "divergence")
        own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))))
        rows = own.mapInArrow(counted, "lang string, source string, term string, n long, d long")
        each = bench.keep(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "counts")
        whole = each.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("d").alias("d"))
        kept = bench.keep(whole.where(F.col("d") >= least_docs).select("lang", "term", "whole"), "kept")
        self.terms = bench.keep(each.drop("d").join(kept, ["lang", "term"]), "terms")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n"))
        sums = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
        every = each.where("term IS NULL").select("lang", "source")
        self.groups = bench.keep(
            every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["v", "lang_n", "own_n"]), "groups"
        )
        self.bench = bench


def top_terms(counts: Counts, top: int) -> DataFrame:
    """lang, source, item, value, rank of each group's terms that stand above their language, to rank ``top``."""
    cells = counts.terms.groupBy("lang", "source", "n", "whole").agg(F.count("*").alias("times")).join(counts.groups, ["lang", "source"])
    valued = counts.bench.keep(
        cells.withColumns({"p": probability("n", "own_n", "v"), "q": probability("whole", "lang_n", "v")})
        .where("p > q").select("lang", "source", "n", "whole", "times", difference("p", "q").alias("value")),
        "cells",
    )
    group = Window.partitionBy("lang", "source")
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    # A value holds a term at least, so the last rank lies within the first `top` values.
    first = merged.withColumn("place", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("place") <= top)
    before = F.sum("times").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("times")
    reached = first.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    wanted = valued.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "whole", "value")
    expanded = counts.terms.join(wanted, ["lang", "source", "n", "whole"]).select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    return expanded.withColumn("rank", rank).where(F.col("rank") <= top)


def pair_sums(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """f summed over a slice's cells for every ordered pair of the language's sources."""
    groups = groups.sort_by("source")
    sources, zero = groups.column("source").to_pylist(), groups.column("zero").to_numpy()
    at = {s: i for i, s in enumerate(sources)}
    total = np.zeros((len(sources), len(sources)), np.int64)
    step = max(1, (1 << 20) // max(1, len(sources)))
    for batch in cells.to_batches(max_chunksize=step):
        p = np.tile(zero, (batch.num_rows, 1))
        vectors = batch.column("vector")
        row = np.repeat(np.arange(batch.num_rows), vectors.value_lengths().to_numpy())
        flat = vectors.flatten()
        p[row, [at[s] for s in flat.field("source").to_pylist()]] = flat.field("p").to_numpy()
        times = batch.column("times").to_numpy()[:, None]
        for i in range(len(sources)):
            d = p[:, i : i + 1] - p
            total[i] += (d * d // p * times).sum(axis=0)
    lang = groups.column("lang")[0].as_py()
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "source": pa.array([sources[i] for i in a], pa.string()),
        "item": pa.array([sources[i] for i in b], pa.string()), "value": pa.array(total[a, b], pa.int64()),
    })


def source_pairs(counts: Counts) -> DataFrame:
    """lang, source, item (another source), value and rank, all of them."""
    own = counts.terms.join(counts.groups.select("lang", "source", "own_n", "v"), ["lang", "source"])
    entries = own.select("lang", "term", F.struct("source", probability("n", "own_n", "v").alias("p")).alias("entry"))
    vectors = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list("entry")).alias("vector"))  # a source once each
    cells = counts.bench.keep(vectors.groupBy("lang", "vector").agg(F.count("*").alias("times")), "vectors")
    sized = cells.groupBy("lang").agg(F.count("*").alias("cells"))
    parts = F.coalesce(F.ceil(F.col("cells") / CELLS), F.lit(1)).cast("int")
    groups = (
        counts.groups.select("lang", "source", F.coalesce(probability("0", "own_n", "v"), F.lit(1)).alias("zero"))
        .join(sized, "lang", "left").select("lang", "source", "zero", F.explode(F.sequence(F.lit(0), parts - 1)).alias("slice"))
    )
    dealt = cells.join(sized, "lang").select("lang", "vector", "times", F.pmod(F.xxhash64("vector"), parts).cast("int").alias("slice"))
    sums = dealt.groupBy("lang", "slice").cogroup(groups.groupBy("lang", "slice")).applyInArrow(pair_sums, "lang string, source string, item string, value long")
    whole = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = Counts(docs, text, lang, source, least_docs)
    return (
        source_pairs(counts).withColumn("part", F.lit("pair")).unionByName(top_terms(counts, top).withColumn("part", F.lit("term")))
        .select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
    )
