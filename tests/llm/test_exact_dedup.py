"""Exact dedup against a plain dictionary."""

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from inkfield.llm import exact_dedup
from tests.llm.helpers import ODD, UPPER, documents

SKEWED = [(i, "Same text") for i in range(40)] + [(100 + i, f"text {i % 7}") for i in range(30)] + [(300 + i, f"own {i}") for i in range(30)]


@pytest.mark.parametrize("rows", [ODD, SKEWED])
@pytest.mark.parametrize("counters", [1, 4, 1024])
def test_groups(spark, rows, counters):
    got = exact_dedup.decide(documents(spark, rows), counters=counters).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append((r.doc_id, r.keep_id))
    assert all(len(k) == 1 and k[0][0] == k[0][1] for k in kept.values()) and len(kept) == len(groups)


@pytest.mark.parametrize("rows", [ODD, SKEWED])
def test_drop_copies_keeps_one_row_of_each_text(spark, rows):
    docs = documents(spark, rows)
    left = exact_dedup.drop_copies(docs, counters=2)
    assert left.columns == docs.columns
    texts = [(r.text or "").translate(UPPER) for r in left.collect()]
    assert sorted(texts) == sorted({(t or "").translate(UPPER) for _, t in rows})


def test_empty(spark):
    docs = documents(spark, [])
    assert exact_dedup.decide(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_summary_finds_what_is_frequent():
    values = ([b"a"] * 50 + [b"b"] * 30) + [bytes([i]) for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i::7], pa.binary())], ["digest"]) for i in range(7)]
    (found,) = exact_dedup.summarise(iter(batches), 5)
    assert {b"a", b"b"} <= set(found.column(0).to_pylist()) and found.num_rows <= 5
