"""Round trips of chats and archives."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from inkfield.llm import chat_format as cf, warc
from inkfield.session import scratch_path

BYTES = "byte_bpe_50k.json"
TEXTS = ["", None, "hi", "\\### Assistant: </turn> ok", "### User: x", "\\\\</turn>", "</turn></turn>###", "#### a ##", "<|endoftext|>", "é 😀\n\n  x", "\\", "a" * 5000]


def test_chats(spark):
    path = public_tokenizers.path(BYTES)
    rows = [(c, t, ("user", "assistant", None, "assistant")[(t + c) % 4], TEXTS[(3 * c + t) % len(TEXTS)], "clash") for c in range(-2, 5) for t in range(c + 3)]
    rows += [(None, 0, "assistant", "z", ""), (9, None, "assistant", "y", ""), (9, 1, "assistant", "same", ""), (9, 1, "assistant", "same", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    formatted = cf.format_chats(table, path)
    got = {r.conv_id: r for r in cf.digests(formatted, path).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    for r in formatted.collect():
        assert len(r.ids) == len(r.loss) and r.formatted.count(cf.END) >= 1
        assert r.formatted[len(cf.OPEN) : -len(cf.END)].replace("\\###", "").replace("\\</turn>", "").count("</turn>") == 0
    assert cf.digests(cf.format_chats(table.where("false"), path), path).count() == 0


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_escape_is_reversible(text):
    assert cf.unescape(cf.escape(text)) == text
    assert not np.any([cf.escape(text).startswith("###"), "</turn>" in cf.escape(text).replace("\\</turn>", "")])


def test_chunks():
    for n in (0, 1, 8192, 20_000):
        assert warc.unchunked(warc.chunked(bytes(range(256)) * (n // 256) + b"x" * (n % 256))) == bytes(range(256)) * (n // 256) + b"x" * (n % 256)
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


@pytest.mark.parametrize("segment,archive", [(300, 2000), (1 << 20, 1 << 28)])
def test_archives(spark, segment, archive):
    big = "<p>é" + "payload " * 300
    rows = [(i, f"http://x/{i}\r\ny", big if i % 3 == 0 else f"<p>{i}" * (i * 20)) for i in range(30)]
    rows += [(40, None, None), (41, "u", ""), (None, "u", big), (50, "u", big), (50, "u", big), (60, "u", "short"), (61, "u", "short")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "w")
    got = warc.read_warc(spark, warc.write_warc(pages, folder, segment=segment, archive=archive), folder).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(i, largest.get(h, i))
    raw = {i: (h or "").encode() for i, _, h in rows}
    responses = defaultdict(int)
    for r in got:
        payload = raw[r.page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        keep = largest.get(payload.decode())
        assert r.refers_to == (None if r.record_type == "response" else keep)
        responses[r.payload_digest] += r.record_type == "response" and len(payload) >= 1000
        if keep is not None and r.page_id != keep:
            assert r.record_type == "revisit"
    assert all(n == 1 for d, n in responses.items() if n) and responses[hashlib.sha1(big.encode()).hexdigest()] == 1
    empty = scratch_path(spark, "w")
    assert warc.read_warc(spark, warc.write_warc(pages.where("false"), empty), empty).count() == 0


def test_a_lost_segment_is_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    folder = scratch_path(spark, "w")
    index = warc.write_warc(pages, folder, segment=500)
    records = index.mapInArrow(lambda b: warc.parse(b, folder), warc.RECORD).where("segment IS NULL OR segment <> 3")
    cut = records.groupBy("origin").agg(__import__("pyspark").sql.functions.expr("sort_array(collect_list(struct(segment, total, type, page_id, payload_digest, block)))").alias("parts"))
    with pytest.raises(Exception, match="has segments"):
        cut.mapInArrow(warc.reassemble, "record_id string, type string, page_id long, payload_bytes long, payload_digest string").collect()
