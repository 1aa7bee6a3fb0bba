"""Word-wise encoding, token files and packing against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkfield.llm import packing, sentencepiece_codec, token_files
from inkfield.llm.tokens import Encoder
from inkfield.session import scratch_path
from tests.llm.helpers import ODD, documents, passage

TEXTS = [t for _, t in ODD] + ["", "\n", " ", "x \n y", "\n \nb", "12 34a, b... ?!", "漢字 かな。\n한글", "ﬁ K", "a\u0085 b", "a　　b", "tab\tx", "A.B C,D. E"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    tool, library = Encoder(path), Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    for _ in range(2):  # the second time from memory
        ids, counts = tool.encode(pa.array(TEXTS, pa.string()))
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, folder = Tokenizer.from_file(path), scratch_path(spark, "t")
    docs = documents(spark, ODD)
    index = token_files.write_tokens(docs, folder, path, end_id=1)
    got = [tuple(r) for r in token_files.read_tokens(spark, index, folder).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    want = [(i, len(ids), crc(ids)) for i, t in ODD for ids in [library.encode(t or "", add_special_tokens=False).ids + [1]]]
    assert sorted(((g[0], *g[2:]) for g in got), key=repr) == sorted(want, key=repr)
    for row in index.collect():
        ids, offsets, ids_of = token_files.read_shard(folder, row.asDict())
        assert offsets[-1] - offsets[0] == len(ids) and offsets[0] == row.base and len(offsets) == len(ids_of) + 1
    empty = token_files.write_tokens(documents(spark, []), folder, path, end_id=1)
    assert token_files.read_tokens(spark, empty, folder).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = ODD + [(100 + i, " ".join(passage(i, 10 + 7 * i))) for i in range(60)]
    got = packing.pack(documents(spark, rows), path, most=512).collect()
    want = []
    for i, t in rows:
        ids = Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids) + 1, 512)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    places = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert places.get(r.sequence_id, 0) == r.offset
        places[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in got)
    assert max(places.values()) <= 512 and len(places) <= 1.02 * total / 512 + 1
    assert packing.pack(documents(spark, []), path).count() == 0


def test_evolution_keeps_every_piece_and_mends_a_poor_start():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 90, 300).tolist()
    poor = [[i for i in range(300)]]  # a bin for each piece
    crowd = packing.seeded(lengths, 100, rng, 3, True) + poor
    best = packing.from_genes(lengths, 100, packing.evolve(lengths, 100, crowd, 20, rng)[0])
    assert sorted(i for g in best.groups for i in g) == list(range(300)) and max(best.fill) <= 100
    assert len(best.groups) <= -(-sum(lengths) // 100) + 2


def test_sentencepiece_equals_its_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    tool = sentencepiece_codec.PieceEncoder(path, 1)
    texts = [*TEXTS, "▁ a", " a", "   ", "<s> x </s>"]
    for _ in range(2):
        ids, counts = tool.encode(pa.array(texts, pa.string()))
        parts = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
        assert parts == [tool.own.encode(t or "") for t in texts]
    assert tool.whole.decode_batch(parts, skip_special_tokens=False) == [tool.own.decode(p) for p in parts]
    got = sentencepiece_codec.encode_decode(documents(spark, ODD), path).collect()
    assert all(r.decoded == (t or "") and r.round_trip and r.n_tokens == len(r.ids) for r, (_, t) in zip(got, ODD))
    assert sentencepiece_codec.encode_decode(documents(spark, []), path).count() == 0


def test_query_gives_ids_and_texts(spark, tmp_path):
    from inkfield.llm.queries import QUERIES

    documents(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_sentencepiece"](spark, str(tmp_path)).collect()
    assert len(got) == len(ODD) and all(len(r.ids) == r.n_tokens and isinstance(r.decoded, str) for r in got)
