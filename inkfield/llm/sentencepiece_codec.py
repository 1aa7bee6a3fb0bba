"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here and its tokenizer is rebuilt from what
it says: normaliser, the marker that stands for a blank, scores (as unigram
scores, or as the order of merges for a BPE model) and byte fallback. Batches
are encoded by the library's threads. Every word that a task meets for the first
time is encoded by the sentencepiece library as well, and the task fails if the
two differ, so ids that are written are the model's own.

A null or empty text has no ids and decodes to the empty text. Rows of equal
texts have equal ids. An empty table gives an empty one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkfield.llm.common import blocks, given_id, ids_and_texts
from inkfield.llm.tokens import AT_ONCE, BLANK, Encoder

MARK = "▁"
BLOCK = 4 << 20
#: Kinds of pieces and of models in the protobuf: fixed values of the format.
UNKNOWN, BYTE, USER, UNIGRAM, BPE = 2, 6, 4, 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers of varints, bytes of all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    """What of a model file decides on ids."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_blank: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        model = cls()
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(fields(value))
                model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.one_blank = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return model

    def words_stand_alone(self) -> bool:
        """No piece goes on over a blank and no normalisation looks beyond a word."""
        crossing = any(MARK in p[1:] and p.strip(MARK) for p, _, _ in self.pieces)
        return not (self.charsmap or self.one_blank or crossing or any(k == USER and p.strip(MARK) for p, _, k in self.pieces))

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usual = {p: s for p, s, kind in self.pieces if kind in (1, USER)}
            merges = []
            for piece, score in usual.items():
                merges += [(-score, vocab[piece], k, piece) for k in range(1, len(piece)) if piece[:k] in usual and piece[k:] in usual]
            core = models.BPE(vocab, [(p[:k], p[k:]) for _, _, k, p in sorted(merges)], unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind} has no counterpart")
        tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.one_blank:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        tokenizer.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return tokenizer


class PieceEncoder(Encoder):
    """Ids of whole texts; words between single blanks are encoded once where the model lets them stand alone."""

    drops_blanks, head = False, " "

    def __init__(self, path: str, threads: int):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as source:
            self.model = Model.parse(source.read())
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = self.model.tokenizer()
        self.slim = Tokenizer(self.whole.model)
        self.slim.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
        self.by_words = self.model.words_stand_alone() and self.model.dummy_prefix and self.model.byte_fallback
        self.line_id = self.whole.token_to_id("<0x0A>")
        self.mark_id = self.whole.token_to_id(MARK)
        self.forget()

    def plain(self, column: pa.Array) -> np.ndarray:
        if not self.by_words:
            return np.zeros(len(column), bool)
        odd = pc.match_substring_regex(column, BLANK + "{2}|^$|^ |" + MARK)
        return ~odd.to_numpy(zero_copy_only=False)

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        found = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        found = [ids if text else ids[:0] for ids, text in zip(found, texts)]
        self.agree(found, self.own.encode(texts, num_threads=1), texts)
        return found

    def agree(self, ours: list, theirs: list, texts: list[str]) -> None:
        for a, b, text in zip(ours, theirs, texts):
            if len(a) != len(b) or any(x != y for x, y in zip(a, b)):
                raise ValueError(f"the rebuilt tokenizer differs from its model on {text[:200]!r}")

    def new_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = column.to_pylist()
        pools, theirs = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        batch = [words[at : at + AT_ONCE] for at in range(0, len(words), AT_ONCE)]
        lines = ["\n".join(["", *(w[1:] if w[:1] == "\n" else MARK + w for w in some)]) for some in batch]
        pools += [np.array(e.ids, "<u4") for e in self.slim.encode_batch_fast(lines, add_special_tokens=False)]
        # The model's own library puts its marker only at the start, where one line feed is enough to set it apart.
        lines = ["\n".join(["", *(w[1:] if w[:1] == "\n" else " " + w for w in some)]) for some in batch]
        theirs += [np.array(ids, "<u4")[1:] for ids in self.own.encode(lines, num_threads=1)]
        pool, theirs = np.concatenate(pools), np.concatenate(theirs)
        if not np.array_equal(pool, theirs):
            raise ValueError("the rebuilt tokenizer differs from its model")
        cuts = np.append(np.flatnonzero(pool == self.line_id), len(pool))
        if len(cuts) != len(words) + 1:
            raise ValueError("words and separators differ")
        starts_line = np.fromiter((w[:1] == "\n" for w in words), bool, len(words))
        begins = cuts[:-1] + ~starts_line  # the separator before it is the line feed of a word that starts a line
        return begins, cuts[1:] - begins, pool


_codecs: dict[tuple[str, int], PieceEncoder] = {}


def codec(path: str, threads: int) -> PieceEncoder:
    if (path, threads) not in _codecs:
        _codecs[path, threads] = PieceEncoder(path, threads)
    return _codecs[path, threads]


def coded(batches: Iterator[pa.RecordBatch], path: str, threads: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tool = codec(path, threads)
    for block in blocks(batches, BLOCK):
        ids, counts = tool.encode(block.column("text"))
        ends = np.cumsum(counts)
        parts = np.split(ids, ends[:-1])
        back = tool.whole.decode_batch([p.tolist() for p in parts], skip_special_tokens=False)
        same = [a == b for a, b in zip(back, block.column("text").to_pylist())]
        crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
        columns = [block.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same)]
        names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
        if with_ids:
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), pa.array(back)]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", threads: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (of unsigned 32-bit ids), round_trip, and ids and the decoded text if asked for."""
    ddl = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>, decoded string" if with_ids else "")
    own = ids_and_texts(docs, doc_id, text)
    out = own.mapInArrow(lambda b: coded(b, path, threads, with_ids), ddl)
    return out.select(given_id(), *[c for c in out.columns if c != "doc_id"])
