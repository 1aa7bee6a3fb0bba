"""Token ids of whole texts with the tokenizers library.

A text is cut at blanks, where neither tokenizer ever joins two tokens, and each
distinct word of a slice of texts is encoded once: by the tokenizer's own model
for words of letters and closing marks, by the tokenizer as it is for all
others. Texts that such a cut could change are encoded as they are.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words remembered from slice to slice, and words in one call of the library.
REMEMBERED, AT_ONCE = 500_000, 2000
BLANK = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]"
#: Stand-ins for the separator of words and for a word's leading blank, as raw bytes.
SIMPLE = r"^\n?\p{L}+[.,;:!?]*$"
CUT, LEAD = "\x00", "\x01"


def byte_names() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain}
    return names | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in names)}


class Encoder:
    """``encode`` of the tokenizer in ``path`` without added special tokens, for many texts at a time."""

    #: What stands before a text, so that its first word is like any other.
    head = "\n"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # A tokenizer that lower-cases drops blanks altogether; the other puts a blank before its word.
        self.drops_blanks = self.whole.normalizer is not None
        self.slim = Tokenizer(self.whole.model)
        self.slim.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        names = byte_names()
        self.spelt = [(chr(b), n) for b, n in names.items() if b != 0x20 and chr(b) != n and b != ord(LEAD)]
        self.spelt.insert(0, (LEAD, names[0x20]))
        (self.cut_id,) = self.slim.encode(names[ord(CUT)], add_special_tokens=False).ids
        self.forget()
        if not self.drops_blanks:
            (self.line_id,) = self.whole.encode("\n", add_special_tokens=False).ids

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.begins = self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for at in range(0, len(texts), 64):
            found += [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        return found

    def new_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words as they stand between blanks: where each begins, its length, and all ids.

        A word that starts a line starts with its line feed.
        """
        easy = pc.match_substring_regex(column, SIMPLE)
        if self.drops_blanks:  # these are lower-cased by context or to two signs
            easy = pc.and_(easy, pc.invert(pc.match_substring_regex(column, "[İΣ]")))
        easy = easy.to_numpy(zero_copy_only=False)
        begins, lengths = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        split = pc.replace_substring_regex(column.filter(pa.array(easy)), r"([.,;:!?]+)$", r" \1")
        if self.drops_blanks:
            split = pc.replace_substring(split, "\n", "")
        else:
            split = pc.replace_substring_regex(pc.replace_substring_regex(split, r"^([^\n])", LEAD + r"\1"), r"^\n", "\n ")
        split = split.to_pylist()
        pools = [np.zeros(0, "<u4")]
        for at in range(0, len(split), AT_ONCE):
            line = f"{CUT} " + f" {CUT} ".join(split[at : at + AT_ONCE])
            if self.drops_blanks:
                line = unicodedata.normalize("NFC", line).lower()
            line = line.encode().decode("latin-1")
            for raw, name in self.spelt:
                if raw in line:
                    line = line.replace(raw, name)
            pools.append(np.array(self.slim.encode(line, add_special_tokens=False).ids, "<u4"))
        ids = np.concatenate(pools)
        cuts = np.append(np.flatnonzero(ids == self.cut_id), len(ids))
        if len(cuts) != easy.sum() + 1:
            raise ValueError("words and separators differ")
        begins[easy], lengths[easy] = cuts[:-1] + 1, np.diff(cuts) - 1
        pools, at = [ids], len(ids)
        hard = np.flatnonzero(~easy)
        words = column.take(pa.array(hard)).to_pylist()
        line = None if self.drops_blanks else np.array([self.line_id], "<u4")
        plain = words if self.drops_blanks else [w[1:] if w[:1] == "\n" else " " + w for w in words]
        for i, word, ids in zip(hard.tolist(), words, self.direct(plain)):
            if line is not None and word[:1] == "\n":
                ids = np.concatenate([line, ids])
            begins[i], lengths[i] = at, len(ids)
            pools.append(ids)
            at += len(ids)
        return begins, lengths, np.concatenate(pools)

    def plain(self, column: pa.Array) -> np.ndarray:
        """Texts whose words can be encoded by themselves."""
        if self.drops_blanks:
            return np.ones(len(column), bool)
        odd = pc.match_substring_regex(column, BLANK + "{2}|" + r"\x00|<\|")
        return ~odd.to_numpy(zero_copy_only=False)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts end to end, and how many each text has."""
        column = column.cast(pa.large_string()).fill_null("")
        plain = self.plain(column)
        if plain.all():
            return self.by_word(column)
        counts, found = np.zeros(len(column), np.int64), [np.zeros(0, "<u4")] * len(column)
        odd = np.flatnonzero(~plain)
        for i, ids in zip(odd.tolist(), self.direct(column.take(pa.array(odd)).to_pylist())):
            found[i], counts[i] = ids, len(ids)
        easy = np.flatnonzero(plain)
        ids, own = self.by_word(column.take(pa.array(easy)))
        for i, part in zip(easy.tolist(), np.split(ids, np.cumsum(own)[:-1]) if len(easy) else []):
            found[i], counts[i] = part, len(part)
        return np.concatenate(found) if found else np.zeros(0, "<u4"), counts

    def by_word(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(column):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if self.drops_blanks:
            parts = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        else:
            # So every word follows either a line feed or a blank.
            line, none = pa.scalar(self.head, pa.large_string()), pa.scalar("", pa.large_string())
            parts = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(line, column, none), "\n", " \n"), " ")
        offsets = np.asarray(parts.offsets).astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.words).to_numpy(zero_copy_only=False)
        new = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
        fresh = coded.dictionary.filter(pa.array(new))
        begins, lengths, pool = self.new_words(fresh)
        begins, lengths = np.append(self.begins, begins + len(self.pool)), np.append(self.lengths, lengths)
        pool = np.append(self.pool, pool)
        place = np.nan_to_num(place).astype(np.int64)
        place[new] = len(self.words) + np.arange(int(new.sum()))
        if len(self.words) < REMEMBERED:
            self.words = pa.concat_arrays([self.words, fresh])
            self.begins, self.lengths, self.pool = begins, lengths, pool
        if not self.drops_blanks:  # what stands before the first separator is no word
            begins, lengths = np.append(begins, 0), np.append(lengths, 0)
        at = place[np.asarray(coded.indices)]
        if not self.drops_blanks:
            at[offsets[:-1]] = len(lengths) - 1
        counts = lengths[at]
        begins = begins[at]
        if not self.drops_blanks and self.head == "\n":  # the line feed that was put before each text goes again
            begins[offsets[:-1] + 1] += 1
            counts[offsets[:-1] + 1] -= 1
        ends = np.cumsum(counts)
        ids = pool[np.repeat(begins - (ends - counts), counts) + np.arange(int(ends[-1]))]
        return ids, np.add.reduceat(counts, offsets[:-1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
