"""Text clean-up as column expressions; NFKC, which Spark lacks, and edit distances are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, StringType

from inkfield.functions.arrays import bind

# Fixed values the results depend on.
ASCII_VISIBLE = "".join(chr(c) for c in range(0x21, 0x7F))
FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
# White space of any script; the engine's own \s is ASCII only.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANK = f"[{BLANKS}]"
BLANK_SIGNS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
LOOSE_DROPPED = re.compile("[.．…・♪❤♥♡" + re.escape(BLANK_SIGNS) + "]+")
REPLY_LABEL = f"(?i)^{BLANK}*(?:english|translation|translated(?:{BLANK}+text)?|answer|output){BLANK}*[:：-]{BLANK}*"
QUOTE_PAIRS = [('"', '"'), ("'", "'"), ("「", "」"), ("『", "』"), ("“", "”"), ("‘", "’")]
SOURCE_NAMES = {"ja": ("Japanese", "romaji"), "zh": ("Chinese", "pinyin"), "ko": ("Korean", "romanization")}
TARGET_NAMES = {"en": "English", "id": "Indonesian"}
SINGLE_PROMPT = (
    "You are a manga translator. Translate the %1$s line the user gives you into natural %3$s. "
    "Reply with the %3$s translation only: no notes, no %2$s, no quotation marks, no explanation. "
    "Keep it short and in the register a character would actually speak. "
    "If the line is only sound effects or punctuation, reply with the closest %3$s equivalent."
)
BATCH_PROMPT = (
    " The user will give you several numbered lines from one page. "
    "Reply with one numbered line per input line, in the same order, "
    'formatted exactly as "1. translation" with nothing else. '
    "Keep every number, even if a line is only a sound effect."
)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK_SIGNS))


def post_process(text: Column) -> Column:
    """White space removed, ellipses as dots, dot runs unified, visible ASCII made full width."""
    dense = F.replace(F.regexp_replace(text, f"{BLANK}+", ""), F.lit("…"), F.lit("..."))
    dotted = F.regexp_replace(dense, r"(?<=[・.])・|・(?=[・.])", ".")
    return F.translate(dotted, ASCII_VISIBLE, FULL_WIDTH)


def edit_distance(a: str, b: str) -> int:
    """Characters put in, left out or replaced; 0 for equal texts alone.

    A text that is the other without some characters needs those alone. Else what
    both begin and end with is left out, and a column of the table is two whole
    numbers, the bits of its steps up and down (Myers 1999, Hyyro 2003).
    """
    if a == b:
        return 0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    rest = iter(b)
    if all(c in rest for c in a):
        return len(b) - len(a)
    head = next(n for n, c in enumerate(a) if c != b[n])
    tail = next(n for n in range(len(a) - head + 1) if n == len(a) - head or a[-1 - n] != b[-1 - n])
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[str, int] = {}
    for n, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << n
    every, last, distance = (1 << len(a)) - 1, max(len(a) - 1, 0), len(a)
    up, down = every, 0
    for c in b:
        same = places.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | ((level | up) & every ^ every), level & up
        distance += (more >> last & 1) - (less >> last & 1)
        more, less = more << 1 | 1, less << 1
        up, down = (less | (level | more) & every ^ every) & every, more & level & every
    return distance


@F.pandas_udf(IntegerType())
def edits(one: pd.Series, other: pd.Series) -> pd.Series:
    """``edit_distance`` row by row; null if either is."""
    found = [None if a is None or b is None else edit_distance(a, b) for a, b in zip(one, other)]
    return pd.Series(found, dtype="Int32")


@F.pandas_udf(StringType())
def loose(texts: pd.Series) -> pd.Series:
    """Text for a forgiving comparison: widths folded, then dots, hearts, notes and spaces dropped."""
    return texts.map(lambda t: None if t is None else LOOSE_DROPPED.sub("", unicodedata.normalize("NFKC", t)))


def clean_reply(text: Column) -> Column:
    """First non-empty line without one leading label and one pair of wrapping quotes."""

    def unquoted(bare: Column) -> Column:
        pairs = [bare.startswith(opening) & bare.endswith(closing) for opening, closing in QUOTE_PAIRS]
        wrapped = (F.length(bare) > 2) & reduce(lambda a, b: a | b, pairs)
        return F.when(wrapped, trimmed(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)

    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda line: line != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    return trimmed(bind(trimmed(F.regexp_replace(first, REPLY_LABEL, "")), unquoted))


def system_prompt(source: Column, target: Column, batch: Column) -> Column:
    """Instructions for one line, or for a numbered batch."""

    def pick(column: Column, names: dict[str, str]) -> Column:
        table = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
        return F.element_at(table, column)

    name = pick(source, {k: v[0] for k, v in SOURCE_NAMES.items()})
    romanised = pick(source, {k: v[1] for k, v in SOURCE_NAMES.items()})
    single = F.format_string(SINGLE_PROMPT, name, romanised, pick(target, TARGET_NAMES))
    return F.when(batch, F.concat(single, F.lit(BATCH_PROMPT))).otherwise(single)
