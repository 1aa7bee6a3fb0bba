"""Small tables for the tests of this folder."""

from __future__ import annotations

import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Rows of (doc_id, text) with further columns whose names operators use inside."""
    full = [(i, t, "en", "s", "clash", -1, True, 5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, digest string, row long, kept boolean, n long")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def passage(seed, n):
    """n words that repeat only by chance, made from a number."""
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append("w" + format(state >> 7, "x"))
    return out


ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One"), (5, "One"), (None, "null id"), (6, "é x 😀\n😀"),
    (7, " ".join(passage(1, 3000))), (8, "a\nb"), (9, " lead"), (10, "trail "), (11, "a  b   c\n\nd"), (12, "İΣ don't it's <|endoftext|>"), (13, "\x1ca \x0bb"),
]
