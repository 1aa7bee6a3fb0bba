"""Edit distances: against the table filled cell by cell, and long texts in time that no such table allows."""

import random
import time

from inkfield.functions.text import edit_distance
from inkfield.operators import textjobs as tj


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_against_the_table():
    draw = random.Random(7)
    for letters in ("a", "ab", "abcé", "ab\U0001f600漢"):
        for _ in range(500):
            a, b = ("".join(draw.choice(letters) for _ in range(draw.randint(0, 12))) for _ in range(2))
            assert edit_distance(a, b) == brute(a, b), (a, b)


def test_long_readings(spark):
    """Four readings of 60,000 characters: 12 billion cells of the table, over a minute when each is filled."""
    draw = random.Random(3)
    want = "".join(draw.choice("abcdefgh onè") for _ in range(60_000))
    less = "".join(c for n, c in enumerate(want) if n % 9)
    swapped = list(want)
    for n in range(50, 60_000, 500):
        swapped[n] = "Z"
    swapped = "".join(swapped)
    rows = spark.createDataFrame(
        [("less", less, want), ("swapped", swapped, want), ("same", want, want), ("both", "Y" + swapped[:-1], want), ("null", None, want)], "slice string, got string, want string")
    tj.character_error(rows.limit(1), ["slice"]).collect()
    started = time.perf_counter()
    got = {r.slice: (r.n, r.exact, r.errors) for r in tj.character_error(rows, ["slice"]).collect()}
    assert time.perf_counter() - started < 20
    assert got == {"less": (1, 0, 6_667), "swapped": (1, 0, 120), "same": (1, 1, 0), "both": (1, 0, 122), "null": (1, 0, None)}
