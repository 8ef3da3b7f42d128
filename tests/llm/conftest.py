"""Small tables with everything that real ones have: nulls, empties, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

#: Further columns that a table may carry; the operators use such names inside.
CLASHES = "body long, whole string, me string, part long, row long, rep long, lines string, digest string, tails string, keyword string, n long, of long, component long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
EXTRA = (1, "w", "m", 2, 3, 4, "l", "d", "t", "k", 5, 6, 7)


def words(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, *EXTRA) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(5)
    base = words(r, 120)
    near = base[:60] + ["changed"] + base[61:]
    long = words(r, 30000, 5000)
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, " ".join(base), "en", "b"),  # an exact copy
        (4, " ".join(words(r, 80)), "en", None),
        (5, None, "en", "a"),
        (6, "", None, "b"),
        (7, " \n\t \n", "de", "b"),
        (8, "one two three", "en", "a"),
        (9, "one two three", "en", "a"),
        (10, " ".join(long), "en", "a"),
        (11, "x" * 200000, "en", "a"),
        (12, "Ünïcode ñandú 漢字     words", "es", "c"),
        (12, "Ünïcode ñandú 漢字     words", "es", "c"),  # a repeated row
        (13, "an identifier with two texts " + " ".join(base[:70]), "en", "a"),
        (13, "another text of the same identifier", "fr", "a"),
        (None, " ".join(base), "en", "a"),
        (None, None, None, None),
        (14, "line a\nline b\nline c\nline d\n" + " ".join(words(r, 9)), "en", "a"),
        (15, "other\nline a\nline b\nline c\nline e", "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 16)] + [(None, 1, 1), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
