import random

import pytest

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, matches int, block int, n_lines string, part string"


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "Meadow", "walked", "slowly", "under", "bridge.", "été", "naïve", "straße"]
    return " ".join(r.choice(words) + r.choice(["", "", "s", "ed", str(r.randrange(40))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in all columns, empty and very long texts, ties, repeated rows, clashing names."""
    base = prose(1, 120)
    rows = [(1, base), (2, base), (3, base.translate({c: c - 32 for c in range(97, 123)})), (4, None), (5, ""), (6, " \t\n \n"), (7, prose(2, 60_000)), (7, prose(3, 40)), (8, "one"),
            (9, "one two"), (10, "x" * 200_000), (11, prose(4, 30) + "\n" + "A line that several documents share, indeed."),
            (12, "a line that several documents share, indeed.  \n" + prose(5, 30)), (13, "\tA line that several documents SHARE, indeed.\n\n"),
            (None, prose(6, 20)), (None, None), (1, base), (14, "中文 ▁ 🤖 \x00 <s> <0x0A>")]
    return [(i, t, None if i == 2 else "en", None, None if t is None else len(t), "s", 1, 2, "x", None) for i, t in rows]


#: Names that operators use inside.
INNER = ["_text", "_lines", "_id", "_row", "_dropped", "_key", "_row0", "_row1", "_found", "_given", "_raw", "_new", "_parts", "_pos", "_h0", "id", "size", "first",
         "component", "held_out_", "label", "slots", "key", "seq", "tree", "pos", "leaf", "more", "grp", "uid", "_gone", "_d", "kept", "line", "u", "v", "n", "c", "k", "b"]


def with_inner_names(df):
    return df.selectExpr("*", *[f"{i} AS `{name}`" for i, name in enumerate(INNER)])


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return with_inner_names(spark.createDataFrame(odd_rows, ODD))


@pytest.fixture(scope="session")
def none(spark):
    return with_inner_names(spark.createDataFrame([], ODD))
