import random

import pytest

SCHEMA = "doc_id bigint, text string, `count` string, row int, kept string, size bigint, shard int, spans string"


def _texts():
    rng = random.Random(5)
    words = ["alpha", "Bêta", "gamma,", "delta.", "ÉPSILON", "zeta", "ñu", "x" * 90, "it's", "we'll", "7", "漢字"]

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t", " "]) for _ in range(n))

    base = [prose(150) for _ in range(6)]
    out = [None, "", " ", "\n\n", "a", "a b", "A  b", "<|endoftext|>", "x <|endoftext|>y", "\0", "▁ ▁x", "  two", "two  "]
    for i in range(90):
        b, kind = rng.choice(base), i % 6
        at = rng.randrange(200)
        out.append(
            [b, b[:at] + "!" + b[at:], prose(30) + b[at : at + 320] + prose(20), prose(40), b.upper(), "ab" * rng.randrange(300)][kind]
        )
    out.append(prose(9000))
    return out


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; ids with gaps and nulls."""
    rows = [(None if i % 17 == 16 else 3 * i, text) for i, text in enumerate(_texts())]
    return rows + rows[:3] + rows[20:26]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same as a table, with columns whose names the operators use themselves."""
    rows = [(i, t, "c", 1, "k", 2, 3, None) for i, t in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def outcome():
    """Rows of a result as a sorted list of reprs, for comparison with a plain one."""

    def collect(df, *columns):
        return sorted(repr(tuple(r)) for r in df.select(*columns).collect())

    return collect
