"""Small documents with all the cases that every operator must take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, k bigint, __id int, slot string, words string"


def documents(spark, rows):
    """rows: (doc_id, text, source); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, 2, "s", None) for i, t, s in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def awkward():
    """Nulls, empty and blank texts, a long one, repeated rows, one id with two texts, null ids and sources."""
    long = prose(1, 30_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, "  \n\t\r\n ", "b"), (4, long, "a"), (5, prose(2, 80), None), (5, prose(2, 80), None),
        (6, prose(3, 60), "b"), (6, prose(4, 70), "b"), (None, prose(5, 90), "c"), (None, None, None), (7, "x" * 50_000, "c"),
        (8, "!?!", "a"), (9, "one", "a"), (10, "▁ ퟿ café \U0001f600 <b>", "b"),
    ]


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)
