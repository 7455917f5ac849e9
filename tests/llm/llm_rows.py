"""A small table of every odd case, shared by the tests here."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that the operators use for columns of their own.
        *[T.StructField(c, T.LongType()) for c in ("row", "_measures", "_hits", "draw", "size", "anchor", "n", "id", "rest", "hits")],
    ]
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and stone river light seven moon grass").strip() if rng.random() < 0.3
                    else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


#: (doc_id, text, lang, source): nulls, empty and very long texts, repeated rows, ties.
EDGES = [
    (0, None, "en", "b"), (1, "", "en", None), (2, " \n\t ", None, "a"), (3, "one", "en", "a"),
    (4, prose(1, 30_000), "en", "b"), (5, "a b c d " * 300, "de", "a"), (6, prose(2, 120), "en", "a"),
    (6, prose(2, 120), "en", "a"), (7, prose(2, 120), "en", "ä"), (8, prose(3, 90) + ".\n" + prose(4, 60) + ".", "de", "c"),
    (None, prose(5, 70), "en", "c"), (9, "1 2 3 4 5 6 7 8", None, None), (10, "x" * 50_000, "de", "b"),
    (11, prose(2, 119) + " changed", "en", "c"), (12, "日本 \U0001f600 é\u00a0ß \x1f z", "de", "c"),
]
