"""Small tables with every awkward row: nulls, empty and very long texts, repeats, clashing column names."""

from __future__ import annotations

import random

WORDS = "stone river quiet bright garden table window seven north paper cloud metal voice honest winter signal".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", ",", "."]) for _ in range(n))


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, chunk int, key string"


def odd_rows():
    long = prose(1, 8000) + " " + "x" * 40_000 + " \n\n  \t" + "é猫😀" * 300
    texts = [(0, prose(2, 40)), (1, None), (2, ""), (3, long), (4, prose(2, 40)), (4, prose(2, 40)), (None, prose(3, 30)), (5, "  \t\n "), (6, "one"), (7, "one two")]
    return [(i, t, None, "s", None, 0.5, "a", 1, None) for i, t in texts]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def documents(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
