"""Awkward documents that every operator must take, and small corpora."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, score double, node long, key string, _id long, _gone boolean, _found string, _c1 int, kept string"


def frame(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names clash with the operators' own."""
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng=None):
    rng = rng or random.Random(5)
    long_text = words(rng, 30_000)
    tied = words(rng, 80)
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 4),
        (4, long_text, "en", "b", len(long_text)),
        (5, tied, "en", "b", None),
        (6, tied, None, "b", 1),
        (6, tied, None, "b", 1),
        (7, "short one", "de", "", 9),
        (8, "ünïcödé ▁ 日本語 🙂 \u0000 token = \"0123456789abcdef0123456789abcdef01234567\"", "de", "c", 5),
        (None, "no id at all", "de", "c", 5),
    ]


def empty(spark):
    return frame(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
