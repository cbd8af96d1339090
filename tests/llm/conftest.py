import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def upper(text):
    """A-Z only, as the word rules lower them."""
    return "".join(c.upper() if c.isascii() else c for c in text)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(3)
    syll = "an er th on re in ou ti the and of éa ßu çi".split()
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))

    def text(n):
        out = []
        while n > 0:
            k = min(n, rng.randint(4, 14))
            out.append(" ".join(word() for _ in range(k)).capitalize() + rng.choice([".", "!", ".\n"]))
            n -= k
        return " ".join(out)

    return text


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Nulls, empties, blanks, a very long text, ties, repeated rows, one id with different texts, and column names that the operators use."""
    base, long = prose(80), prose(40_000)
    rows = [(1, base, "a"), (2, base, "b"), (2, base, "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", "a"), (6, long, "a"), (7, prose(60) + " " + base, None),
            (8, "one", "c"), (None, base, "a"), (9, None, None), (10, "x" * 5000, "a"), (11, upper(base), "d"), (12, "日本語 " * 60, "b"), (13, prose(70), "a"), (13, "short", "a"), (13, prose(50) + " " + base, "b")]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    for c in ("h", "fp", "id", "copies", "label", "hash", "at", "kept", "size", "quality_score", "_quality_score", "copy", "_mix_id", "_mix_size", "_mix_copies", "mix_id", "mix_size", "mix_copies", "cut_id", "cut_text", "_cut_id",
              "_cut_text", "is_main", "main", "odd_id", "odd_hash", "text_hash", "component_id", "h1", "runs", "rank", "again", "row", "turn", "_turn", "_size"):
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
