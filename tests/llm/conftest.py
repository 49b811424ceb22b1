from __future__ import annotations

import pytest
from pyspark.sql import types as T
from sample_texts import words

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text[, source])."""
    def build(rows):
        return spark.createDataFrame(
            [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    return build


@pytest.fixture(scope="session")
def odd(frame, spark):
    """Nulls, blanks, a very long text, copies, near copies, repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    base = words(1, 400)
    rows = [
        (1, base, "a"), (2, base, None), (3, base.replace("taner", "xx", 1) + " tail", "b"), (4, None, "b"), (5, "", None),
        (6, " \n\t ", "c"), (7, "one", "c"), (8, words(8, 40_000), "a"), (9, words(9, 60), "a"), (9, words(9, 60), "a"),
        (None, words(11, 80), "a"), (None, None, None), (12, "\x00 ﬁ ▁ <|endoftext|> \U0001F600", "b"),
        (13, "aaaa " * 500, "b"), (14, words(1, 200) + words(14, 200), "z")]
    clashing = ("kept", "n_words", "size", "data", "number", "bands", "start", "key", "component", "place", "shard", "vote_length", "node")
    return frame(rows).withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])
