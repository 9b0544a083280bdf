import pytest
from pyspark.sql import types as T

#: A column of the operators' own names must not disturb them.
CLASH = ["size", "shard", "slot", "kept", "score", "n_words", "__id", "__text", "__key"]


@pytest.fixture
def make(spark):
    """rows of (doc_id, text, source, lang) as a table with clashing extra columns."""

    def build(rows, clash=True, partitions=3):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "source", "lang")], *[T.StructField(c, T.IntegerType()) for c in (CLASH if clash else [])]])
        data = [(*(list(r) + [None] * 4)[:4], *([7] * len(CLASH) if clash else [])) for r in rows]
        return spark.createDataFrame(data, schema).repartition(partitions)

    return build


#: Nulls in any column, empty, blank and long texts, repeated rows, ties.
ODD = [
    (5, "the cat sat on the mat and then it went home to sleep all day long", "a", "en"),
    (2, "the cat sat on the mat and then it went home to sleep all day long", "b", "en"),
    (2, "the cat sat on the mat and then it went home to sleep all day long", "b", "en"),
    (9, "The cat  sat on the mat and\tthen it went home to sleep all day long", None, None),
    (None, "the cat sat on the mat and then it went home to sleep all day long", "a", "en"),
    (None, None, None, None),
    (3, None, "a", "de"),
    (4, "", "a", "de"),
    (6, " \n\t ", "c", "de"),
    (7, "1234 !!", "c", None),
    (8, "le chat est ici " * 6000, "c", "fr"),
    (10, "é\u2003ü <|endoftext|> \U0001f600 x", "c", "fr"),
]
