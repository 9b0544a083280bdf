"""From raw documents to token files: language, near-duplicates, benchmark passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the columns of
`documents`, as they are, whatever their names. The result is what the token files say of each document; the stages have no
common SQL, so tests compare them with brute force. An empty table of documents gives empty results in every stage. Before each
stage the executors' JVMs return the heap that the one before needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontam, langid, minhash, mixing, token_output
from seqloom.llm.common import give_back, remove, scratch_folder, shielded, small_batches, table

#: A document stays if its language is certain to at least this degree.
LEAST_CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those whose language stays open.

    Repeated rows and ties are judged alike, by the text only. If no row has a language to learn from, all languages stay open.
    """

    give_back(spark)
    small_batches(spark)  # the stage's rows are read after it has returned

    def certain(rows: DataFrame) -> DataFrame:
        found = langid.identify(rows, langid.train(docs))
        return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN))

    return shielded(docs, ("text",), certain)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 of five-word shingles.

    The smallest id stays, null last, then the smallest hash of id and text; of rows that agree in both one stays. Documents without
    words (null and blank texts) are linked with nothing and stay.
    """
    give_back(spark)
    return minhash.one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text holds a benchmark item; null and empty texts hold none. Repeated rows are judged alike.

    An empty benchmark drops nothing.
    """
    give_back(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), words=5, at_least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, 2 times at most; null sources are one source.

    Rows that agree in id and text are counted one by one. Sources without words (null and empty texts only) give nothing.
    """
    give_back(spark)
    return shielded(docs, ("doc_id", "text", "source"), lambda rows: mixing.emit(mixing.mix(rows)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, null first; per document what they hold.

    Repeated rows are repeated in the files. A null or empty text is an end id alone.
    """
    give_back(spark)
    return token_output.token_digest(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the scratch folder and read again. The folder goes in the end, after errors too."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)  # complete when it returns
    finally:
        remove(spark, folder)
