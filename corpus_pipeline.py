"""A corpus pipeline of five stages; each takes documents and hands on what it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlens.llm.common import saved, table
from leadlens.llm.minhash import near_duplicates, text_rank
from leadlens.llm.packing import best_fit_pack
from leadlens.llm.pii import mask_spans
from leadlens.llm.queries import vocabulary
from leadlens.llm.suffix import without_repeats
from leadlens.llm.toxicity import drop_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic; the model is fitted on the labelled documents of the table.

    A null text is scored like an empty one and stays null; texts are scored whole; rows that repeat are scored alike; rows
    without an id are scored, too; other columns stay whatever their names; no documents give none.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the one with the least id; rows without an id stay.

    Rows that repeat an id are one document: the row with the least text_rank stays, of equal texts any.
    """
    kept = saved(near_duplicates(docs, words=5, similarity=0.8).where("kept").select("doc_id"))
    rows = docs.join(kept, "doc_id", "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(text_rank()))
        rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), first.alias("first")).where("first = 1").select("row.*")
    return rows.unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that an earlier one has in a passage of at least 50.

    Null texts and rows without an id stay as they are; texts are of any length; rows that repeat an id don't repeat each
    other; other columns stay whatever their names; no documents give none.
    """
    return _counted(without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the kind in brackets.

    Null texts stay null and empty ones empty; texts are of any length; rows that repeat are treated alike; other columns
    stay whatever their names; no documents give none.
    """
    return _counted(mask_spans(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences of 4096.

    A null or empty text is one piece of the end id; texts are of any length; rows that repeat, or have no id, are documents
    of their own; which of equally long pieces goes first isn't fixed; no documents give no pieces.
    """
    return best_fit_pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Learned scores and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
