"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.llm.decontaminate import without_matches
from rankmill.llm.line_dedup import dropped_lines, fresh, kept_text, with_bitmaps
from rankmill.llm.near_dedup import near_duplicates
from rankmill.llm.packing import pack
from rankmill.llm.toxicity import fit_on, without_toxic
from rankmill.session import cut_lineage
from rankmill.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    A null or empty text is scored as one without terms; rows that repeat an id are judged each, by their own text.
    """
    return without_toxic(docs, fit_on(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share leave every text; n_chars follows the text.

    A null text becomes the empty text. Rows without an id are documents of their own; rows that repeat an id count as one document.
    """
    dropped = fresh("_dropped", docs.columns)
    out = with_bitmaps(docs, dropped_lines(docs)).withColumn("text", kept_text(dropped=dropped))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8.

    The smallest id of a group stays; of rows that repeat it the one whose text has the smallest hash. Rows without an id, and
    documents without words, are groups of their own.
    """
    groups = near_duplicates(docs, words=5, percent=80)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = cut_lineage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    place = fresh("_place", docs.columns)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    firsts = left.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) <= 1)
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(firsts.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; a null or empty text holds none."""
    return without_matches(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as packed sequences, one row per piece; a null or empty text is its end token alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # a fitted classifier, near-duplicates, edit distance and a tokenizer: see the tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
