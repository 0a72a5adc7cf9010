"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm.decontaminate import decontaminate
from barframe.llm.line_dedup import dedup_lines
from barframe.llm.ngram_join import jaccard_components
from barframe.llm.packing import pack_documents
from barframe.llm.quality import fit_quality, score_quality
from barframe.llm.shared import read_table, written

#: Documents below this score go.  Lower than where the classifier calls a document good: a
#: filtering stage keeps what it isn't sure of.
REJECT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (the model is fitted on all documents' labels)."""
    model = fit_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, into="__score")
    return scored.filter(F.col("__score") >= REJECT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of smaller id holds; ``n_chars`` follows the text."""
    kept = dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group (five words, similarity of 0.8 or more)."""
    found = jaccard_components(docs, 5, 80, 100)
    gone = found.filter(F.col("component") != F.col("doc")).select(F.col("doc").alias("__doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__doc"], "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, packed into sequences."""
    pieces = pack_documents(docs)
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("packing", packing)]

#: The classifier, the alignment and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
