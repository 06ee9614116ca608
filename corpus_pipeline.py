"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, near_dedup, packing, quality_classifier, substring_dedup
from plumbline.llm.common import Scratch, read_table

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling rejects.

    Null and empty texts score 0; a null id is an id like others; repeated rows stay or go
    together, as do ties at the last score kept; a very long text is judged as a whole; of an
    empty table nothing stays; other columns pass through.
    """
    return quality_classifier.resample(docs, read_table(spark, sf_dir, "labels")).filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, 0.8).

    Every row is a document of its own, whatever its id: of a group the row with the smallest
    id stays (of several the first read; null ids come last), so that of repeated rows one
    does. Rows without words, or with null text, all stay. A very long text is compared as a
    whole; an empty table stays empty; other columns, whatever their names, pass through.
    """
    id_col, scratch = "doc_id", Scratch(spark, "groups")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = scratch.store(docs.select(F.monotonically_increasing_id().alias("key"), row.alias("row")), "rows")
    texts = rows.select(F.col("key").alias("id"), F.col("row").getField(id_col).alias("own"), F.col("row").getField("text").alias("text"))
    found = near_dedup.groups(texts.select("id", "text"), 5, 80, scratch).select("id", F.coalesce("component", "id").alias("component"))
    ranked = texts.select("id", "own").join(found, "id")
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("own").isNull(), "own", "id")).getField("id").alias("key"))
    return rows.join(first.select("key"), "key", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of fifty words that a document with a smaller id has, too, out of the texts.

    A row of which nothing is left goes. A null id is the largest; rows with one id don't cut
    each other; null and empty texts stay as they are; a very long text is one row; an empty
    table stays empty; other columns pass through, and n_chars follows the text.
    """
    out = substring_dedup.dedup(docs, whole=True).texts()
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by tempered source weights; one drawn in several epochs has several rows.

    Documents without text are never drawn; a null source is a source; repeated rows are drawn
    each for itself; ties in the permutations are broken by id and size; an empty table draws
    nothing; other columns pass through.
    """
    return mixing.draw(docs, whole=True).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences: every id of every row, null text as the separator alone.

    Null and repeated ids are packed row by row; a very long text gives whole sequences and a
    rest; ties in score go to the first in the order; an empty table gives no pieces; other
    columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), window=1024)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: The hashed models, MinHash and BM25 are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.store(docs, name)
    return docs
