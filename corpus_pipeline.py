"""A corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of documents.

Defined results of all stages: a null text counts as empty (and is too short
for the quality rules); texts of any length are read whole; rows may repeat,
share an id or lack one; columns beyond those of documents are carried along
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, mixing, near_copies, packing, quality_rules
from strandlake.llm.common import SPACE_CHARS, id_in, materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality_rules.passing(docs)


def chosen(docs: DataFrame, digest: Column, winners: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``winners`` (digest, doc_id); ids compare null-safely."""
    keyed = docs.select("*", digest.alias("_digest"), id_in("doc_id").alias("_id"))
    keys = winners.select(F.col("digest").alias("_digest"), id_in("doc_id").alias("_id"))
    return keyed.join(keys, ["_digest", "_id"], "left_semi").dropDuplicates(["_digest", "_id"]).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, whatever its id.

    It is the one with the most code points, then the smallest id (a null id
    comes first); of repeated rows one stays.  An id that two different texts
    share stays with both.
    """
    rows = exact_dedup.exact_dedup(exact_dedup.digests(docs), exact_dedup.half_history())
    best = rows.filter("kept").groupBy("text_sha256", F.col("keep_id").alias("doc_id")).agg(F.max("n_points").alias("n"))
    text = F.coalesce("text", F.lit(""))
    digest = F.concat(F.sha2(F.translate(text, SPACE_CHARS, ""), 256), F.length(text).cast("string"))
    return chosen(docs, digest, best.select(F.concat("text_sha256", F.col("n").cast("string")).alias("digest"), "doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    It is the one with the smallest id (a null id comes first); of repeated
    rows one stays.  Texts of different groups that share an id are decided
    each on its own.
    """
    rows = near_copies.near_copies(docs)
    return chosen(docs, near_copies.node_of(), rows.select(F.col("keep_node").alias("digest"), F.col("keep_id").alias("doc_id")).distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]

#: SimHash fingerprints and token ids can't be expressed in SQL; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
