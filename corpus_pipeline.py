"""A training corpus from raw documents: five stages, each stored and read back before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.llm import decontaminate, line_dedup, ngram_join, quality
from themeloom.llm.queries import piece_digests
from themeloom.llm.tokens import free_names


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = quality.classify_quality(docs, _table(spark, sf_dir, "labels"))
    return judged.filter("judged.keep").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks are cut; documents of which nothing is left go. ``n_chars`` follows the text."""
    (removed,) = free_names(["_n_removed"], docs.columns)
    cut = line_dedup.line_dedup(docs, removed=removed)
    was_cut = F.col(removed) > 0
    kept = cut.filter(~was_cut | (F.length(F.trim("text")) > 0))
    kept = kept.withColumn("n_chars", F.when(was_cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: that of the smallest id, of its texts the one of the smallest digest.

    Rows are told apart by id and text, as ids may be null or repeat; of repeated rows one stays. Rows without an
    id come after all others. Rows without words are in no class and stay.
    """
    found = Workspace(spark, "near-copies").save(
        ngram_join.near_copies(docs).select("doc_id", "key", "class_key", "text_hash"), "classes"
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "text_hash")
    heads = found.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min(order).alias("head"))
    stay = heads.select("head.doc_id", "head.text_hash").unionByName(
        found.filter("class_key IS NULL").select("doc_id", "text_hash").distinct()
    )
    one, two = free_names(["_row_1", "_row_2"], docs.columns)

    def row_keys(df: DataFrame, text_hash) -> DataFrame:
        parts = (F.col("doc_id").isNull(), F.col("doc_id"), text_hash)
        return df.withColumns({one: F.xxhash64(F.lit(1), *parts), two: F.xxhash64(F.lit(2), *parts)})

    # Both steps deal the rows by the same two keys, so texts move once.
    named = row_keys(stay, F.col("text_hash")).select(one, two).hint("shuffle_hash")
    kept = row_keys(docs, F.xxhash64("text")).join(named, [one, two], "left_semi")
    return kept.dropDuplicates([one, two]).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests."""
    return piece_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

ORACLE_SQL = None  # no stage can be said in SQL; tests hold it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "corpus-pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
