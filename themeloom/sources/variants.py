"""Readers of ``variant=<name>`` parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.vectors import embedding_columns, pack_embedding
from themeloom.operators.dedup import dedup_by_id

TEXT_COLUMNS = ("title_clean", "abstract_clean")  # fixed values: text column names


def variant_path(root: str, variant: str) -> str:
    return f"{root.rstrip('/')}/variant={variant}"


def read_variant(spark: SparkSession, root: str, variant: str) -> DataFrame:
    """All parquet files below the variant folder; nested partition folders add no columns."""
    return spark.read.option("recursiveFileLookup", "true").parquet(variant_path(root, variant))


def _with_id(df: DataFrame) -> list:
    return [F.col("id").cast("string").alias("id")] if "id" in df.columns else []


def _require_rows(df: DataFrame, where: str) -> DataFrame:
    if df.isEmpty():
        raise FileNotFoundError(f"no rows at {where}")
    return df


def _vectors(df: DataFrame, where: str) -> list[str]:
    wide = embedding_columns(df.columns)
    if wide:
        return wide
    if "embedding" in df.columns:
        return ["embedding"]
    raise ValueError(f"no embedding columns (V<int>) found at {where}")


def _packed(df: DataFrame) -> DataFrame:
    return df if "embedding" in df.columns else pack_embedding(df)


def read_embeddings_only(spark: SparkSession, root: str, variant: str) -> DataFrame:
    """``(id, embedding)``, one row per id; the scan reads no text columns."""
    where = variant_path(root, variant)
    raw = read_variant(spark, root, variant)
    narrow = raw.select(*_with_id(raw), *_vectors(raw, where))
    return dedup_by_id(_packed(_require_rows(narrow, where)))


def read_text_only(spark: SparkSession, root: str, variant: str) -> DataFrame:
    """``(id, title_clean, abstract_clean)``, one row per id; the scan reads no vectors."""
    raw = read_variant(spark, root, variant)
    return dedup_by_id(raw.select(F.col("id").cast("string").alias("id"), *TEXT_COLUMNS))


def read_full_variant(spark: SparkSession, root: str, variant: str) -> DataFrame:
    """Id, whatever text columns exist, and the embedding; one row per id."""
    where = variant_path(root, variant)
    raw = read_variant(spark, root, variant)
    text = [c for c in TEXT_COLUMNS if c in raw.columns]
    wide = raw.select(*_with_id(raw), *text, *_vectors(raw, where))
    return dedup_by_id(_packed(_require_rows(wide, where)))
