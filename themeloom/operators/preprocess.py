"""Centring, PCA whitening and the rule that applies either to new vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.vectors import as_double, list_array, matrix

SEED = 13  # fixed value


def _vector(name: str = "embedding"):
    return array_to_vector(as_double(F.col(name)))


def mean_vector(df: DataFrame, name: str = "embedding") -> DataFrame:
    """One row ``(mean ARRAY<DOUBLE>)``; a single partial and final aggregation."""
    return df.agg(vector_to_array(Summarizer.mean(_vector(name))).alias("mean"))


def center(df: DataFrame, mean: list[float], name: str = "embedding") -> DataFrame:
    """Subtracts a mean vector, the corpus's own or one kept for later rows."""
    values = F.array(*[F.lit(float(x)) for x in mean])
    shifted = F.zip_with(as_double(F.col(name)), values, lambda x, m: x - m)
    return df.withColumn(name, shifted)


def sample_rows(
    df: DataFrame, n: int, seed: int = SEED, id_col: str = "id", n_rows: int | None = None
) -> DataFrame:
    """``min(n, rows)`` rows without replacement, the same ones on every run; ids are unique.

    The rows with the ``n`` smallest id hashes. Only ids and hashes are ranked, and of these only
    a share slightly above ``n``; the rows themselves are then filtered where they are, without a
    shuffle. ``n_rows`` is the size of ``df`` or an upper bound of it, where that is known.
    """
    n_rows = df.count() if n_rows is None else n_rows
    if n >= n_rows:
        return df
    place = F.struct(F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.col(id_col).alias("i"))
    share = (n + 6 * math.sqrt(n) + 10) / n_rows
    ranks = df.select(place.alias("p"))
    edge = min(2**63 - 1, int(-(2**63) + min(share, 1.0) * 2**64))
    likely = ranks.filter(F.col("p.h") <= F.lit(edge).cast("long"))
    for pool in (likely, ranks):  # the whole pool only if the share fell short of n
        last = pool.orderBy("p").limit(n).agg(F.count("*").alias("k"), F.max("p").alias("p")).first()
        if last["k"] == n:
            break
    if last["p"] is None:
        return df.limit(0)
    end = F.struct(F.lit(last["p"]["h"]).cast("long").alias("h"), F.lit(last["p"]["i"]).alias("i"))
    return df.filter(place <= end)


@dataclass
class PcaModel:
    """Linear map ``(x - mean) @ loadings / scale``; its size is (components x dimensions)."""

    mean: list[float]
    loadings: list[list[float]]  # dimensions x components
    scale: list[float]
    explained: list[float]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per component, for storage."""
        columns = np.array(self.loadings).T.tolist()
        rows = [
            (i, columns[i], self.mean, float(self.scale[i]), float(self.explained[i]))
            for i in range(len(columns))
        ]
        schema = "component int, loadings array<double>, mean array<double>, scale double, explained double"
        return spark.createDataFrame(rows, schema)

    @classmethod
    def from_table(cls, table: DataFrame) -> PcaModel:
        rows = table.orderBy("component").collect()
        loadings = np.array([r["loadings"] for r in rows]).T.tolist()
        return cls(
            list(rows[0]["mean"]), loadings,
            [r["scale"] for r in rows], [r["explained"] for r in rows],
        )


def fit_pca(
    df: DataFrame,
    k: int,
    whiten: bool = True,
    sample: int | None = None,
    seed: int = SEED,
    id_col: str = "id",
) -> PcaModel:
    """Principal components of all rows, or of a hash sample of ``sample`` rows if one is asked for.

    Two passes: the mean with the variance, then the d x d covariance of the centred rows, each a
    partial and a final aggregation. With ``whiten`` every component has unit variance, so that
    the first one cannot dominate distances. The sign of a component is free; it is chosen so that
    its entry of the largest size, the first of those within 1e-9 of it, is positive. Components
    without variance, beyond the rank of the rows, are zero.
    """
    rows = df if sample is None else sample_rows(df, sample, seed, id_col)
    summary = rows.agg(
        Summarizer.metrics("mean", "variance").summary(_vector()).alias("s")
    ).select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")).first()
    mean = [float(x) for x in summary["mean"]]
    centred = center(rows, mean).select(_vector().alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(centred)
    explained = np.array(model.explainedVariance.toArray())
    total = float(np.sum(summary["variance"]))
    variance = explained * total
    loadings = model.pc.toArray()
    size = np.abs(loadings)
    lead = (size >= size.max(axis=0) - 1e-9).argmax(axis=0)
    loadings = loadings * np.where(loadings[lead, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    loadings[:, variance <= 1e-12 * max(total, 1e-300)] = 0.0
    scale = np.sqrt(np.maximum(variance, 1e-24)) if whiten else np.ones(k)
    return PcaModel(mean, loadings.tolist(), scale.tolist(), explained.tolist())


def explained_variance(model: PcaModel) -> float:
    return float(sum(model.explained))


def apply_pca(df: DataFrame, model: PcaModel, name: str = "embedding") -> DataFrame:
    mean = np.array(model.mean)
    projection = np.array(model.loadings) / np.array(model.scale)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = (matrix(batch.column(name)) - mean) @ projection
                at = batch.schema.get_field_index(name)
                yield batch.set_column(at, name, list_array(scores))

    typed = df.withColumn(name, as_double(F.col(name)))
    return typed.mapInArrow(project, typed.schema)


def apply_preprocessing(
    df: DataFrame, mean: list[float] | None = None, pca: PcaModel | None = None
) -> DataFrame:
    """PCA when one is fitted, else centring when a mean is kept, else the rows as they are."""
    if pca is not None:
        return apply_pca(df, pca)
    if mean is not None:
        return center(df, mean)
    return df
