"""One row per id, and the null-aware difference of two variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_by_id(
    df: DataFrame, id_col: str = "id", order_by: Sequence[Column | str] | None = None
) -> DataFrame:
    """Keeps one row per id (all null ids count as one); a frame without ids is unchanged.

    The ``rank = 1`` filter becomes a partial and a final group limit, so copies are dropped
    before the shuffle and an id holding a large share of all rows stays cheap. Without
    ``order_by`` the copy with the smallest hash of its other columns wins, which is stable
    across runs and partitionings.
    """
    if id_col not in df.columns:
        return df
    if order_by is None:
        rest = [c for c in df.columns if c != id_col]
        order_by = [F.xxhash64(*rest)] if rest else [F.col(id_col)]
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(*order_by))
    return df.withColumn("_copy", rank).filter("_copy = 1").drop("_copy")


def fallback_minus_primary(
    fallback: DataFrame, primary: DataFrame, id_col: str = "id"
) -> DataFrame:
    """Rows of ``fallback`` whose id is ``NOT IN`` the ids of ``primary``, one per id.

    SQL null rules hold: one null id in ``primary`` empties the result, and a null id in
    ``fallback`` survives only an empty ``primary``. Spark plans a literal ``NOT IN`` as a
    broadcast of the whole primary side, so the same rule is written as an equi anti join plus
    two scalar subqueries. Both sides are unique on the key before they meet, so no key is hot.
    """
    keys = primary.select(F.col(id_col).cast("string").alias("_key"))
    n_all = keys.agg(F.count("*")).scalar()
    n_null = keys.agg(F.count_if(F.col("_key").isNull())).scalar()
    left = dedup_by_id(fallback, id_col)
    unmatched = left.join(
        keys.filter(F.col("_key").isNotNull()).distinct(),
        left[id_col].cast("string") == F.col("_key"),
        "left_anti",
    )
    return unmatched.filter((n_all == 0) | ((n_null == 0) & F.col(id_col).isNotNull()))
