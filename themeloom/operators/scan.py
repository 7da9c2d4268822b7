"""Running values along time within a key, without putting a key into one task.

A plain window over ``partitionBy(key)`` sorts a whole key in one task. Here a key is cut into
time buckets; every bucket is reduced to one row, a window over those few rows gives what each
bucket inherits, and the window over rows runs within (key, bucket). The answer is the same.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def running(
    df: DataFrame,
    key: str,
    order: str,
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    last_known_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds running columns; ``order`` must be unique within a key.

    ``sums``: sum of the expression over this and all earlier rows. ``last_before``: its value
    on the row before, null included. ``last_known_before``: its last non-null value on any
    earlier row.
    """
    sums, before, known = dict(sums or {}), dict(last_before or {}), dict(last_known_before or {})
    inputs = {f"_in_{name}": expr for name, expr in {**sums, **before, **known}.items()}
    rows = df.withColumns({**inputs, "_bucket": bucket})

    at = F.col(order)
    parts = [F.sum(f"_in_{name}").alias(f"_b_{name}") for name in sums]
    parts += [F.max_by(F.struct(F.col(f"_in_{name}").alias("v")), at).alias(f"_b_{name}") for name in before]
    parts += [
        F.max_by(f"_in_{name}", F.when(F.col(f"_in_{name}").isNotNull(), at)).alias(f"_b_{name}")
        for name in known
    ]
    reduced = rows.groupBy(key, "_bucket").agg(*parts)

    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy(key).orderBy("_bucket")
    inherit = {f"_c_{name}": F.coalesce(F.sum(f"_b_{name}").over(earlier), F.lit(0)) for name in sums}
    inherit |= {f"_c_{name}": F.lag(f"_b_{name}").over(step)["v"] for name in before}
    inherit |= {f"_c_{name}": F.last(f"_b_{name}", ignorenulls=True).over(earlier) for name in known}
    carried = reduced.withColumns(inherit).drop(*[f"_b_{n}" for n in {**sums, **before, **known}])

    joined = rows.join(
        carried.withColumnsRenamed({key: "_key", "_bucket": "_kb"}),
        (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_bucket").eqNullSafe(F.col("_kb"))),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(inside) == 1
    out = {}
    for name in sums:
        out[name] = F.col(f"_c_{name}") + F.coalesce(F.sum(f"_in_{name}").over(upto), F.lit(0))
    for name in before:
        out[name] = F.when(first, F.col(f"_c_{name}")).otherwise(F.lag(f"_in_{name}").over(inside))
    for name in known:
        local = F.last(f"_in_{name}", ignorenulls=True).over(prior)
        out[name] = F.coalesce(local, F.col(f"_c_{name}"))
    names = [*inputs, "_bucket", "_key", "_kb", *[f"_c_{n}" for n in {**sums, **before, **known}]]
    return joined.withColumns(out).drop(*names)
