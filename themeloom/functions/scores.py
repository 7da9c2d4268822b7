"""Softmax and ranking on packed per-row label arrays: no shuffle per premise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.binding import bind


def softmax(logits: Column) -> Column:
    """Softmax of an ``ARRAY<DOUBLE>``; the shift and the sum are bound once."""
    def scale(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
        return bind(total, lambda t: F.transform(e, lambda x: x / t))

    def exps(values: Column) -> Column:
        return bind(F.array_max(values), lambda m: F.transform(values, lambda x: F.exp(x - m)))

    return bind(bind(logits, exps), scale)


def rank_scores(scores: Column, labels: Sequence[str]) -> Column:
    """``struct(labels, scores)`` by falling score; equal scores keep the request order."""
    order = F.transform(
        scores,
        lambda s, i: F.struct((-s).alias("key"), i.alias("ord"), s.alias("score")),
    )
    names = F.array(*[F.lit(x) for x in labels])
    return bind(
        F.array_sort(order),
        lambda ranked: F.struct(
            F.transform(ranked, lambda r: F.element_at(names, r["ord"] + 1)).alias("labels"),
            F.transform(ranked, lambda r: r["score"]).alias("scores"),
        ),
    )
