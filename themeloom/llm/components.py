"""Connected components of a table of links, by local stars, then by alternating stars.

First, tasks replace slices of at most ``SLICE`` links by stars around the smallest node of what is linked in a slice,
in two passes: where the links are made, and over what is left, dealt by its size. If that is one slice, it is done.
Else rounds follow until every component is one star. Each round links the larger neighbours of a node to its smallest one, then does the same from the
smaller side. A node with very many neighbours is never gathered: its
smallest neighbour comes from a partial aggregation and goes back by a join that adaptive
execution can split. Each round is stored under the shared folder.

Defined results: links of a node to itself and links with a null end are ignored, repeated links
count once, an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace

SLICE = 1 << 18  # links that a task holds at once


def _local_stars(links: pd.DataFrame) -> pd.DataFrame:
    """The same components as (node, smallest node) of what these links hold."""
    names, code = np.unique(np.concatenate([links["a"].to_numpy(), links["b"].to_numpy()]), return_inverse=True)
    a, b = code[: len(links)], code[len(links) :]
    root = np.arange(len(names))
    while True:
        one, two = root[a], root[b]
        if (one == two).all():
            break
        lower = np.minimum(one, two)
        np.minimum.at(root, one, lower)
        np.minimum.at(root, two, lower)
        while ((above := root[root]) != root).any():
            root = above
    child = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[child], "b": names[root[child]]})


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= SLICE:
            yield _local_stars(pd.concat(held))
            held, rows = [], 0
    if rows:
        yield _local_stars(pd.concat(held))


def _settled(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones."""
    upper = links.select(F.col("a").alias("node"), "b", F.lit(False).alias("root"))
    lower = links.select(F.col("b").alias("node"), F.lit(None).cast(links.schema["b"].dataType).alias("b"), F.lit(True).alias("root"))
    ends = upper.unionByName(lower).groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("root").alias("root"))
    return ends.filter("low <> high OR (low IS NOT NULL AND root)").count() == 0


def _star(links: DataFrame, smaller_side: bool) -> DataFrame:
    """``links`` are (a, b) with a > b."""
    if smaller_side:
        near = links
        lowest = links.groupBy("a").agg(F.min("b").alias("m"))
    else:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(lowest, "a")
    if smaller_side:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b"))
        )
    else:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct()


def components(links: DataFrame, a: str, b: str, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    ordered = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    state = work.rotate(ordered.mapInPandas(_slices, ordered.schema), name)
    slices = max(1, math.ceil(state.count() / SLICE))
    state = work.rotate(state.coalesce(slices).mapInPandas(_slices, ordered.schema), name)
    while slices > 1 and not _settled(state):
        state = work.rotate(_star(_star(state.distinct(), False), True), name)
    state = state.distinct()  # slices may give the same link
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
