"""The tree of clusters as tables against the same work on arrays."""

import numpy as np
import pytest

from tests.brute import dendrogram, select_clusters
from themeloom.lineage import Workspace
from themeloom.operators.hierarchy import build_tree, choose_clusters, climb, climb_arrays


def random_tree(rng, n, kind):
    """Merges (w, a, b) that join n births: at random, as a chain, as a star, or with equal distances."""
    a = np.arange(1, n)
    b = {"chain": a - 1, "star": np.zeros(n - 1, int)}.get(kind, (rng.random(n - 1) * a).astype(int))
    w = np.sort(rng.random(n - 1)) if kind == "star" else rng.random(n - 1)
    w = np.round(w * 4) / 4 if kind == "ties" else w
    return [(float(x), int(min(p, q)), int(max(p, q))) for x, p, q in zip(w, a, b)]


@pytest.mark.parametrize("kind,n,limit", [("random", 40, 1 << 20), ("random", 6, 1), ("chain", 30, 12), ("star", 25, 13), ("ties", 20, 9), ("random", 1, 5)])
def test_tree_tables(spark, kind, n, limit):
    rng = np.random.default_rng(n * 7 + limit % 11)
    merges = random_tree(rng, n, kind)
    names = [f"b{i:03d}" for i in range(n)]
    work = Workspace(spark, "test-tree")
    births = spark.createDataFrame([(x,) for x in rng.permutation(names).tolist()], "basin string")
    rows = spark.createDataFrame([(w, names[a], names[b]) for w, a, b in merges], "w double, a string, b string")
    tree, numbers, n_births, n_merges = build_tree(births, rows, work, limit)
    assert (n_births, n_merges) == (n, n - 1) and {r.basin: r.cluster for r in numbers.collect()} == {x: i for i, x in enumerate(names)}
    parent, top = dendrogram(list(range(n)), merges)
    got = {r.cluster: (r.parent, r.top) for r in tree.collect()}
    assert got == {i: (None if p < 0 else p, t) for i, (p, t) in enumerate(zip(parent.tolist(), top.tolist()))}

    total = 2 * n - 1
    size = rng.integers(0, 5, total).astype(float)
    size[:n] += 1
    density = np.where(size > 0, size * rng.uniform(1, 6, total), 0.0)
    peak = np.where(size > 0, rng.uniform(1, 8, total), 0.0)
    first = [f"p{rng.integers(1e6):06d}" if s else None for s in size]
    direct = spark.createDataFrame([(i, float(size[i]), float(density[i]), float(peak[i]), first[i]) for i in range(total) if size[i]], "cluster long, size double, mass double, peak double, first string")
    chosen = {r.cluster: (r.topic_id, r.max_lambda) for r in choose_clusters(tree, direct, n, n - 1, work, limit).collect()}
    label, max_lambda = select_clusters(parent, top, size, density, peak, first)
    assert chosen == {i: (int(x), pytest.approx(y)) for i, (x, y) in enumerate(zip(label, max_lambda))}

    start = rng.integers(0, total, 60)
    far = rng.uniform(0, 1.2, 60)
    asked = spark.createDataFrame([(i, int(c), float(d)) for i, (c, d) in enumerate(zip(start, far))] + [(99, -1, 0.5)], "i int, cluster long, d double")
    expected = dict(enumerate(climb_arrays(start, far, parent, top).tolist()))
    for most in (1 << 20, 0):
        found = climb(asked, "d", tree, work, most)
        assert found.columns == asked.columns and {r.i: r.cluster for r in found.collect()} == {**expected, 99: -1}


def test_no_births(spark):
    work = Workspace(spark, "test-tree")
    tree, _, n, m = build_tree(spark.createDataFrame([], "basin long"), spark.createDataFrame([], "w double, a long, b long"), work)
    assert (n, m, tree.count()) == (0, 0, 0)
    direct = spark.createDataFrame([], "cluster long, size double, mass double, peak double, first long")
    assert choose_clusters(tree, direct, 0, 0, work).count() == 0


def test_numbers_follow_the_order(spark):
    work = Workspace(spark, "test-number")
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x").repartition(5).orderBy("x")
    assert all(r.x == r.place for r in work.number(rows, "rows", "place").collect())
    assert work.number(rows.filter("x < 0"), "none", "place").count() == 0
