from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.brute import hdbscan, same_partition
from themeloom.operators.density import _search, fit_hdbscan, predict_hdbscan
from themeloom.lineage import Workspace, shared_dir
from themeloom.operators.manifold import ManifoldModel, curve, fit_manifold, local_scale, transform_manifold
from themeloom.operators import density, neighbors, preprocess
from themeloom.operators.neighbors import build_cells, in_bundles, knn_join, lower_bounds, prepare_points, squared_distances
from themeloom.plans.inputs import planted, table, texts
from themeloom.plans.topic_model import FittedModels, project, run_topic_model
from themeloom.streaming.projection import score_stream
from themeloom.streaming.run import stream_of


def points(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "embedding": list(x)}))


@pytest.mark.parametrize(
    "kind,options", [("plain", {}), ("copies", {"links_limit": 3, "block_rows": 50, "matrix_limit": 0, "merges_limit": 1, "tree_limit": 0}), ("grid", {"merges_limit": 2}), ("plain", {"search": "graph"})]
)
def test_clusters_equal_the_all_pairs_algorithm(spark, kind, options):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 2)) * 4
    x = centres[rng.integers(0, 5, 120)] + rng.normal(size=(120, 2)) * rng.uniform(0.1, 1.0, size=(120, 1))
    if kind == "copies":
        x = np.concatenate([x, np.repeat(x[:2], 30, axis=0)])
    if kind == "grid":
        x = np.round(x * 4) / 4
    model = fit_hdbscan(points(spark, x), 5, 4, **options)
    got = model.labels.toPandas().sort_values("id").topic_id.to_numpy()
    assert same_partition(hdbscan(x, 5, 4), got)
    placed = predict_hdbscan(model, points(spark, x)).toPandas().sort_values("id")
    assert len(placed) == len(x) and placed.probability.between(0, 1).all()
    assert (placed.topic_id.to_numpy() == got).mean() > 0.9
    far = predict_hdbscan(model, points(spark, np.array([[1e6, 1e6]]))).first()
    assert far["topic_id"] == -1 and far["probability"] == 0.0


def test_points_move_once_to_a_bundle_of_cells(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(120, 12)), rng.normal(size=(120, 12)) + 9])
    nodes = points(spark, x).selectExpr("id AS node", "embedding", "0D AS core", "0D AS reach")
    work = Workspace(spark, "bundles")
    cells = build_cells(nodes, "node", work, len(x), block_rows=16)
    labels = nodes.selectExpr("node", "CASE WHEN node < 120 THEN node % 2 ELSE 2 END AS comp")
    best = spark.createDataFrame([(0, (50.0, 0, 1)), (1, (50.0, 0, 1)), (2, (50.0, 0, 1))], "comp long, best struct<w double, lo long, hi long>")
    found = {r["c_lo"]: r["w"] for r in _search(cells, in_bundles(cells, 12, 16), labels, best, work).collect()}
    comp = np.where(np.arange(240) < 120, np.arange(240) % 2, 2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert found == {c: pytest.approx(d[comp == c][:, comp != c].min()) for c in range(3)}
    # 60 cells, which all points ask: one row for each bundle, not for each cell.
    assert len(cells.pivots) == 60
    assert spark.read.parquet(f"{work.root}/visits-0").count() <= 240 * 3


def test_large_components_wait(spark, monkeypatch):
    """A cluster of most points doesn't search while others are still joining each other; the tree is that of all pairs."""
    rng = np.random.default_rng(21)
    far = np.zeros((16, 8))
    far[:, 0] = 1000 + 3 * ((np.arange(16)[:, None] >> np.arange(4) & 1) * 4 ** np.arange(4)).sum(1)
    x = np.concatenate([rng.normal(size=(400, 8)), far + rng.normal(size=(16, 8)) / 100])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = np.argsort(d[:400, :400], axis=1)[:, 1:11]
    pairs = pd.DataFrame({"a": np.repeat(np.arange(400), 10), "b": near.ravel()})
    graph = spark.createDataFrame(pd.DataFrame({"lo": pairs.min(axis=1), "hi": pairs.max(axis=1), "w": d[pairs.a, pairs.b]}).drop_duplicates())
    cored = spark.createDataFrame(
        pd.DataFrame({"node": np.arange(416), "embedding": list(x), "core": np.zeros(416), "reach": np.append(np.sort(d[:400], axis=1)[:, 10], np.zeros(16))})
    )
    asked, search = [], density.visit

    def counted(bundles, visits, *rest):
        asked.append(visits.select("node").distinct().count())
        return search(bundles, visits, *rest)

    monkeypatch.setattr(density, "visit", counted)
    tree = density.spanning_tree(cored, graph, Workspace(spark, "wait"), 416, block_rows=100).toPandas()
    assert len(tree) == 415 and tree.w.sum() == pytest.approx(spanning_weight(d))
    assert asked[-1] == 16, asked  # without waiting all the points of the cluster ask in every round


def spanning_weight(d):
    left, reach, total = np.ones(len(d), bool), d[0].copy(), 0.0
    left[0] = False
    while left.any():
        j = np.flatnonzero(left)[reach[left].argmin()]
        total, left[j], reach = total + reach[j], False, np.minimum(reach, d[j])
    return total


def test_searches_skip_most_points_of_far_clusters(spark):
    """Clusters without an edge to another one in the graph, and queries of the k-NN join, ask few of all cells."""
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(30, 1, 3)) * 100 + rng.normal(size=(30, 80, 3))).reshape(-1, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    comp = np.arange(len(x)) // 80
    nodes = points(spark, x).selectExpr("id AS node", "embedding", "id % 7 / 10D AS core", "0D AS reach")
    work = Workspace(spark, "far")
    cells = build_cells(nodes, "node", work, len(x), block_rows=128, per_block=16)
    labels = nodes.selectExpr("node", "node div 80 AS comp")
    best = spark.createDataFrame([], "comp long, best struct<w double, lo long, hi long>")
    found = {r["c_lo"]: r["w"] for r in _search(cells, in_bundles(cells, 3, 128), labels, best, work).collect()}
    core = np.arange(len(x)) % 7 / 10
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    assert found == {c: pytest.approx(reach[comp == c][:, comp != c].min()) for c in range(30)}
    asked = spark.read.parquet(f"{work.root}/visits-0").selectExpr("sum(size(cells)) AS n").first()["n"]
    assert asked < len(x) * len(cells.pivots) / 50

    bound, to_pivots, _ = lower_bounds(x, cells.pivots, cells.sizes, cells.radii)
    cell = squared_distances(x, cells.pivots).argmin(axis=1)
    nearest_of = np.stack([d[:, cell == c].min(axis=1) if (cell == c).any() else np.full(len(x), np.inf) for c in range(len(cells.pivots))], axis=1)
    assert (bound <= nearest_of).all()
    halfway = np.maximum(to_pivots - cells.radii, (to_pivots - to_pivots.min(axis=1, keepdims=True)) / 2)
    assert (bound >= halfway - 1e-3).all() and (bound > halfway + 1e-3).any()


def test_many_points_are_searched_by_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MATRIX_POINTS", 100)
    x = np.random.default_rng(12).normal(size=(150, 3))
    assert prepare_points(points(spark, x), 4).index.cells is not None
    assert prepare_points(points(spark, x[:90]), 4).index.shared is not None


def test_too_few_points_are_noise(spark):
    model = fit_hdbscan(points(spark, np.eye(3)), 5, 2)
    assert {r["topic_id"] for r in model.labels.collect()} == {-1}


def test_curve_and_local_scale():
    assert curve(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)
    rng = np.random.default_rng(0)
    d = np.sort(rng.uniform(1, 2, size=(20, 14)), axis=1)
    rho, sigma = local_scale(d, 15)
    total = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(axis=1)
    assert np.allclose(total, np.log2(15), atol=1e-6) and (rho == d[:, 0]).all()


def test_layout_keeps_planted_neighbours(spark, folder):
    rows = planted(spark, folder).select("id", "embedding", "label")
    model = fit_manifold(rows.select("id", "embedding"), n_components=2, n_epochs=6)
    y = model.coords.join(rows.select("id", "label"), "id").toPandas()
    at, labels = np.stack(y.embedding), y.label.to_numpy()
    d = ((at[:, None] - at[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert (labels[d.argmin(1)] == labels).mean() > 0.97
    placed = transform_manifold(model, rows.select("id", "embedding")).toPandas().set_index("id").embedding
    shift = [np.linalg.norm(placed[i] - a) for i, a in zip(y.id, at)]
    assert np.median(shift) < 1.0


def test_stream_indexes_the_points_once(spark, folder):
    """Three batches through the cells of two indexes; rows are placed as in one projection."""
    rows = planted(spark, folder).select("id", "embedding")
    pca = preprocess.fit_pca(rows, 10, whiten=False)
    work = Workspace(spark, "index-test")
    ready = work.save(preprocess.apply_pca(rows, pca), "ready")
    models = FittedModels(None, pca, ManifoldModel(ready, ready, 8, "euclidean"), fit_hdbscan(ready, 10, 5))
    arriving = work.save(rows.repartition(3), "arriving")
    want = {r["id"]: r["topic_id"] for r in project(rows, models, "corpus", "fallback").collect()}
    count = lambda: len(list(Path(shared_dir(spark)).glob("knn-index-*/cells")))
    before, out = count(), f"{work.root}/scored"
    score_stream(stream_of(spark, work, "arriving", arriving, 1), models, out, f"{out}-checkpoint", matrix_limit=0)
    assert count() - before == 2
    found = spark.read.parquet(out)
    assert {r["id"]: r["topic_id"] for r in found.collect()} == want and found.select("batch").distinct().count() == 3


def test_prepared_points_must_fit(spark):
    own = points(spark, np.eye(4))
    ready = prepare_points(own, 2)
    assert knn_join(own, ready, 1).count() == 4
    for bad in (lambda: knn_join(own, ready, 3), lambda: knn_join(own, ready, 2, "cosine")):
        with pytest.raises(ValueError):
            bad()


def test_whole_run_and_its_cache(spark, folder, tmp_path):
    rows = planted(spark, folder).select(F.col("id").cast("string").alias("id"), "embedding")
    text = texts(spark, folder)
    corpus = rows.join(text.filter("abstract_clean IS NOT NULL").select("id"), "id")
    good = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    options = {
        "primary_variant": "title_abstract", "fallback_variant": "title", "center_embeddings": True,
        "hdbscan_min_cluster_size": 5, "hdbscan_min_samples": 3, "umap_n_components": 3, "umap_n_neighbors": 8,
    }
    run = lambda: run_topic_model(
        corpus, text, rows.join(good, "id"), options, rows, "test", "r1", str(tmp_path)
    )
    first = run()
    topics = first["topics"].toPandas()
    n_fallback = rows.count() - corpus.count()
    assert (topics.topic_source == "fallback").sum() == n_fallback
    assert (topics.topic_source == "embedding").sum() == corpus.count()
    assert topics[topics.topic_source == "embedding"].probability.isna().all()
    info = first["topic_info"].toPandas()
    assert info.n_total.sum() == len(topics) or -1 not in set(info.topic_id)
    assert set(info.variant) == {"title_abstract"} and set(first["topic_words"].columns) >= {"topic_id", "word", "weight", "rank"}
    again = run()["topics"].toPandas()
    key = ["id", "topic_source"]
    assert topics.sort_values(key).topic_id.tolist() == again.sort_values(key).topic_id.tolist()
