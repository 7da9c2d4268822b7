import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.operators import inference, neighbors, preprocess, terms, topics
from themeloom.operators.concepts import index_concepts, nearest_concept
from themeloom.operators.dedup import dedup_by_id, fallback_minus_primary
from themeloom.operators.neighbors import _top_of_bundle, knn_join
from tests.brute import knn


def ids(df):
    return sorted((r["id"] for r in df.select("id").collect()), key=lambda x: (x is not None, x))


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id string")


@pytest.mark.parametrize(
    "fallback,primary,expected",
    [
        (["1", "2", "2", None], ["1"], ["2"]),
        (["1", "2"], ["1", None], []),
        (["1", None], [], [None, "1"]),
        ([None], ["1"], []),
    ],
)
def test_not_in_rules(spark, fallback, primary, expected):
    assert ids(fallback_minus_primary(frame(spark, fallback), frame(spark, primary))) == expected


def test_anti_join_is_not_a_broadcast_of_the_primary_side(spark):
    out = fallback_minus_primary(frame(spark, ["1"]), frame(spark, ["2"]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Cross" not in plan


def test_dedup(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "id string, batch int")
    got = {(r["id"], r["batch"]) for r in dedup_by_id(df, order_by=["batch"]).collect()}
    assert got == {("a", 1), (None, 4)}
    assert dedup_by_id(spark.range(2).toDF("x")).count() == 2


def docs(spark, rows):
    return spark.createDataFrame(rows, "topic_id long, doc string")


def test_one_topic_drops_the_frequency_limits(spark):
    got = terms.ctfidf(docs(spark, [(0, "alpha beta"), (0, "alpha")]))
    assert {r["term"] for r in got.collect()} == {"alpha", "beta", "alpha beta"}


def test_empty_vocabulary_drops_the_frequency_limits(spark):
    got = terms.ctfidf(docs(spark, [(0, "alpha"), (1, "beta"), (2, "gamma")]))
    assert {r["term"] for r in got.collect()} == {"alpha", "beta", "gamma"}


def test_a_topic_without_terms_still_counts(spark):
    rows = [(0, "alpha beta"), (1, "alpha"), (2, "alpha"), (3, "!")]
    got = terms.ctfidf(docs(spark, rows), ngram=(1, 1), min_df=1, max_df=0.75)
    assert {r["term"] for r in got.collect()} == {"alpha", "beta"}


def test_no_topics_is_an_error(spark):
    with pytest.raises(ValueError, match="no non-noise topics"):
        terms.ctfidf(docs(spark, []), require_topics=True)
    with pytest.warns(UserWarning):
        assert terms.guard_vectorizer(1) == (1, 1.0)
    assert terms.guard_vectorizer(10) == (2, 0.95)


def test_weights_have_unit_length(spark):
    rows = [(0, "aa bb cc"), (1, "bb cc dd"), (2, "cc dd ee")]
    got = terms.ctfidf(docs(spark, rows), max_df=1.0).groupBy("topic_id").agg(F.sum(F.pow("weight", F.lit(2))).alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in got.collect())


def test_short_topics_can_be_filled(spark):
    rows = [(0, "aa bb", 0.8), (0, "cc", 0.6), (1, "aa", 1.0)]
    weights = spark.createDataFrame([(t, w, 1, x) for t, w, x in rows], "topic_id long, term string, tf long, weight double")
    assert terms.top_words(weights, 3).count() == 3
    got = terms.top_words(weights, 3, zero_fill=True).orderBy("topic_id", "rank").collect()
    assert [(r["topic_id"], r["word"], r["rank"]) for r in got] == [
        (0, "aa bb", 1), (0, "cc", 2), (0, "aa", 3), (1, "aa", 1), (1, "aa bb", 2), (1, "cc", 3),
    ]


def test_noise_topic_needs_corpus_noise(spark):
    info = spark.createDataFrame([(0, "0_a", ["a"])], "topic_id long, label string, top_words array<string>")
    calm = spark.createDataFrame([(0,)], "topic_id long")
    noisy = spark.createDataFrame([(0,), (-1,), (-1,)], "topic_id long")
    assert topics.append_noise_topic(info, calm).count() == 1
    rows = topics.append_noise_topic(info, noisy).filter("topic_id = -1").collect()
    assert [(r["label"], r["top_words"]) for r in rows] == [("-1_noise", [])]


def points(spark, x, first=0):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + len(x)), "embedding": list(x)}))


def test_stored_counts_give_the_same_weights(spark):
    rows = [(i % 4, " ".join(f"w{(i * j) % 23}" for j in range(1, 9))) for i in range(40)]
    work = Workspace(spark, "counts")
    key = lambda df: sorted((r["topic_id"], r["term"], r["tf"], round(r["weight"], 9)) for r in df.collect())
    stored = terms.ctfidf(docs(spark, rows), work=work)
    assert key(stored) == key(terms.ctfidf(docs(spark, rows))) and key(stored)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and spark.read.parquet(f"{work.root}/counts").count() > 0
    with pytest.raises(ValueError, match="no non-noise topics"):
        terms.ctfidf(docs(spark, []), require_topics=True, work=work)


@pytest.mark.parametrize("options", [{}, {"matrix_limit": 0, "block_rows": 40}])
def test_knn_with_copies_and_ties(spark, options):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(90, 3)), np.zeros((60, 3)), np.round(rng.normal(size=(50, 3)))])
    df = points(spark, x)
    got = knn_join(df, df, 4, exclude_self=True, **options).toPandas().sort_values(["query_id", "rank"])
    assert (got.neighbor_id.to_numpy().reshape(len(x), 4) == knn(x, 4)).all()


def test_knn_of_fewer_points_than_asked(spark):
    df = points(spark, np.eye(3))
    assert knn_join(df, df, 10, exclude_self=True).count() == 6
    assert knn_join(df, df, 10, exclude_self=True, matrix_limit=0).count() == 6


def test_nearest_concept_rules(spark):
    corpus = spark.createDataFrame([("z", [0.0, 0.0]), ("a", [1.0, 1.0]), ("n", [-1.0, -1.0])], "id string, embedding array<double>")
    concepts = spark.createDataFrame([("c1", [1.0, 0.0]), ("c0", [0.0, 1.0])], "id string, embedding array<double>")
    for limit in (1 << 20, 0):
        got = {r["id"]: r["concept"] for r in nearest_concept(corpus, concepts, 0.0, limit).collect()}
        assert got == {"z": 0, "a": 0, "n": -1}
    order = {r["id"]: r["concept"] for r in index_concepts(concepts).collect()}
    assert order == {"c0": 0, "c1": 1}


def test_pca_agrees_with_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) * np.array([5, 4, 3, 1, 1, 1.0]) + 7
    df = points(spark, x)
    model = preprocess.fit_pca(df, 3)
    got = preprocess.apply_pca(df, model).toPandas().sort_values("id")
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = u[:, :3] * np.sqrt(len(x) - 1)
    assert np.allclose(np.abs(np.stack(got.embedding)), np.abs(want), atol=1e-8)
    assert preprocess.explained_variance(model) == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())
    again = preprocess.PcaModel.from_table(model.table(spark))
    assert np.allclose(again.loadings, model.loadings) and again.scale == model.scale


def test_sampling_is_stable_and_exact_in_size(spark):
    for n_rows, n in [(100, 30), (100, 90), (5000, 40), (5000, 4999)]:
        df = spark.range(n_rows)
        a, b = (ids(preprocess.sample_rows(df.repartition(k), n)) for k in (1, 7))
        assert a == b and len(a) == n
    df = spark.range(100)
    assert preprocess.sample_rows(df, 1000).count() == 100


def test_requests_are_checked(spark):
    scorer = inference.LexicalScorer(("SUPPORTS", "NOT_RELEVANT"))
    premises = spark.createDataFrame([(1, "a b")], "id long, premise string")
    with pytest.raises(ValueError, match="unknown"):
        inference.classify(premises, ["supports"], scorer, max_len=5)
    with pytest.raises(ValueError, match="hypothesis"):
        inference.classify(premises, ["supports"], scorer, passes=1)
    with pytest.raises(ValueError, match="unknown"):
        inference.classify_direct(premises, ["unknown"], "h", scorer)
    assert inference.direct_label_map(["not relevant", "supports"], scorer.native_labels) == [1, 0]
    assert inference.classify(premises.limit(0), ["x"], scorer).count() == 0


def test_entailment_positions():
    assert inference.entailment_index(["Entailment", "neutral", "contradiction"]) == (0, 2)
    assert inference.entailment_index(["contradiction", "neutral", "entailment"]) == (2, 0)
    assert inference.entailment_index(["no", "yes"]) == (1, 0)


def test_batches_keep_input_order():
    seen = []

    def score(premises, hypotheses):
        seen.append(len(premises))
        return np.array([[len(p)] for p in premises], dtype=float)

    texts = ["aaa", "a", "aaaaa", "aa", "aaaa"]
    out = inference._batched(score, texts, [""] * 5, 2)
    assert out[:, 0].tolist() == [3, 1, 5, 2, 4] and seen == [2, 2, 1]


def bundle_of(n_queries, n_points, n_cells, copies, width=8):
    """Queries that visit all cells of a bundle, and its points, each with ``copies`` ids."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(n_queries, width)), rng.normal(size=(n_points, width))
    cells = np.arange(n_points, dtype=np.int32) % n_cells
    ids = (np.arange(n_points)[:, None] * copies + np.arange(copies)).tolist()
    left = pa.table({
        "query_id": np.arange(n_queries), "embedding": pa.array(list(x)), "cells": pa.array([list(range(n_cells))] * n_queries, pa.list_(pa.int32())),
        "bound": np.full(n_queries, np.inf),
    })
    right = pa.table({"own_cell": cells, "_first": np.arange(n_points) * copies, "ids": pa.array(ids), "embedding": pa.array(list(y))})
    return left, right, np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


def test_a_visit_holds_few_of_the_neighbours_it_finds():
    left, right, d = bundle_of(2000, 2048, 64, 1)
    tracemalloc.start()
    found = _top_of_bundle(32, 1 << 16)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All that the cells find would be 4 million rows of three columns.
    assert peak < 60 << 20, peak
    assert found.num_rows == 2000 * 32
    got = np.sort(found.column("distance").to_numpy().reshape(2000, 32), axis=1)
    assert np.allclose(got, np.sort(d, axis=1)[:, :32], rtol=0, atol=1e-12)


def test_screened_neighbours_are_those_of_all_pairs(monkeypatch):
    """Of a million pairs the double-precision product is never asked for, and what is found is the same to the last bit."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(500, 24)), rng.normal(size=(2000, 24))
    y[1000:1200] = y[:200]
    kinds = {"plain": (x, y), "far": (x + 1e5, y + 1e5), "tiny": (x * 1e-9, y * 1e-9), "huge": (x * 1e9, y * 1e9)}
    for name, (a, b) in kinds.items():
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        order = np.lexsort((np.broadcast_to(np.arange(2000), d.shape), d))[:, :6]
        for limit in (None, np.sort(d, axis=1)[:, 9]):
            r, c, got = neighbors.nearest(a, b, 6, limit)
            assert (r == np.repeat(np.arange(500), 6)).all() and (c == order.ravel()).all(), name
            assert (got == np.take_along_axis(d, order, axis=1).ravel()).all()
    monkeypatch.setattr(neighbors, "squared_distances", None)
    assert len(neighbors.nearest(x, y, 6)[0]) == 3000
    with pytest.raises(TypeError):  # what single precision can't hold takes the other product
        neighbors.nearest(x * 1e20, y * 1e20, 6)


def test_copies_behind_enough_nearer_ones_are_not_written_out(spark):
    left, right, d = bundle_of(50, 200, 5, 61)
    found = _top_of_bundle(61)(left, right)
    assert found.num_rows == 50
    assert [i[0] // 61 for i in found.column("ids").to_pylist()] == d.argmin(axis=1).tolist()
    x = np.repeat(np.random.default_rng(6).normal(size=(40, 3)), 9, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    for options in ({}, {"matrix_limit": 0, "block_rows": 16}):
        got = knn_join(df, df, 12, exclude_self=True, **options).toPandas().sort_values(["query_id", "rank"])
        assert (got.neighbor_id.to_numpy().reshape(len(x), 12) == knn(x, 12)).all()


def test_words_of_long_texts_are_added_up_in_slices():
    n, words, dim = 2000, 1500, 64
    codes = np.random.default_rng(4).choice([-1, 1], n * words) * np.random.default_rng(8).integers(1, dim + 1, n * words)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words), pa.array(codes.astype(np.int32)))
    lists = pa.concat_arrays([lists, pa.array([[], [3, 3, -1]], pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n + 2)), lists], ["id", "codes"])
    tracemalloc.start()
    out = pa.Table.from_batches(inference._cell_sums(dim)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # At once it would be 24 MB for each of five columns.
    assert peak < 30 << 20, peak
    assert out.column("id").to_pylist() == list(range(n + 2))
    got = np.array(out.column("raw").to_pylist())
    assert got[:n].sum() == np.sign(codes).sum() and np.abs(got[n]).sum() == 0 and got[n + 1, 2] == 2 and got[n + 1, 0] == -1
    assert list(inference._cell_sums(dim)(iter([batch.slice(0, 0)]))) == []


def test_bigrams_between_documents_share_the_shuffle_of_the_terms(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = [(0, "a", "red fox"), (0, "b", "fox den"), (0, "c", "!"), (0, "d", "fox den"), (1, "a", "red fox"), (1, "b", "den")]
    df = spark.createDataFrame(rows, "topic_id long, id string, doc string")
    counted = terms.term_counts(df.mapInArrow(count, df.schema), (2, 2), boundary_ngrams=True)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"keys=\[topic_id#\w+, term#", plan)) == 2  # partial and final
    got = {(r["topic_id"], r["term"]): r["tf"] for r in counted.collect()}
    assert got == {(0, "red fox"): 1, (0, "fox den"): 2, (0, "fox fox"): 1, (0, "den fox"): 1, (1, "red fox"): 1, (1, "fox den"): 1}
    # Once for the ends, once for the terms; the bounds of the ranges took a third reading.
    assert reads.value == 2 * len(rows)
