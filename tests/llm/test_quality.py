"""The quality classifier: held-out accuracy, shrinkage, odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from themeloom.llm import quality, queries


def test_held_out_accuracy(spark):
    """Fitted without a quarter of the labels, judged on them."""
    folder = "/root/testdata/sf0.1"
    docs = queries.table(spark, folder, "documents").repartition(8)
    labels = queries.table(spark, folder, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    judged = quality.classify_quality(docs, labels.filter(~held)).select("doc_id", "judged.*")
    rows = judged.join(labels.filter(held), "doc_id").collect()
    good = np.array([r["quality"] == 1 and r["toxic"] == 0 for r in rows])
    keep = np.array([r["keep"] for r in rows])
    low = np.array([r["quality"] == 0 for r in rows])
    toxic = np.array([r["toxic"] == 1 for r in rows])
    print(len(rows), keep[good].mean(), (~keep)[low].mean(), (~keep)[toxic].mean())
    assert keep[good].mean() > 0.97
    assert (~keep)[low].mean() > 0.9
    assert (~keep)[toxic].mean() > 0.8


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 0.9)] * 400 + [("b", "x", 0.2)] * 400 + [("c", "y", 0.0)] + [(None, None, 0.5)]
    rows += [("a", "z", 0.1)] * 2
    got = {(r["host"], r["path"]): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["a", "x"]["path_p"] > 0.85 and got["b", "x"]["path_p"] < 0.25
    assert 0 < got["c", "y"]["host_p"] < got["c", "y"]["global"]
    assert abs(got["a", "z"]["path_p"] - got["a", "z"]["host_p"]) < got["a", "z"]["host_p"] - 0.1
    assert (None, None) in got


def test_sites_alike_move_nothing(spark):
    rows = [(f"h{i % 50}", "x", float(i // 50 % 2)) for i in range(5000)]
    got = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()
    assert max(abs(r["path_p"] - r["global"]) for r in got) < 0.005


def test_logistic_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 3))
    y = (rng.random(5000) < 1 / (1 + np.exp(-(0.5 + x @ [2.0, -1.0, 0.0])))).astype(float)
    assert np.allclose(quality.fit_logistic(x, y), [0.5, 2, -1, 0], atol=0.2)


def test_features_are_defined():
    rows, *_ = quality.format_features(pa.array([None, "", "a", "A! " * 40000, "é"], pa.string()))
    assert np.isfinite(rows).all() and len(rows) == 5


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None), (1, "", "s", "en"), (2, "text " * 50000, "s", None), (None, "x", "t", "en"), (3, "x", "t", "en"), (3, "x", "t", "en")],
        "doc_id long, text string, source string, lang string",
    ).withColumn("judged", F.lit(0)).withColumn("_id", F.lit(1))
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify_quality(docs, labels)
    assert out.count() == 6 and out.filter("judged.keep IS NULL").count() == 0
    none = quality.classify_quality(docs.limit(0), labels.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "source", "lang", "_id", "judged"]


def test_clashing_columns(spark, folder):
    docs = queries.table(spark, folder, "documents").limit(60)
    labels = queries.table(spark, folder, "labels")
    plain = {r["doc_id"]: r["judged"] for r in quality.classify_quality(docs, labels).collect()}
    names = ("_e", "_good", "_site_host", "_site_path_p", "_row", "host", "path", "judged")
    for r in quality.classify_quality(docs.selectExpr("*", *[f"'odd' AS {c}" for c in names]), labels).collect():
        assert all(r[c] == "odd" for c in names[:-1]) and r["judged"] == plain[r["doc_id"]]
