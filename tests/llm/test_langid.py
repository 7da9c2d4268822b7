"""Language identification: held-out accuracy, mixtures, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from themeloom.llm import langid, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op8_language(spark, folder).join(queries.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def small_model(spark):
    rows = [("the cat and the dog with the house", "en")] * 30 + [("der hund und die katze mit dem haus", "de")] * 30
    rows += [("el perro y la gata con la casa", "es")] * 30 + [(None, "en"), ("ignored text", None)]
    return langid.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_equal_a_plain_count(spark):
    model = small_model(spark)
    assert model.names == ["de", "en", "es"]
    table = langid.bucket_counts(np.frombuffer(b"el perro y la gata con la casa", np.uint8)) * 30 + langid.SMOOTH
    assert np.allclose(model.log_p[:, 2], np.log(table / table.sum()))


def test_mixtures_and_odd_rows(spark):
    model = small_model(spark)
    rows = [
        ("The dog and the cat",), (None,), ("",), ("123 !!",), ("the cat and the dog with the house der hund und die katze mit dem haus",), ("cat " * 30000,),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(langid.languages(model, spark, F.col("text"))).collect()]
    assert got[0]["lang"] == "en" and got[0]["langs"] == ["en"]
    assert all(g["lang"] == "und" and g["score"] == 0 and g["langs"] == [] for g in got[1:4])
    assert sorted(got[4]["langs"]) == ["de", "en"] and abs(got[4]["shares"][0] - 0.5) < 0.1
    assert got[5]["lang"] == "en"


def test_no_training_rows(spark):
    none = langid.learn(spark.createDataFrame([], "text string, lang string"))
    got = spark.createDataFrame([("text",)], "text string").select(langid.languages(none, spark, F.col("text")).alias("m")).first()["m"]
    assert got["lang"] == "und"


def test_expectation_maximisation_finds_proportions():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(300, 0.3), 3).T + 1e-6
    p /= p.sum(0)
    weight = rng.multinomial(20000, p @ [0.7, 0.3, 0.0]).astype(float)
    share = langid.infer(np.log(p), weight)
    assert abs(share[0] - 0.7) < 0.05 and abs(share[1] - 0.3) < 0.05 and share[2] == 0
