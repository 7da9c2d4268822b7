"""Benchmark hits against a brute-force scan."""

import hashlib
import re

import pytest

from themeloom.llm import decontaminate as dc
from themeloom.llm import queries

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, n=13):
    own = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        w = words(item_text)
        size = min(n, len(w))
        if not size:
            continue
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


def check(rows, texts, items):
    for r in rows:
        n, hit, found = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_query(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, folder, "documents").collect()}
    items = [tuple(r) for r in queries.table(spark, folder, "benchmark").select("item_id", "text").collect()]
    rows = queries.op9_decontaminate(spark, folder).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    check(rows, texts, items)


LONG = " ".join(f"w{i}" for i in range(30))
DOCS = [
    (1, LONG), (2, None), (3, ""), (4, "!!! ???"), (5, "Short Item"), (6, "a short\nITEM, here"), (7, "x " * 50_000 + LONG),
    (8, " ".join(f"W{i}!" for i in range(5, 19)) + " other"), (8, "repeat"), (8, "repeat"), (None, LONG), (9, "éa éb"),
]
ITEMS = [(10, LONG), (2, "short item"), (2, "short item"), (3, None), (4, ""), (5, "short item"), (None, "éa ÉB éb"), (11, "éa éb")]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_small_cases(spark, shard_bytes):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in DOCS], "doc_id long, text string, hits string, _hits int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = dc.find_hits(docs, bench, shard_bytes=shard_bytes).select(
        "doc_id", "text", "hits", dc.n_hit(dc.F.col("hits")).alias("n")
    ).collect()
    assert len(rows) == len(DOCS)
    items = [("null" if i is None else i, t) for i, t in ITEMS]
    for r in rows:
        n, hit, found = brute(r["text"], items)
        assert (r["hits"]["n_words"], r["n"], sorted(r["hits"]["items"])) == (n, hit, found)


def test_removal(spark):
    docs = spark.createDataFrame([(i, t) for i, t in DOCS], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 7, 8, 8]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[6] == "a , here" and cut[2] is None and cut[7].strip() == ("x " * 50_000).strip()
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, remove="lines")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dc.find_hits(none, bench).collect() == []
    assert dc.find_hits(docs, bench).first()["hits"]["items"] == []


def test_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"before {words} after", "a", "b"), (2, "clean", "a", "b")], "doc_id long, text string, _hits_0 string, _hits_1 string")
    items = spark.createDataFrame([("x", words), ("y", "other words " * 9)], "item_id string, text string")
    found = dc.find_hits(docs, items, shard_bytes=100)
    assert {r["doc_id"]: (r["_hits_0"], r["_hits_1"], r["hits"]["items"]) for r in found.collect()} == {1: ("a", "b", ["x"]), 2: ("a", "b", [])}
