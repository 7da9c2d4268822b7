"""Near copies against all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from themeloom.llm import ngram_join as nj
from themeloom.llm import queries

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, n=5):
    w = WORDS.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = []
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= threshold * len(sets[i] | sets[j]):
                near.append((i, j))
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], min(members[find(i)]), len(members[find(i)]), links[i]) for i in range(len(rows))], near


def compare(frame, rows):
    want, _ = brute(rows)
    got = [(r["doc_id"], r["class_id"], r["class_rows"], r["n_links"]) for r in frame.collect()]
    assert sorted(got) == sorted(want)


def test_query(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, folder, "documents").collect()]
    compare(queries.op7_ngram_join(spark, folder), rows)


def planted():
    rng = random.Random(5)
    word = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for group in range(6):
        base = rng.choices(word, k=120)
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(word)
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "!!"), (i + 3, "one two"), (i + 4, "One, two!"), (i + 5, "long text " * 20000)]
    return rows


def test_planted_groups(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 4)  # components take several blocks
    rows = planted()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, key int, component string")
    compare(nj.near_copies(docs), rows)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f."), (3, "x y"), (None, "x y"), (3, "z"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["class_rows"], r["n_links"]) for r in nj.near_copies(docs).collect()), key=str)
    want = [(1, 1, 3, 2), (1, 1, 3, 2), (2, 1, 3, 2), (3, 3, 2, 1), (None, 3, 2, 1), (3, 3, 1, 0), (None, None, 1, 0), (4, 4, 1, 0)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert nj.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_band_recall():
    bands = nj.bands_for(0.8, 7, 0.9995)
    assert 1 - (1 - 0.8**7) ** bands >= 0.9995 > 1 - (1 - 0.8**7) ** (bands - 1)


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    flat = np.concatenate([pool[:1200], pool[300:]])
    m = nj.minhash(flat, np.array([0, 1200, 2400]), 2000)
    assert abs((m[0] == m[1]).mean() - 900 / 1500) < 0.05


def test_bands_find_close_pairs(spark):
    rows = planted()
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    bands = nj.bands_for()
    signed = {r["doc_id"]: set(r["b"]) for r in texts.select("doc_id", nj._signer(5, bands, nj.ROWS)("text").alias("s")).select("doc_id", F.col("s.bands").alias("b")).collect()}
    _, near = brute(rows)
    assert near and all(signed[rows[i][0]] & signed[rows[j][0]] for i, j in near)
