"""Scores by matching contexts against plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import ppm, queries

SCHEMA = "doc_id long, text string"
D = ppm.DEPTH


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


def stretch(text):
    return b"\n" * D + " ".join(words_of(text)).encode() + b"\n"


class Plain:
    """Counts of all contexts in dictionaries; one probability at a time."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        self.words = Counter()
        for t in texts:
            s = stretch(t)
            for i in range(D, len(s)):
                self.after[s[i - D : i]][s[i]] += 1
            self.words.update([*words_of(t), "\n"])
        for k in range(D, 0, -1):
            for context, own in [x for x in self.after.items() if len(x[0]) == k]:
                for byte in own:
                    self.after[context[1:]][byte] += 1

    def probability(self, context, byte):
        p, gone = 1.0, set()
        for k in range(D, -1, -1):
            own = {b: n for b, n in self.after.get(context[D - k :], {}).items() if b not in gone}
            total = sum(own.values())
            if byte in own:
                return p * (own[byte] - ppm.ESCAPE) / total
            if total:
                p *= ppm.ESCAPE * len(own) / total
            gone |= set(own)
        return p / (ppm.ALPHABET - len(gone))

    def score(self, text):
        s = stretch(text)
        return sum(math.log10(self.probability(s[i - D : i], s[i])) for i in range(D, len(s)))

    def base(self, text):
        n, v = self.words.total(), len(self.words)
        own = [*words_of(text), "\n"]
        return len(own), sum(self.words[w] > 0 for w in own), n, sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in own)


ODD = [
    (1, "The cat sat."), (2, "the cat  sat\n on\tthe mat"), (3, None), (4, ""), (5, " \n\t "), (6, "ein völlig anderer Satz, 你好"), (7, "the cat sat on the hat"), (7, "the cat sat on the hat"),
    (8, "x" * 300), (9, "the the the the"), (10, "\x00\x01\x7f"), (11, "the cat said zzz " * 4), (None, "THE CAT"), (12, "trailing "), (13, " leading"),
]


def check(rows, trained):
    plain = Plain([t for t, flag in trained if flag])
    for r in rows:
        n_tokens, n_known, n, base = plain.base(r.text)
        assert (r.lm.n_tokens, r.lm.n_known, r.lm.train_tokens) == (n_tokens, n_known, n), r.text
        assert r.lm.base_score == pytest.approx(base, rel=1e-9)
        assert r.lm.score == pytest.approx(plain.score(r.text), rel=1e-9), r.text


@pytest.mark.parametrize("frequent", [1 << 20, 0])
def test_odd_texts(spark, frequent):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    found = ppm.score_documents(docs, F.col("doc_id") % 3 != 0, frequent=frequent, frequent_words=frequent // 4).collect()
    assert len(found) == len(ODD)
    check(found, [(t, k is not None and k % 3 != 0) for k, t in ODD])


def test_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    found = queries.op13_ppm(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs) and all(r.held_out == out[r.doc_id] for r in found)
    plain = Plain([t for k, t in docs.items() if not out[k]])
    for r in found:
        n_tokens, n_known, n, base = plain.base(docs[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    for r in sorted(found, key=lambda r: r.n_tokens)[:40]:
        assert r.score == pytest.approx(plain.score(docs[r.doc_id]), rel=1e-9)


def test_better_than_word_counts_on_what_is_held_out(spark):
    """With ten thousand documents the trie beats word counts, although these charge an unknown word no more for its letters."""
    found = queries.op13_ppm(spark, "/root/testdata/sf0.1").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    assert all(r.s > r.b for r in found.collect() if r.held_out)


def test_probabilities_add_up():
    plain = Plain([t for _, t in ODD])
    symbols = [b for b in range(256) if b not in (9, 11, 12, 13)]
    assert len(symbols) == ppm.ALPHABET
    for context in (b"\n" * D, b"e cat"[:D], b" sat.", b"zzzzz", b"\nthe "):
        assert sum(plain.probability(context, b) for b in symbols) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(ODD[:4], SCHEMA)
    for flag in (F.lit(False), F.lit(None).cast("boolean")):
        for r in ppm.score_documents(docs, flag).collect():
            assert r.lm.base_score == 0 and r.lm.n_known == 0 and r.lm.train_tokens == 0
            assert r.lm.score == pytest.approx((len(stretch(r.text)) - D) * -math.log10(ppm.ALPHABET))


def test_long_texts_in_pieces(monkeypatch):
    texts = ["word and  more \n" * 200, "x" * 500 + " y", " " * 300 + "a" + " " * 300, "é " * 100]
    whole = [(b"".join(p[0][D:] for p in ppm.pieces_of(t.encode())), [w for p in ppm.pieces_of(t.encode()) for w in p[1]]) for t in texts]
    codes = [np.concatenate([ppm.grams(p[0]) for p in ppm.pieces_of(t.encode())]) for t in texts]
    assert [b"\n" * D + s for s, _ in whole] == [stretch(t) for t in texts]
    monkeypatch.setattr(ppm, "PIECE", 37)
    for t, (s, words), code in zip(texts, whole, codes):
        parts = list(ppm.pieces_of(t.encode()))
        assert len(parts) > 1 and b"".join(p[0][D:] for p in parts) == s and [w for p in parts for w in p[1]] == words
        assert (np.concatenate([ppm.grams(p[0]) for p in parts]) == code).all()


def test_counts_are_given_out_in_parts(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in ODD] * 5, "trains": [k is not None for k, _ in ODD] * 5})

    def totals():
        out = Counter()
        for part in ppm._count_task([batch, batch]):
            for token, gram, n, other in zip(*(part[c].to_pylist() for c in ("token", "gram", "n", "n_other"))):
                out[token, gram, 0] += n
                out[token, gram, 1] += other
        return out

    once = totals()
    for name, value in (("PIECE", 50), ("SPILL", 30), ("WORDS", 3)):
        monkeypatch.setattr(ppm, name, value)
    assert len(list(ppm._count_task([batch]))) > 5 and totals() == once


def test_codes():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 48, 5000))
    table = ppm.Codes(codes[::2], np.arange(len(codes[::2]), dtype=float))
    value, found = table.find(codes)
    assert found[::2].all() and not found[1::2].any() and (value[::2] == np.arange(len(codes[::2]))).all() and len(table.rest)


def test_clashes_and_empty_table(spark):
    names = ("id", "row", "own", "gram", "token", "score", "base", "known", "trains", "n", "seen", "cost")
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], SCHEMA).selectExpr("*", *[f"'odd' AS {c}" for c in names])
    plain = {r.doc_id: r.lm for r in ppm.score_documents(docs.select("doc_id", "text"), F.lit(True)).collect()}
    for r in ppm.score_documents(docs, F.lit(True), frequent=0, frequent_words=0).collect():
        assert all(r[c] == "odd" for c in names) and r.lm.score == pytest.approx(plain[r.doc_id].score)
    with pytest.raises(ValueError):
        ppm.score_documents(docs.withColumn("LM", F.lit(1)), F.lit(True))
    assert ppm.score_documents(docs.limit(0), F.lit(True)).count() == 0
