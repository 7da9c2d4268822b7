"""Divergences of sources against a plain count of the same definition."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from themeloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, top):
    groups, counts, n_docs = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = TERM.findall(lower(text or ""))
        counts[lang, source].update(words)
        n_docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in n_docs[lang].items() if n >= min_docs]

        def share(own):
            total = sum(own[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 5) // total for t in kept}

        whole = sum((counts[lang, s] for s in sources), Counter())
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[r][t]) for t in kept), r) for r in sources if r != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def result(spark, rows, **options):
    found = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found.collect())


def test_tables(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert result(spark, rows) == brute(rows, 30, 50)
    assert result(spark, rows, min_docs=2, top=7) == brute(rows, 2, 7)


def test_odd_rows(spark):
    rows = [
        (1, "A b a. É é zÀ", "en", "x"), (1, "A b a. É é zÀ", "en", "x"), (2, None, "en", "y"), (3, "", None, None), (None, "a1b_c", "en", None),
        (4, "one ONE", "solo", "only"), (5, "\x00\x7f 12", "bare", "p"), (6, "", "bare", "q"), (7, "wort " * 500, "en", "z"), (8, "İstanbul K", "en", "z"),
    ]
    for least in (1, 2):
        assert result(spark, rows, min_docs=least, top=3) == brute(rows, least, 3)
    found = result(spark, rows, min_docs=1)
    assert ("bare", "p", "pair", "q", 0, 1) in found
    assert not [r for r in found if r[0] == "solo" and r[2] == "pair"]


def test_ties_are_ranked_by_bytes(spark):
    rows = [(1, "é z b a ä", "en", "x"), (2, "other", "en", "y"), (3, "other", "en", "w")]
    found = [r for r in result(spark, rows, min_docs=1) if r[1:3] == ("x", "term")]
    assert [r[3] for r in sorted(found, key=lambda r: r[5])] == ["a", "b", "z", "ä", "é"]
    assert found and result(spark, rows, min_docs=1) == brute(rows, 1, 50)


def test_spills_add_up(spark, monkeypatch):
    batches = pa.RecordBatch.from_pydict({"text": ["a b c", "a b", "c d a"], "lang": ["en"] * 3, "source": ["x", "y", "x"]})
    monkeypatch.setattr(divergence, "SPILL", 2)
    given = list(divergence._fold([batches]))
    assert len(given) == 3
    total = Counter()
    for batch in given:
        for term, stripe in zip(batch["term"].to_pylist(), batch["stripe"].to_pylist()):
            for e in stripe:
                total[term, e["source"]] += e["n"]
    assert total["a", None] == 3 and total["a", "x"] == 2 and total["", None] == 3 and total["d", "x"] == 1


def test_long_text_is_read_in_pieces(monkeypatch):
    text = ("wort und " * 50 + "langeswort" * 30 + " ende").encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert divergence.term_counts(text) == whole


def test_shares_are_exact():
    for count, total in ((0, 5), (9 * 10**12, 9 * 10**12 + 5), (123_456_789_012_345, 9 * 10**15), (7, 12)):
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 5) // total


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x"), (2, "b c", "en", "y")], SCHEMA)
    plain = sorted(map(tuple, divergence.source_divergence(docs, min_docs=1).collect()))
    names = ("n", "e", "stripe", "groups", "term", "item", "value", "rank", "n_docs", "n_kept", "total", "part")
    more = docs.selectExpr("*", *[f"'odd' AS {name}" for name in names])
    assert sorted(map(tuple, divergence.source_divergence(more, min_docs=1).collect())) == plain


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
