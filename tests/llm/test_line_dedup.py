"""Line dedup against a brute-force version of its rule."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import line_dedup as ld
from themeloom.llm import queries


def documents_of(texts):
    hashes, words, at, first, lengths = ld.lines_of(pa.array(texts, pa.string()))
    return [
        (hashes[a:b], words[a:b], at[a:b], n) for a, b, n in zip(first[:-1], first[1:], lengths)
    ]


def rare_lines(rows):
    """Codes of the lines of 8 words or more that 2 to 10 rows have."""
    count = Counter()
    for own, words, *_ in documents_of([t for _, t in rows]):
        count.update({c for c, n in zip(ld.line_codes(own).tolist(), words) if n >= 8} if len(own) else ())
    return np.array([c for c, n in count.items() if 2 <= n <= 10], np.uint64)


def brute(rows, need):
    """Every document against every earlier one."""
    docs = documents_of([t for _, t in rows])
    out, rare = [], rare_lines(rows)
    for k, (i, text) in enumerate(rows):
        own, words, at, n = docs[k]
        gone = np.zeros(len(own), bool)
        for m, (j, _) in enumerate(rows):
            earlier = j is not None and (i is None or j < i)
            if earlier and len(own) and len(docs[m][0]):
                gone |= ld.common_lines(own, words, docs[m][0], docs[m][1], need, rare)
        edges = [0, *at[1:].tolist(), n] if len(own) else [0, n]
        out.append("".join(text[a:b] for a, b, g in zip(edges, edges[1:], gone if len(own) else [False]) if not g) if text is not None else None)
    return out


def brute_runs(rows, need):
    """Which lines belong to runs that an earlier document has: the least that must go."""
    seen, must = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        own, words, *_ = documents_of([rows[k][1]])[0]
        if len(own):
            runs, a, b = ld.runs_of(own, words, np.array([0, len(own)]), need)
            must[k] = {x for r, s, e in zip(runs.tolist(), a, b) if r in seen for x in range(s, e)}
            seen |= set(runs.tolist())
    return must


def test_query_cuts_every_repeated_run(spark, folder):
    table = {r["doc_id"]: r["text"] for r in queries.table(spark, folder, "documents").collect()}
    rows = sorted(table.items())
    got = {r["doc_id"]: r for r in queries.op1_line_dedup(spark, folder).collect()}
    assert sorted(got) == sorted(table)
    must = brute_runs(rows, ld.BLOCK_WORDS)
    full = dict(zip(table_keys := [i for i, _ in rows], brute(rows, ld.BLOCK_WORDS)))
    for k, (i, text) in enumerate(rows):
        assert got[i]["n_removed"] == len(text) - len(got[i]["text"])
        assert bool(must.get(k)) <= bool(got[i]["n_removed"])
        assert len(got[i]["text"]) >= len(full[i])
        if text == full[i]:
            assert got[i]["text"] == text
    assert table_keys and any(r["n_removed"] for r in got.values())


def lines(rng, n):
    return [" ".join(rng.choices([f"w{i}" for i in range(500)], k=rng.randrange(3, 14))) + "." for _ in range(n)]


def planted():
    rng = random.Random(3)
    passages = [lines(rng, 8) for _ in range(3)]
    rows = []
    for i in range(30):
        text = lines(rng, 10)
        if i % 3:
            text[4:4] = passages[i % 3]
        if i % 5 == 0:
            text += passages[0][:6]
        rows.append((i, rng.choice(["\n", " "]).join(text)))
    rows += [(40, rows[1][1]), (41, rows[1][1]), (42, rows[2][1].upper())]
    return rows


def test_planted_passages(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, n_removed int, id int")
    out = ld.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "id", "n_removed"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got[i] for i, _ in rows] == brute(rows, ld.BLOCK_WORDS)
    assert got[40] == got[41] == got[42] == "" and got[0] == rows[0][1]


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(40)) + ". End here."
    rows = [
        (1, None), (2, ""), (3, "..."), (4, long), (5, long), (5, long), (6, "Short. Text."), (7, "Short. Text."),
        (None, long), (None, long + " More words."), (8, "x. " * 30000 + long), (5, "own"),
    ]
    got = [(r["doc_id"], r["text"]) for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [
        (1, None), (2, ""), (3, "..."), (4, long), (5, ""), (5, ""), (6, "Short. Text."), (7, ""), (None, ""),
        (None, "More words."), (8, "x. " * 30000), (5, "own"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rare_line_is_left(spark):
    """Of the lines of 8 to 24 words that 2 to 10 documents share, only the first document keeps its own."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    before = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    after = sorted((r["doc_id"], r["text"]) for r in queries.op1_line_dedup(spark, "/root/testdata/sf0.01").collect())
    rare = rare_lines(before)

    def shared(rows):
        count = Counter()
        for own, *_ in documents_of([t for _, t in rows]):
            if len(own):
                count.update(set(ld.line_codes(own).tolist()) & known)
        return count

    known = set(rare.tolist())
    assert len(known) > 100 and max(shared(before).values()) > 1
    assert max(shared(after).values()) == 1


def test_rare_lines_bring_documents_together(spark):
    rng = random.Random(1)
    rare = "one two three four five six seven eight nine."
    short = "a short line of six words."
    rows = [(i, "\n".join([*lines(rng, 3), *([rare, short] if i in (2, 5, 7) else []), *lines(rng, 2)])) for i in range(9)]
    common = "this line is in every one of the documents here."
    rows += [(20 + i, f"{common}\nown{i} text.") for i in range(11)]
    got = {r["doc_id"]: r["text"] for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute(rows, ld.BLOCK_WORDS)
    assert rare in got[2] and short in got[2]
    assert all(rare not in got[i] and short not in got[i] for i in (5, 7))
    assert all(common in got[20 + i] for i in range(11))  # in more than ten documents: not rare


def test_clashing_columns(spark):
    names = ("_gone_id", "_gone_h", "_gone_spans", "_cut", "id", "h", "spans", "l", "owner", "rare", "run", "later", "n")
    docs = spark.createDataFrame([(i, t) for i, t in planted()], "doc_id long, text string")
    plain = {r["doc_id"]: r["text"] for r in ld.line_dedup(docs).collect()}
    for r in ld.line_dedup(docs.selectExpr("*", *[f"'odd' AS {c}" for c in names])).collect():
        assert r["text"] == plain[r["doc_id"]] and all(r[c] == "odd" for c in names)


def test_empty_table(spark):
    assert ld.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("a, b, pairs", [
    ([1, 2, 3], [1, 2, 3], [(0, 0), (1, 1), (2, 2)]),
    ([3, 1, 2], [1, 2, 3], [(1, 0), (2, 1)]),
    ([1, 1, 2], [1, 2], [(2, 1)]),
    ([], [1], []),
])
def test_patience(a, b, pairs):
    assert ld.patience(np.array(a, np.uint64), np.array(b, np.uint64)) == pairs


def test_equals_comparison_with_every_earlier_document(spark):
    """The first document of a run may have less of a block than a later, still earlier one."""
    rng = random.Random(9)
    pool = [" ".join(f"p{k}x{j}" for j in range(rng.choice([2, 5, 9, 27]))) + "." for k in range(14)]
    long, short, other = pool[0] + " more " * 30 + "end.", "Trailing words here.", "Words before it."
    rows = [(0, long), (1, "\n".join([other, long, short, "Two more."])), (2, "\n".join(["Own.", other, long, short, "Two more.", "Own too."]))]
    for i in range(3, 60):
        start = rng.randrange(len(pool))
        text = [*lines(rng, 2), *pool[start : start + rng.randrange(1, 7)], *lines(rng, 1), *rng.sample(pool, 3)]
        rows.append((i, "\n".join(text)))
    got = {r["doc_id"]: r["text"] for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute(rows, ld.BLOCK_WORDS)
    assert got[2] == "Own.\nOwn too."
