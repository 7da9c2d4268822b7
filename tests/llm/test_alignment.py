"""Alignment of two tokenizers against whole-text encodings by the libraries and plain loops."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm import alignment, queries

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n  b\t c ", "x▁y", "▁", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café – “quotes” 你好 世界 🙂🙃",
    "it's we'll 's  't", "tab\tand nbsp  em \x1c sep \x85 next", "\x00\x01 nul", "a" * 3000, "trailing   ", "\n", "é combining", "1234567 12.5% $$$", "mixed▁ mark here", "\r\n dos\r\n  lines",
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in keep}
    table.update({chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in keep)})
    assert len(table) == 256
    vocab = {i: t for t, i in json.load(open(PATH_A))["model"]["vocab"].items()}
    raw_a = {i: bytes(table[c] for c in t) for i, t in vocab.items() if all(c in table for c in t)}

    def raw_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return a, b, raw_a, [raw_b(i) for i in range(b.get_piece_size())]


def brute(texts, tools):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text."""
    a, b, raw_a, raw_b = tools
    made, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(raw_a[i] for i in ids_a) != raw or b"".join(raw_b[i] for i in ids_b) != raw:
            ids_a = ids_b = []
        ends_a, ends_b, at = [], [], 0
        for i in ids_a:
            ends_a.append(at := at + len(raw_a[i]))
        at = 0
        for i in ids_b:
            ends_b.append(at := at + len(raw_b[i]))
        groups, links, x, y = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append(",".join(map(str, ids_a[x:p])) + "|" + ",".join(map(str, ids_b[y:q])))
            links.append((ids_a[p - 1], ids_b[q - 1]))
            x, y = p, q
        counts.update(links)
        made.append((len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), ";".join(groups))
        for n_a, n_b, groups, links in made
    ], counts


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_odd_texts(spark, tools):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(0, "a  b")], "doc_id long, text string").repartition(3)
    found = alignment.align_documents(docs, PATH_A, PATH_B).collect()
    expected, _ = brute([r.text for r in found], tools)
    for row, own in zip(found, expected):
        assert tuple(row.aligned[f] for f in FIELDS) == own, row.text


def test_query(spark, folder, tools):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op11_alignment(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    expected, _ = brute([docs[r.doc_id] for r in found], tools)
    for row, own in zip(found, expected):
        digest = hashlib.sha256(own[-1].encode()).hexdigest() if own[0] else ""
        assert tuple(row[f] for f in FIELDS[:-1]) + (row.groups_sha256,) == own[:-1] + (digest,)


def test_cuts_change_nothing(tools, monkeypatch):
    """Remembered cuts, small calls and forgotten generations give what whole texts give."""
    texts = [t for t in ODD if t] + ["the same words the same words again " * 20, "w " * 500]
    expected, _ = brute(texts, tools)
    monkeypatch.setattr(alignment, "CALL", 10)
    monkeypatch.setattr(alignment, "MEMORY", 5)
    own = alignment.Aligner(PATH_A, PATH_B)
    for _ in range(3):
        assert [r[2] for r in own.align(texts)] == [e[-1] for e in expected]
    own.cuts = False
    own._new, own._old = {}, {}
    assert [r[2] for r in own.align(texts)] == [e[-1] for e in expected]


def test_long_texts(tools):
    texts = ["word " * 60_000 + "Ende", "x1" * 60_000, "naïve\n" * 20_000]
    expected = []
    for t in texts:
        a, b, raw_a, raw_b = tools
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        expected.append((len(ids_a), len(ids_b)))
    own = alignment.Aligner(PATH_A, PATH_B)
    assert [r[:2] for r in own.align(texts)] == expected


def test_links_within_the_bound(spark, folder, tools):
    own = alignment.aligner(PATH_A, PATH_B)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    made = docs.select(own_alignment().alias("own"))
    counts = alignment.link_counts(made, made["own.links"], own.n_b).collect()
    _, expected = brute([r.text for r in docs.collect()], tools)
    assert {(r.a, r.b): r.n for r in counts} == dict(expected)
    for r in counts:
        x, y = own.bytes_a[r.a], own.bytes_b[r.b]
        assert x.endswith(y) or y.endswith(x)
    assert len(counts) <= own.link_bound() < 1_000_000


def own_alignment():
    return alignment.aligned(PATH_A, PATH_B)(F.col("text"))


def test_groups_and_links_as_arrays(spark):
    docs = spark.createDataFrame([("a  b naïve",), (None,)], "text string")
    made = docs.select("text", own_alignment().alias("own"))
    n_b = alignment.aligner(PATH_A, PATH_B).n_b
    rows = made.select("text", "own.groups", alignment.as_groups(made["own.groups"]).alias("g"), alignment.as_links(made["own.links"], n_b).alias("l")).collect()
    full = next(r for r in rows if r.text)
    assert ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in full.g) == full.groups
    assert [(x.a, x.b) for x in full.l] == [(g.a[-1], g.b[-1]) for g in full.g]
    empty = next(r for r in rows if not r.text)
    assert empty.g == [] and empty.l == []


def test_clashes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, own int, row int, links int")
    row = alignment.align_documents(docs, PATH_A, PATH_B).first()
    assert (row.own, row.row, row.links, row.aligned.n_groups) == (5, 6, 7, 2)
    with pytest.raises(ValueError):
        alignment.align_documents(docs.withColumnRenamed("own", "aligned"), PATH_A, PATH_B)
    assert alignment.align_documents(docs.limit(0), PATH_A, PATH_B).count() == 0
