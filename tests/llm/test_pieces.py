"""Encoding and decoding against the library, and the projection to source bytes."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themeloom.llm import pieces, queries

PATH = queries.model_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)

ODD = [
    "", " ", "  ", "a", " a", "  a b ", "\n", "a\n\nb", "\t", "▁", "▁▁a", "a▁b", " ▁ ", "<s>", "</s>", "<unk>", "<0x0A>",
    "ﬁ Å 日本語 　 x", "👩‍👩‍👧 ok", "\u0000a", "﻿", "é" * 50, "12345 6.7", "x" * 3000, "the " * 500, "Á", "Ⅷ①",
    "  ​ ", "aaaaaaaaaaaaaaaaaaaaab", "\U0010ffff",
]


def ours(texts):
    own = pieces.model(PATH)
    return [np.frombuffer(x, "<u4").tolist() for x, _ in own.encode(texts)]


def test_odd_texts():
    assert ours(ODD) == [LIBRARY.encode(t) for t in ODD]
    own = pieces.model(PATH)
    for t in ODD:
        ids = LIBRARY.encode(t, add_bos=True, add_eos=True)
        assert own.decode(ids) == LIBRARY.decode(ids), repr(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(texts):
    assert ours(texts) == [LIBRARY.encode(t) for t in texts]
    own = pieces.model(PATH)
    for t in texts:
        ids = LIBRARY.encode(t, add_bos=True, add_eos=True)
        assert own.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" ab\né日▁👩Th"), max_size=60))
def test_spans_cover_the_text(text):
    own = pieces.model(PATH)
    (packed, source), = own.encode([text])
    ids = np.frombuffer(packed, "<u4")
    starts, ends = own.spans(text, ids, source)
    raw = text.encode()
    if not raw:
        return
    assert starts[0] == 0 and ends[-1] == len(raw)
    assert (starts[1:] == ends[:-1]).all() and (starts <= ends).all()
    for i, s, e in zip(ids.tolist(), starts, ends):
        if own.ids.get(own.pieces[i]) == i:
            assert raw[s:e].decode().replace(" ", "▁") in (own.pieces[i], own.pieces[i].removeprefix("▁"))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_map(rule):
    """Normalisation by a compiled map, with squeezed spaces, against the library's normaliser."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(normalizer.serialized_model_proto())
    own = object.__new__(pieces.Model)
    own.map = pieces.CharMap(spec.normalizer_spec.precompiled_charsmap)
    own.prefix, own.squeeze, own.visible = (
        spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.escape_whitespaces
    )
    texts = [*ODD, "ＡＢＣ　ｱｲｳ", "ﬃ  Ｔｏｋｙｏ ", "한글 가", "½ ℃ ㍿", "Straße İ"]
    for text in texts:
        if text.strip("\u0000 ") == "":
            continue
        got, source = own.normalise(text)
        assert got == normalizer.normalize(text), repr(text)
        assert len(source) == len(got.encode()) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_operator(spark, folder):
    frame = queries.table(spark, folder, "documents").select("doc_id", "text", F.lit(1).alias("ids"))
    extra = spark.createDataFrame([(-1, None, 1), (-2, "", 1), (-2, "", 1), (-3, "word " * 20000, 1)], frame.schema)
    rows = queries.piece_digests(frame.union(extra)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in frame.union(extra).collect()}
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
        assert r["n_source_bytes"] == len(texts[r["doc_id"]].encode())


def test_encoder_and_decoder(spark):
    """The two on their own, with spans as columns."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    made = docs.withColumn("e", pieces.encoder(PATH)(F.col("text")))
    rows = made.withColumn("back", pieces.decoder(PATH)(F.col("e.ids"))).collect()
    for r in rows:
        text = r["text"] or ""
        ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r["e"]["ids"], "<u4").tolist() == ids and r["back"] == LIBRARY.decode(ids)
        assert len(r["e"]["starts"]) == len(r["e"]["ends"]) == len(ids)
        assert r["e"]["ends"][-1] == len(text.encode())


def test_empty_table(spark):
    assert queries.piece_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
