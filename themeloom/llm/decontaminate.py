"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, exact hits.

Every window of ``n`` consecutive words of a test item is hashed; an item of fewer words, but not
none, is one window. The sorted hashes go to the executors, training texts are scanned for them
in one pass without a shuffle, and every hit is verified word for word against the item.

The index holds about 30 bytes for each window. What is broadcast at once is bounded by
``shard_bytes`` of test text: beyond it the items are dealt into shards by hash, and each shard is
one more pass over a stored table, so memory stays bounded and no item is left out.

Defined results: a null or empty text has no words and no hits. Repeated items count once by their
id; items of equal text are all reported. A null item id is reported as ``null``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.llm.tokens import LOWER, Words, batch_udf, free_names, text_bytes, window_hashes, words_of

WINDOW = 13
SHARD_BYTES = 32 << 20

HITS = "struct<n_words: bigint, starts: array<int>, ends: array<int>, items: array<string>>"


class Index(NamedTuple):
    """Windows by length: sorted hashes, and for each its item and place in ``stream``."""

    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    items: list[str]
    stream: bytes


def normal_words(data: np.ndarray, words: Words, a: int, b: int) -> list[bytes]:
    text = LOWER[data[words.start[a] : words.end[b - 1]]].tobytes()
    base = words.start[a]
    return [text[s:e] for s, e in zip((words.start[a:b] - base).tolist(), (words.end[a:b] - base).tolist())]


def build_index(ids: list[str], texts: list[str | None], n: int) -> Index:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = words_of(data, offsets)
    stream, found, at = bytearray(), {}, 0
    for i in range(len(ids)):
        a, b = words.first[i], words.first[i + 1]
        if a == b:
            continue
        own = normal_words(data, words, a, b)
        size = min(n, len(own))
        ends = np.cumsum([len(w) + 1 for w in own]) + at - 1
        starts = ends - np.array([len(w) for w in own])
        hashes = window_hashes(words.hash[a:b], size)
        k = len(hashes)
        found.setdefault(size, []).append((hashes, np.full(k, i), starts[:k], ends[size - 1 :]))
        stream += b" ".join(own) + b" "
        at = len(stream)
    windows = {}
    for size, parts in found.items():
        columns = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")
        windows[size] = tuple(c[order] for c in columns)
    return Index(windows, ids, bytes(stream))


def scan(column: pa.Array, index: Index) -> list[tuple[int, list[int], list[int], list[str]]]:
    """Per text: its number of words, the hit word spans (merged) and the items that occur."""
    data, offsets = text_bytes(column)
    words = words_of(data, offsets)
    owner = words.text_of()
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for size, (known, *_) in index.windows.items():
        rolled = window_hashes(words.hash, size)
        if not len(rolled):
            continue
        where = np.searchsorted(known, rolled)
        where[where == len(known)] = 0
        same = np.flatnonzero((known[where] == rolled) & (owner[: len(rolled)] == owner[size - 1 :]))
        for place, entry in zip(same.tolist(), where[same].tolist()):
            hits.setdefault(int(owner[place]), []).append((place, size, entry))
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(words.first[i]), int(words.first[i + 1])
        spans, items = [], set()
        if i in hits:
            own = normal_words(data, words, a, b)
            seen: dict[bytes, bool] = {}
            for place, size, entry in sorted(hits[i]):
                text = b" ".join(own[place - a : place - a + size])
                if text not in seen:
                    known, item, start, end = index.windows[size]
                    seen[text] = False
                    last = int(np.searchsorted(known, known[entry], "right"))
                    for e in range(entry, last):
                        if index.stream[start[e] : end[e]] == text:
                            seen[text] = True
                            items.add(index.items[item[e]])
                if seen[text]:
                    low, high = place - a, place - a + size
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
        out.append((b - a, [s for s, _ in spans], [e for _, e in spans], sorted(items)))
    return out


def _scanner(broadcast):
    def slice_hits(text: pa.Array) -> pa.Array:
        n, starts, ends, items = zip(*scan(text, broadcast.value)) if len(text) else ((), (), (), ())
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "starts", "ends", "items"],
        )

    return batch_udf(HITS, slice_hits)


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = WINDOW, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with ``hits``: number of words, hit word spans (end exclusive) and item ids.

    A column ``hits`` of the input is replaced; all others pass through.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    labelled = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text")
    )
    work = Workspace(spark, "decontaminate") if shards > 1 else None
    out, parts = docs, free_names([f"_hits_{k}" for k in range(shards)], docs.columns)
    for k in range(shards):
        part = labelled if shards == 1 else labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k)
        rows = part.toArrow()
        index = build_index(rows["id"].to_pylist(), rows["text"].to_pylist(), n)
        found = _scanner(spark.sparkContext.broadcast(index))(F.col(text))
        if shards == 1:
            return out.withColumn("hits", found)
        out = work.save(out.withColumn(parts[k], found), f"shard-{k}")
    return out.withColumn("hits", _union([F.col(x) for x in parts])).drop(*parts)


def _join_spans(starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = []
    for s, e in zip(starts.to_pylist(), ends.to_pylist()):
        spans: list[list[int]] = []
        for low, high in sorted(zip(s, e)):
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        rows.append({"starts": [x for x, _ in spans], "ends": [x for _, x in spans]})
    return pa.array(rows, pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))


def _union(parts: list) -> F.Column:
    join = batch_udf("struct<starts: array<int>, ends: array<int>>", _join_spans)
    spans = join(F.concat(*[p["starts"] for p in parts]), F.concat(*[p["ends"] for p in parts]))
    items = F.array_sort(F.array_distinct(F.concat(*[p["items"] for p in parts])))
    return F.struct(parts[0]["n_words"].alias("n_words"), spans["starts"].alias("starts"), spans["ends"].alias("ends"), items.alias("items"))


def n_hit(hits: F.Column) -> F.Column:
    """Number of words inside any hit."""
    lengths = F.zip_with(hits["starts"], hits["ends"], lambda s, e: (e - s).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x)


def contaminated(hits: F.Column, share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (n_hit(hits) > 0) & (n_hit(hits) * share >= hits["n_words"])


def _cut_slice(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    data, offsets = text_bytes(text)
    words = words_of(data, offsets)
    raw, out = data.tobytes(), []
    for i, (s, e) in enumerate(zip(starts.to_pylist(), ends.to_pylist())):
        at, kept = int(offsets[i]), []
        for low, high in zip(s or (), e or ()):
            kept.append(raw[at : words.start[words.first[i] + low]])
            at = int(words.end[words.first[i] + high - 1])
        out.append(b"".join([*kept, raw[at : offsets[i + 1]]]).decode())
    return pa.array(out, pa.string(), mask=np.asarray(text.is_null()))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = WINDOW, share: int = 20, remove: str = "documents", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Removes contaminated ``documents``, or the hit ``spans`` of all of them; same columns as ``docs``."""
    found = find_hits(docs, benchmark, text, item, item_text, n, shard_bytes)
    if remove == "documents":
        return found.filter(~contaminated(F.col("hits"), share)).select(docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cut = batch_udf("string", _cut_slice)(F.col(text), F.col("hits.starts"), F.col("hits.ends"))
    return found.withColumn(text, F.when(F.size("hits.starts") > 0, cut).otherwise(F.col(text))).select(docs.columns)
