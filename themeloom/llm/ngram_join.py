"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Steps, for pairs of texts whose sets of word n-grams have Jaccard similarity ``threshold`` or more:

1. One pass gives each text the digest of its n-gram set and its band hashes. Texts of equal sets
   are copies: they form one class with a count, and only classes go on.
2. Rows (band hash, class) are shuffled on the band hash. A bucket links its members to its
   smallest one, never to each other, so a bucket of m classes makes m - 1 links.
3. Connected components of these links hold every pair that shares a bucket.
4. Members of components get their full n-gram sets. A component is verified in blocks of bounded
   size: a large one is dealt into blocks by hash and each pair of blocks is one group. A group
   counts shared n-grams of all its pairs at once and gives back the number of links of each member and
   links to a local smallest member, so no list of all pairs exists anywhere.
5. Components of the verified links are the classes of near copies.

Band and row counts: a pair of similarity s shares a band with probability
``1 - (1 - s**rows)**bands``. The smallest number of bands that reaches ``recall`` at the threshold
is taken for the given rows; a pair at the threshold is then missed with probability
``1 - recall`` at most, a closer one far less often.

Defined results: a text without words (null, empty, symbols only) has no links and is its own
class; a text of fewer than ``n`` words has one n-gram, all its words. Rows are compared by text,
so repeated rows and repeated or null ids are rows of their own; ``class_id`` is the smallest id
of the class, null if all its ids are null.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.llm.components import components
from themeloom.llm.tokens import batch_udf, lists, mix, shingles_of, text_bytes, words_of

NGRAM = 5
THRESHOLD = 0.8
ROWS = 7
RECALL = 0.9995
BLOCK = 256
BLOCK_GRAMS = 400_000
SMALL_TABLE = 400_000

SIGNATURE = "struct<key: binary, size: bigint, bands: array<bigint>>"
SETS = "struct<key: binary, grams: array<bigint>>"


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, with offsets."""
    grams, first = shingles_of(words_of(*text_bytes(text)), n)
    parts = [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else grams, np.concatenate([[0], np.cumsum(sizes)])


def _digests(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    return [hashlib.md5(grams[a:b].tobytes()).digest() for a, b in zip(first[:-1], first[1:])]


def minhash(grams: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima for every text that has n-grams: one row per text."""
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    flip, factor = seeds[:count], seeds[count:] | np.uint64(1)
    out = np.empty((count, len(first) - 1), np.uint64)
    # Texts are taken together up to the size of a processor cache.
    at = 0
    while at < len(first) - 1:
        end = max(at + 1, int(np.searchsorted(first, first[at] + 65_536, "right")) - 1)
        own, starts = grams[first[at] : first[end]], first[at:end] - first[at]
        for k in range(count):
            out[k, at:end] = np.minimum.reduceat((own ^ flip[k]) * factor[k], starts)
        at = end
    return out.T


def _signer(n: int, bands: int, rows: int):
    def sign_slice(text: pa.Array) -> pa.Array:
        grams, first = _sets(text, n)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        minima = minhash(grams, np.concatenate([first[full], first[-1:]]), bands * rows)
        folded = np.zeros((len(full), bands), np.uint64)
        for r in range(rows):
            folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::rows])
        folded = mix(folded + np.arange(bands, dtype=np.uint64))
        width = np.zeros(len(sizes), np.int64)
        width[full] = bands
        return pa.StructArray.from_arrays(
            [
                pa.array(_digests(grams, first), pa.binary()),
                pa.array(sizes),
                lists(folded.reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(width)]), pa.int64()),
            ],
            ["key", "size", "bands"],
        )

    return batch_udf(SIGNATURE, sign_slice)


def _set_maker(n: int):
    def set_slice(text: pa.Array) -> pa.Array:
        grams, first = _sets(text, n)
        return pa.StructArray.from_arrays(
            [pa.array(_digests(grams, first), pa.binary()), lists(grams.view(np.int64), first, pa.int64())],
            ["key", "grams"],
        )

    return batch_udf(SETS, set_slice)


def shared_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Number of common entries of all pairs of sets, through slices of their incidence matrix."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1  # an n-gram of a single text adds to no pair
    column = np.cumsum(common) - 1
    keep = common[code]
    code, owner = column[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(common.sum()), width):
        a, b = np.searchsorted(code, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], code[a:b] - low] = 1
        out += part @ part.T
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; the diagonal is false."""
    if len(sets) == 2:
        shared = np.zeros((2, 2))
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        shared = shared_counts(sets)
    size = np.array([len(s) for s in sets], float)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _verifier(threshold: float):
    empty = pd.DataFrame({"key": pd.Series(dtype=object), "head": pd.Series(dtype=object), "links": pd.Series(dtype="int64")})

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in group.groupby("component", sort=False):
            own = own.drop_duplicates("key")  # a text whose row is repeated under one id
            linked = similar([np.asarray(g) for g in own["grams"]], threshold)
            low, high, block = own["low"].iloc[0], own["high"].iloc[0], own["block"].to_numpy()
            if low != high:  # pairs within a block belong to the group of that block alone
                linked &= block[:, None] != block[None, :]
            near = linked.any(1)
            if not near.any():
                continue
            # The smallest member of what is linked inside the group.
            head = np.arange(len(own))
            while True:
                lower = np.minimum(head, np.where(linked, head[None, :], len(own)).min(1))
                if (lower == head).all():
                    break
                head = lower
            keys = own["key"].to_numpy()
            out.append(
                pd.DataFrame(
                    {"key": keys[near], "head": keys[head][near], "links": (linked @ own["copies"].to_numpy())[near]}
                )
            )
        return pd.concat(out) if out else empty

    return verify


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD,
    rows: int = ROWS, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id``, ``class_rows``, ``n_links`` (rows of other
    or equal texts that reach the threshold), ``key``, the digest of its n-gram set, ``class_key``, the same for all
    rows of a class and null for a text without words, and ``text_hash``."""
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    bands = bands_for(threshold, rows, recall)
    signed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), _signer(n, bands, rows)(F.col(text)).alias("s"))
    signed = work.save(signed.select("id", "h", "s.key", "s.size", "s.bands"), "signed")
    classes = work.save(
        signed.filter("size > 0").groupBy("key").agg(
            F.min("id").alias("first_id"), F.count("*").alias("copies"), F.max("size").alias("size"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("members")).filter("members > 1")
    links = banded.join(buckets, "band").filter("key <> head").select("key", "head")
    candidates = components(links, "key", "head", work, "candidates")

    members = candidates.withColumnRenamed("node", "key").join(classes.drop("bands"), "key")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.least(F.col("total") / BLOCK_GRAMS, F.col("n")))).cast("int")
    members = work.save(
        members.join(sizes.select("component", blocks.alias("blocks")), "component").withColumn(
            "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        ),
        "members",
    )
    count = members.count()
    # Texts of members are read again. The list of members is broadcast only while it is short.
    wanted = members if count > SMALL_TABLE else F.broadcast(members)
    ids = docs.select(F.col(id_col).alias("first_id"), F.col(text).alias("text"))
    again = ids.join(wanted.withColumnRenamed("key", "wanted"), ids["first_id"].eqNullSafe(members["first_id"])).drop(members["first_id"])
    sets = again.select("*", _set_maker(n)(F.col("text")).alias("s")).filter("s.key = wanted")
    groups = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, "block").alias("low"), F.greatest(j, "block").alias("high")),
    )
    # Small components share a group, of a few thousand members on average.
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(max(1, count // 2000)))).otherwise(
        F.xxhash64("component")
    )
    dealt = sets.select(
        F.col("wanted").alias("key"), "component", "copies", "block", (F.col("blocks") == 1).alias("small"),
        F.col("s.grams").alias("grams"), F.explode(groups).alias("pair"), pack.alias("pack"),
    )
    found = work.save(
        dealt.select("*", "pair.low", "pair.high").groupBy("pack", "small", "low", "high").applyInPandas(
            _verifier(threshold), "key binary, head binary, links bigint"
        ),
        "found",
    )
    joined = components(found, "key", "head", work, "classes-of-copies")
    degree = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = joined.withColumnRenamed("node", "key").join(classes.select("key", "first_id", "copies"), "key")
    totals = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    known = classes.select("key", "first_id", "copies").join(
        named.select("key", "component").join(totals, "component").join(degree, "key"), "key", "left"
    ).select(
        F.coalesce("component", "key").alias("class_key"),
        "key", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_rows", "copies").alias("class_rows"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.lit(True).alias("known"),
    )
    return signed.select("id", "h", "size", "key").join(known, "key", "left").select(
        F.col("id").alias(id_col), F.when(F.col("known"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "key", "class_key", F.col("h").alias("text_hash"),
    )
