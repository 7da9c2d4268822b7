"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it is -1 modulo the block size, so
boundaries follow the content and an edit changes the chunks around it alone. Each chunk gives one
letter of a signature. A fingerprint is ``block:signature:signature at twice the block``. Block
sizes are 3 * 2**k; the first is the smallest one that gives a text of this length about 64
chunks, halved while there are fewer than 32. A signature has 64 letters at most, the last one for
all the rest of the text.

All boundaries of all block sizes come from one pass: a place is a boundary at 3 * 2**k if its hash
plus one divides by three and has k factors of two. Chunk hashes come from prefix sums.

Fingerprints are compared at block sizes that are equal or differ by two: one minus the edit
distance over the longer signature, runs of a letter shortened to three, 0 if no stretch of letters
is common. Distances of a batch are computed together, 64 letters to a word of bits. Equal fingerprints have likeness 1.

Defined results: a null text counts as empty; its fingerprint is ``3::``. Two empty texts are
alike, an empty and another one are not.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.tokens import batch_udf, mix, span_hashes, text_bytes

WINDOW = 7
LETTERS = 64
LEVELS = 28
ROWS_PER_BUCKET = 2000
MAX_BUCKETS = 20_000
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def boundary_levels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that end a chunk at some block size, and the largest k at which they do."""
    n = len(data)
    # The window of a text begins empty: its first bytes see none of the text before it.
    spaced = np.zeros(n + WINDOW * len(offsets), np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(n) + WINDOW * (owner + 1)
    spaced[place] = data
    total = np.concatenate([[0], np.cumsum(spaced, dtype=np.uint32)]).astype(np.uint32)
    plain = total[WINDOW:] - total[:-WINDOW]
    weighted = np.zeros(len(plain), np.uint32)
    shifted = np.zeros(len(plain), np.uint32)
    for k in range(WINDOW):
        part = spaced[k : k + len(plain)]
        weighted += part * np.uint32(k + 1)
        shifted ^= part << np.uint32(5 * (WINDOW - 1 - k))
    rolled = (plain + weighted + shifted)[place - WINDOW + 1].astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(rolled % np.uint64(3) == 0)
    value = rolled[at]
    lowest = value & (~value + np.uint64(1))
    return at, np.minimum(np.log2(lowest.astype(np.float64)).astype(np.int64), LEVELS - 1)


def signatures(column: pa.Array) -> pa.Array:
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    count = len(size)
    at, level = boundary_levels(data, offsets)
    owner = np.searchsorted(offsets, at, "right") - 1
    table = np.bincount(owner * LEVELS + level, minlength=count * LEVELS).reshape(count, LEVELS)
    chunks = np.cumsum(table[:, ::-1], 1)[:, ::-1] + 1
    pick = np.minimum(np.ceil(np.log2(np.maximum(size / (3 * LETTERS), 1))).astype(np.int64), LEVELS - 2)
    while True:
        few = (pick > 0) & (chunks[np.arange(count), pick] < LETTERS // 2)
        if not few.any():
            break
        pick[few] -= 1
    made = [_letters(data, offsets, at, level, owner, pick + step) for step in (0, 1)]
    return pa.array([f"{3 << k}:{a}:{b}" for k, a, b in zip(pick.tolist(), *made)], pa.string())


def _letters(data, offsets, at, level, owner, pick) -> list[str]:
    """One letter for each chunk of every text at its block size."""
    kept = level >= pick[owner]
    ends, owner = at[kept] + 1, owner[kept]
    first = np.searchsorted(owner, np.arange(len(pick) + 1))
    rank = np.arange(len(owner)) - first[owner]
    short = rank < LETTERS - 1
    ends, owner = ends[short], owner[short]
    # The rest of each text is a last chunk, if there is any.
    first = np.searchsorted(owner, np.arange(len(pick) + 1))
    last = offsets[:-1].copy()
    some = np.diff(first) > 0
    last[some] = ends[first[1:][some] - 1]
    rest = np.flatnonzero(last < offsets[1:])
    ends = np.concatenate([ends, offsets[1:][rest]])
    owner = np.concatenate([owner, rest])
    order = np.argsort(ends, kind="stable")
    ends, owner = ends[order], owner[order]
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1]
    fresh = np.ones(len(ends), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    starts[fresh] = offsets[:-1][owner[fresh]]
    letters = ALPHABET[(span_hashes(_BYTE[data], starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    first = np.searchsorted(owner, np.arange(len(pick) + 1)).tolist()
    return [letters[a:b] for a, b in zip(first[:-1], first[1:])]


def fingerprint(text: Column) -> Column:
    return batch_udf("string", signatures)(text)


_CODE = np.zeros(256, np.int64)
_CODE[ALPHABET] = np.arange(LETTERS)
_RUNS = re.compile(r"(.)\1{3,}")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of signatures as a padded table, and their lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    table = np.zeros((len(texts), LETTERS), np.int64)
    table[np.arange(LETTERS)[None, :] < size[:, None]] = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
    return table, size


def edit_distance(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Levenshtein distance of many pairs at once; a column of the table is one word of bits."""
    rows, one, zero = np.arange(len(a)), np.uint64(1), np.uint64(0)
    equal = np.zeros((len(a), LETTERS), np.uint64)
    for i in range(LETTERS):
        own = np.flatnonzero(i < a_size)
        equal[own, a[own, i]] |= one << np.uint64(i)
    last = np.where(a_size > 0, one << np.maximum(a_size - 1, 0).astype(np.uint64), zero)
    up, down = np.full(len(a), ~zero), np.zeros(len(a), np.uint64)
    score = a_size.copy()
    for j in range(int(b_size.max(initial=0))):
        live = j < b_size
        eq = equal[rows, b[:, j]]
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        rise = down | ~(across | up)
        fall = up & across
        score += live * (((rise & last) != zero).astype(np.int64) - ((fall & last) != zero))
        rise, fall = (rise << one) | one, fall << one
        up, down = np.where(live, fall | ~(vertical | rise), up), np.where(live, rise & vertical, down)
    return np.where(a_size > 0, score, b_size)


def _share_stretch(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Whether two signatures have ``stretch`` letters in a row in common."""
    out = np.zeros(len(a), bool)
    for n in np.unique(stretch).tolist():
        for low in range(0, len(own := np.flatnonzero(stretch == n)), 1000):
            part = own[low : low + 1000]
            places = LETTERS - n + 1
            x, y = (sum(t[part, k : k + places] << (6 * (n - 1 - k)) for k in range(n)) for t in (a, b))
            x = np.where(np.arange(places) + n <= a_size[part, None], x, -1)
            y = np.where(np.arange(places) + n <= b_size[part, None], y, -2)
            out[part] = (x[:, :, None] == y[:, None, :]).any((1, 2))
    return out


def alike(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of signatures of one block size."""
    (a, a_size), (b, b_size) = (_codes([_RUNS.sub(r"\1\1\1", t) for t in x]) for x in (a, b))
    shorter, longer = np.minimum(a_size, b_size), np.maximum(a_size, b_size)
    near = 1 - edit_distance(a, a_size, b, b_size) / np.maximum(longer, 1)
    # Letters agree by chance; only texts with a common stretch of chunks are compared.
    stretch = np.minimum(WINDOW, np.maximum(1, shorter // 4))
    return np.where((shorter > 0) & _share_stretch(a, a_size, b, b_size, stretch), near, 0.0)


def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    jobs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
        if x is None or y is None:
            continue
        if x == y:
            out[i] = 1.0
            continue
        (bx, *sx), (by, *sy) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        if bx == by:
            jobs += [(i, sx[0], sy[0]), (i, sx[1], sy[1])]
        elif bx == 2 * by:
            jobs.append((i, sx[0], sy[1]))
        elif by == 2 * bx:
            jobs.append((i, sx[1], sy[0]))
    if jobs:
        where, left, right = zip(*jobs)
        np.maximum.at(out, np.array(where), alike(list(left), list(right)))
    return pa.array(out)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints; 0 where their block sizes are too far apart or one is null."""
    return batch_udf("double", _likeness)(a, b)


def with_next(docs: DataFrame, id_col: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of the next one in descending id, the first after the last.

    Rows are dealt into ranges of ids, each a window of its own. Ranges are cut at approximate
    quantiles of the ids; there are 20,000 at most, so the cuts are a bounded list. The first row of
    a range also goes to the range before it, where it is the next of the last row: the table
    moves once and no range waits for another. Rows of equal ids follow each other by the hash
    of ``columns``; rows without an id come last.
    """
    found = docs.select(F.col(id_col).alias("id")).agg(F.count("id").alias("n"), F.max("id").alias("top")).first()
    parts = max(1, min(found["n"] // ROWS_PER_BUCKET, MAX_BUCKETS))
    cuts: list[int] = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        quantiles = docs.agg(F.percentile_approx(id_col, shares, 10 * parts)).first()[0]
        cuts = sorted(set(quantiles) - {found["top"]})
    heads = np.array([*cuts, *([found["top"]] if found["n"] else [])], np.int64)

    def place(ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        values = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        own = np.where(known, np.searchsorted(cuts, values) if cuts else 0, 0)
        is_head = known & (heads[own] == values) if len(heads) else ~known
        ahead = np.where(own == len(cuts), 0, own + 1)
        return pa.StructArray.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(ahead.astype(np.int32), mask=~is_head)], ["own", "ahead"]
        )

    dealt = docs.withColumn("_place", batch_udf("struct<own: int, ahead: int>", place)(F.col(id_col)))
    own = F.struct(F.col("_place.own").alias("bucket"), F.lit(0).alias("again"))
    ahead = F.struct(F.col("_place.ahead").alias("bucket"), F.lit(1).alias("again"))
    rows = dealt.withColumn("_at", F.explode(F.when(F.col("_place.ahead").isNull(), F.array(own)).otherwise(F.array(own, ahead))))
    order = Window.partitionBy("_at.bucket").orderBy("_at.again", F.desc(id_col), F.xxhash64(*columns))
    out = rows.withColumns({prefix + c: F.lead(c).over(order) for c in columns})
    return out.filter("_at.again = 0").drop("_place", "_at")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose second half is replaced by the beginning of
    the next one, and how alike they are."""
    own = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("fingerprint", fingerprint(F.col("text")))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = with_next(own, id_col, ["text", "fingerprint"]).select(
        id_col, n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint"
    )
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
