"""Words, windows and hashes of a batch of texts as numpy arrays.

The functions run inside Arrow batches that Spark has dealt out. A batch is one byte stream with
the offsets of its texts; work goes through it in pieces of about a megabyte, so memory follows
the batch and not the number of texts, and a very long text is cut between words.

A word is a run of digits, letters A-Z and a-z (folded to lower case) and bytes from 0x80 on,
which in UTF-8 is every character outside ASCII. Word hashes are polynomial, taken from one prefix
sum over the stream: ``(P[end] - P[start]) * R**-start`` modulo 2**64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pac
from pyspark.sql import functions as F

CHUNK = 1 << 20
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit of 64-bit values over the output; one to one."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_VALUE = mix(LOWER.astype(np.uint64) + np.uint64(1))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for many spans of one stream."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(values) + 1)[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; a null text is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, with underscores before those that a column has already, in any case of letters."""
    have = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def in_slices(limit: int, make, *columns: pa.Array) -> pa.Array:
    """``make(*columns)`` over slices of about ``limit`` bytes of the first column (texts or lists), joined.

    Work arrays are many times as large as the text they come from; slices bound them whatever
    the size of Spark's batches.
    """
    first = columns[0]
    if pa.types.is_list(first.type):
        length = pac.multiply(pac.list_value_length(first), 8)
    elif pa.types.is_integer(first.type):
        length = pa.array(np.full(len(first), 8))
    else:
        length = pac.binary_length(first)
    sizes = np.cumsum(np.asarray(pac.fill_null(length, 0)))
    cuts, low = [], 0
    while low < len(first):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + limit, "right")))
        cuts.append((low, high - low))
        low = high
    if not cuts:
        return make(*columns)
    out = pa.concat_arrays([make(*[c.slice(*cut) for c in columns]) for cut in cuts])
    pa.default_memory_pool().release_unused()  # workers live on beside each other between batches
    return out


def batch_udf(kind: str, make, limit: int = SLICE):
    """Arrow UDF of type ``kind`` that runs ``make`` over slices of its columns.

    It counts as non-deterministic, so that a filter on its result doesn't evaluate it again.
    """

    def run(*columns: pa.Array) -> pa.Array:
        return in_slices(limit, make, *columns)

    return F.arrow_udf(run, kind).asNondeterministic()


class Words(NamedTuple):
    """Words in order of the stream; text ``i`` has words ``first[i]`` to ``first[i + 1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _cut(data: np.ndarray, offsets: np.ndarray, low: int, step: int) -> int:
    """End of a piece that begins at ``low`` and splits no word."""
    high = min(len(data), low + step)
    if high == len(data):
        return high
    at_text = int(offsets[np.searchsorted(offsets, high, "right") - 1])
    gaps = np.flatnonzero(~WORD[data[max(low, high - 4096) : high]])
    at_gap = max(low, high - 4096) + int(gaps[-1]) + 1 if len(gaps) else low
    cut = max(at_text, at_gap)
    return cut if cut > low else _cut(data, offsets, low, step * 2)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    parts, low = [], 0
    while low < len(data):
        high = _cut(data, offsets, low, CHUNK)
        piece = data[low:high]
        inside = WORD[piece]
        begins = np.ones(len(piece) + 1, bool)
        begins[1:-1] = ~inside[:-1]
        ends = np.ones(len(piece) + 1, bool)
        ends[:-1] = ~inside
        a, b = np.searchsorted(offsets, (low, high))
        fresh = offsets[a:b] - low
        begins[fresh] = True
        ends[fresh] = True
        start = np.flatnonzero(inside & begins[:-1])
        end = np.flatnonzero(inside & ends[1:]) + 1
        parts.append((span_hashes(_VALUE[piece], start, end), start + low, end + low))
        low = high
    if not parts:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    hashes, start, end = (np.concatenate(x) for x in zip(*parts))
    return Words(hashes, start, end, np.searchsorted(start, offsets))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries, whatever text they belong to."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_BASE)
        out += hashes[k : n + k]
    return mix(out)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every text and the offsets of each text's own.

    A text of fewer words, but not none, has one: all its words.
    """
    rolled = window_hashes(words.hash, size)
    count = np.diff(words.first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(first[-1], np.uint64)
    whole = count >= size
    owner = np.repeat(np.arange(len(count)), made)
    place = words.first[owner] + (np.arange(first[-1]) - first[owner])
    long = whole[owner]
    out[long] = rolled[place[long]]
    for i in np.flatnonzero(~whole & (count > 0)):
        a, b = words.first[i], words.first[i + 1]
        out[first[i]] = window_hashes(words.hash[a:b], b - a)[0] ^ np.uint64(b - a)
    return out, first


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values).cast(kind))
