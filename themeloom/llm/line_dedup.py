"""Line dedup by pairwise alignment.

A line is a stretch of text up to a line break or the end of a sentence, with its words folded to
lower case. Documents are ordered by id; a block of lines that an earlier document also has is
deleted from the later one.

1. One pass stores the line hashes, word counts and places of every document.
2. Documents meet through shared rare lines: lines of ``RARE_WORDS`` words or more that 2 to ``RARE_DOCS`` rows
   have, counted over all rows. They meet also through runs: the shortest runs of lines from each line on and up to
   each line that have ``block_words`` words (or all of a document that is shorter), however many
   documents share them. A rare line or run links a document to the first one that has it, which makes at most
   three links for each line.
3. Each linked pair is aligned with patience diff: lines unique in both documents are anchors, the
   longest increasing sequence of anchors is kept, and matches grow to their equal neighbours
   line by line. Aligned blocks that hold a rare line, or of ``block_words`` words or more, are deleted from the
   later one. A rare line that the alignment leaves, as it moved or repeats, is a block of its own.

Every run of ``block_words`` words that occurs earlier in the corpus brings its document together
with the first document that has it, so no repeated block is overlooked because it is frequent.
Every line of a block that any earlier document has lies in the run from the block's first line on
or in the run up to that line, so the result is that of a comparison with every earlier document.
Runs whose lines all repeat inside one of the two documents have no unique anchor; there the run
itself, unique or not, is the anchor.

Defined results: null and empty texts stay as they are. A document that loses all its words keeps
its row with an empty text. Repeats inside one document stay. Rows of one id are not compared with
each other, so repeated rows lose the same lines. Rows without an id come after all others and
are not compared with each other either. A column named like ``removed`` is replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.llm.tokens import batch_udf, free_names, lists, mix, span_hashes, text_bytes, words_of

BLOCK_WORDS = 25
RARE_WORDS = 8
RARE_DOCS = 10

LINES = "struct<lines: array<bigint>, words: array<int>, at: array<int>, n_chars: int>"


def lines_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, word counts and first characters of all lines that have words, offsets, text lengths."""
    data, offsets = text_bytes(text)
    words = words_of(data, offsets)
    if not len(words.hash):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, np.zeros(len(offsets), np.int64), _chars(data, offsets)[1]
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    space = data == 32
    edge = data == 10
    edge[1:] |= space[1:] & stop[:-1]
    edges = np.cumsum(edge)
    # A line begins with a word that follows an edge or begins its document.
    begins = np.ones(len(words.hash), bool)
    begins[1:] = edges[words.start[1:]] > edges[words.start[:-1]]
    own = words.first[:-1]
    begins[own[own < len(begins)]] = True
    first_word = np.flatnonzero(begins)
    last_word = np.append(first_word[1:], len(words.hash))
    hashes = span_hashes(words.hash, first_word, last_word)
    chars, lengths = _chars(data, offsets)
    owner = np.searchsorted(words.first, first_word, "right") - 1
    at = chars[words.start[first_word]] - chars[offsets[owner]]
    return hashes, last_word - first_word, at, np.searchsorted(first_word, words.first), lengths


def _chars(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of characters before each byte, and of each text."""
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    return chars, np.diff(chars[offsets])


def _line_slice(text: pa.Array) -> pa.Array:
    hashes, words, at, first, lengths = lines_of(text)
    return pa.StructArray.from_arrays(
        [
            lists(hashes.view(np.int64), first, pa.int64()), lists(words, first, pa.int32()),
            lists(at, first, pa.int32()), pa.array(lengths.astype(np.int32)),
        ],
        ["lines", "words", "at", "n_chars"],
    )


def runs_of(lines: np.ndarray, words: np.ndarray, first: np.ndarray, need: int):
    """Hash, first line and end of the shortest runs of ``need`` words from every line on and up to
    every line, in order and each once. A document that is shorter is one run.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + need)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(end <= first[owner + 1])
    full = np.flatnonzero(np.diff(first))
    low, high = first[full], first[full + 1]
    short = total[high] - total[low] < need
    last = np.flatnonzero(total[1:] - need >= total[first[owner]])
    back = np.searchsorted(total, total[last + 1] - need, "right") - 1
    begins = np.concatenate([start, back, low[short]])
    stops = np.concatenate([end[start], last + 1, high[short]])
    order = np.lexsort((stops, begins))
    begins, stops = begins[order], stops[order]
    fresh = np.ones(len(begins), bool)
    fresh[1:] = (begins[1:] != begins[:-1]) | (stops[1:] != stops[:-1])
    begins, stops = begins[fresh], stops[fresh]
    return mix(span_hashes(lines, begins, stops) + (stops - begins).astype(np.uint64)) & ~np.uint64(1), begins, stops


def line_codes(lines: np.ndarray) -> np.ndarray:
    """Codes of single lines beside the even ones of runs."""
    return mix(lines) | np.uint64(1)


def _run_maker(need: int):
    def runs(lines: pa.Array, words: pa.Array) -> pa.Array:
        flat = lines.flatten().to_numpy().view(np.uint64)
        first = np.concatenate([[0], np.cumsum(lines.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        sizes = words.flatten().to_numpy().astype(np.int64)
        hashes, begins, _ = runs_of(flat, sizes, first, need)
        made = np.searchsorted(begins, first)
        long = np.flatnonzero(sizes >= RARE_WORDS)
        codes, own = line_codes(flat[long]), np.searchsorted(long, first)
        parts = [
            np.unique(np.concatenate([hashes[a:b], codes[c:d]]))
            for a, b, c, d in zip(made[:-1], made[1:], own[:-1], own[1:])
        ]
        sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return lists((np.concatenate(parts) if parts else hashes).view(np.int64), sizes, pa.int64())

    return batch_udf("array<bigint>", runs)


def patience(later: np.ndarray, earlier: np.ndarray) -> list[tuple[int, int]]:
    """Longest increasing sequence of (place, place) of the lines unique in both."""
    def unique(x):
        values, place, count = np.unique(x, return_index=True, return_counts=True)
        return values[count == 1], place[count == 1]

    a, pa_ = unique(later)
    b, pb = unique(earlier)
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    pairs = sorted(zip(pa_[ia].tolist(), pb[ib].tolist()))
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tops, y)
        before.append(ends[at - 1] if at else -1)
        tops[at : at + 1] = [y]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_lines(
    later: np.ndarray, later_words: np.ndarray, earlier: np.ndarray, earlier_words: np.ndarray, need: int,
    rare: np.ndarray = np.zeros(0, np.uint64),
) -> np.ndarray:
    """Which lines of ``later`` lie in blocks of ``need`` words, or with a line among the codes ``rare``, that ``earlier`` has too."""
    gone = np.zeros(len(later), bool)
    is_rare = np.isin(line_codes(later), rare) if len(rare) else gone.copy()
    if len(later) == len(earlier) and (later == earlier).all():
        return ~gone
    done = -1
    for i, j in patience(later, earlier):
        if i <= done:
            continue
        a = b = 0
        while i > a and j > a and later[i - a - 1] == earlier[j - a - 1]:
            a += 1
        while i + b < len(later) and j + b < len(earlier) and later[i + b] == earlier[j + b]:
            b += 1
        done = i + b - 1
        if later_words[i - a : i + b].sum() >= need or is_rare[i - a : i + b].any():
            gone[i - a : i + b] = True
    # Runs without a unique line, or moved: each is its own anchor.
    own, begins, stops = runs_of(later, later_words, np.array([0, len(later)]), need)
    known, *_ = runs_of(earlier, earlier_words, np.array([0, len(earlier)]), need)
    for k in np.flatnonzero(np.isin(own, known)):
        gone[begins[k] : stops[k]] = True
    if is_rare.any():
        gone |= is_rare & np.isin(later, earlier)
    return gone


def _aligner(need: int):
    def align(
        lines: pa.Array, words: pa.Array, at: pa.Array, n_chars: pa.Array, other: pa.Array, other_words: pa.Array, rare: pa.Array
    ) -> pa.Array:
        out = []
        for k in range(len(lines)):
            own, own_words, theirs, their_words, codes = (
                x[k].values.to_numpy() for x in (lines, words, other, other_words, rare)
            )
            gone = common_lines(own.view(np.uint64), own_words, theirs.view(np.uint64), their_words, need, codes.view(np.uint64))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            place = np.append(at[k].values.to_numpy(), n_chars[k].as_py())
            out.append([{"s": int(place[a]) if a else 0, "e": int(place[b])} for a, b in zip(edges[::2], edges[1::2])])
        return pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))

    return batch_udf("array<struct<s: int, e: int>>", align)


def _without(text: F.Column, spans: F.Column) -> F.Column:
    """``text`` without the character spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(done, span):
        kept = F.substring(text, done["at"] + 1, F.greatest(span["s"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(span["e"], done["at"]).alias("at"), F.concat(done["out"], kept).alias("out"))

    def finish(done):
        return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))

    return F.aggregate(F.array_sort(spans), start, cut, finish)


def removed_spans(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(id, h, spans) of the documents that lose lines; ``h`` is the hash of the text, spans are in
    characters and may overlap."""
    work = Workspace(docs.sparkSession, "line-dedup")
    lines = work.save(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), batch_udf(LINES, _line_slice)(F.col(text)).alias("l"))
        .select("id", "h", "l.*").filter(F.size("lines") > 0),
        "lines",
    )
    runs = lines.select("id", F.explode(_run_maker(block_words)("lines", "words")).alias("run"))
    owners = runs.groupBy("run").agg(F.min("id").alias("owner"), F.count("*").alias("n")).filter(
        f"n > 1 AND (run & 1 = 0 OR n <= {RARE_DOCS})"
    )
    # Of a pair, the codes of its rare lines: no more than the later document has lines.
    rare = F.collect_set(F.when(F.col("run").bitwiseAND(F.lit(1)) == 1, F.col("run"))).alias("rare")
    linked = runs.join(owners, "run").filter("owner IS NOT NULL AND NOT (id <=> owner)")
    pairs = work.save(linked.groupBy("id", "owner").agg(rare), "pairs")
    other = lines.select(F.col("id").alias("owner"), F.col("lines").alias("other"), F.col("words").alias("other_words"))
    keyed = pairs.select(F.col("id").alias("later"), "owner", "rare")
    met = lines.join(keyed, lines["id"].eqNullSafe(keyed["later"])).drop("later").join(other, "owner")
    spans = met.select(
        "id", "h", _aligner(block_words)("lines", "words", "at", "n_chars", "other", "other_words", "rare").alias("spans")
    )
    return spans.groupBy("id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans")).filter(F.size("spans") > 0)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, removed: str = "n_removed"
) -> DataFrame:
    """``docs`` with repeated blocks cut out of ``text`` and the number of characters cut in ``removed``."""
    gone_id, gone_h, gone_spans, new = free_names(["_gone_id", "_gone_h", "_gone_spans", "_cut"], [*docs.columns, removed])
    gone = removed_spans(docs, id_col, text, block_words).select(
        F.col("id").alias(gone_id), F.col("h").alias(gone_h), F.col("spans").alias(gone_spans)
    )
    # The spans are far smaller than the texts: a hash table of them saves sorting the texts.
    joined = docs.join(
        gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone[gone_id]) & (F.xxhash64(docs[text]) == gone[gone_h]), "left"
    )
    cut = F.when(F.col(gone_spans).isNull(), F.col(text)).otherwise(_without(F.col(text), F.col(gone_spans)))
    before = F.coalesce(F.length(text), F.lit(0))
    out = joined.withColumn(new, cut).withColumn(removed, before - F.coalesce(F.length(new), F.lit(0)))
    names = [c for c in docs.columns if c != removed]
    return out.select(*[F.col(new).alias(c) if c == text else F.col(c) for c in names], removed)
