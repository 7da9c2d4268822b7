"""Log-probability of documents by prediction by partial matching over bytes.

A text is its words (runs of other bytes than white space, A-Z in lower case), one space between them and a line break
as its end. The model is a trie of the byte contexts of the training texts, ``DEPTH`` deep.

**Counting.** Tasks count the strings of ``DEPTH + 1`` bytes (a context and the byte after it) of all texts, and their
words, before anything moves. Shorter contexts are groupings of longer ones by their last bytes and count each longer
string once, so that a frequent passage doesn't rule them. Each level of the trie is a table (string, count), its nodes
are one more (context, count, kinds of next bytes).

**Escape and exclusion.** A byte of count ``n`` after a context of count ``N`` with ``D``
different next bytes has probability ``(n - ESCAPE) / N``; the escape to the context without its first byte has ``ESCAPE * D / N``.
There, the bytes seen after the longer context are excluded: ``N`` and ``D`` are less by what they count in the shorter one.
A node holds these sums, so a step down is a join. A byte that no context has seen gets an equal
share of the unseen bytes. Probabilities of all next bytes add up to 1.

**Code lengths.** A string has one log-probability. The strings and words that occur most often (at most ``FREQUENT`` each,
fixed bounds) are broadcast; every other one, each at most a 2^-18 of the corpus, is looked up by a
join with the rows (document, string), and the parts of a document are added up. Nothing else is broadcast or collected.

Defined results: a null or empty text is its end alone. Without training texts every byte has the same
probability. Null flags don't train. Repeated rows count each. Long texts are read in pieces that keep their
context. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.llm.tokens import batch_udf

DEPTH = 5
ESCAPE = 0.3
FREQUENT = 1 << 20
FREQUENT_WORDS = 1 << 18
LONGEST_WORD = 64  # bytes of a broadcast word
ALPHABET = 252  # bytes but for tab, vertical tab, form feed and carriage return
END = b"\n"
PIECE = 1 << 20
SPILL = 1 << 21
WORDS = 400_000

_SPACE = re.compile(rb"[ \t-\r]")
_COUNTS = "token binary, gram bigint, n bigint, n_other bigint"
_SCORED = "struct<n_tokens: bigint, n_known: bigint, base: double, score: double, grams: array<bigint>, tokens: array<binary>>"


# --- texts ---------------------------------------------------------------------------------------


def pieces_of(raw: bytes):
    """(context and bytes, words, whether it is the last) for each piece of a text; the context is ``DEPTH`` bytes."""
    context, low, begun = END * DEPTH, 0, False
    while True:
        high = len(raw)
        if high - low > PIECE:
            found = _SPACE.search(raw, low + PIECE)
            high = found.start() if found else high
        words = raw[low:high].lower().split()
        last = high == len(raw)
        own = (b" " if begun and words else b"") + b" ".join(words) + (END if last else b"")
        yield context + own, words, last
        if last:
            return
        begun = begun or bool(words)
        context = (context + own)[-DEPTH:]
        low = high


def grams(stretch: bytes) -> np.ndarray:
    """Codes of the ``DEPTH + 1`` bytes that end at each byte after the context."""
    data = np.frombuffer(stretch, np.uint8)
    code = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code <<= 8
        code |= data[k : k + len(code)]
    return code


def _batches(texts: list[str | None]):
    """Groups of pieces of about ``PIECE`` bytes: numbers of their texts, stretches and words."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for piece in pieces_of((text or "").encode()):
            held.append((k, *piece))
            size += len(piece[0])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


# --- counting ------------------------------------------------------------------------------------


class _Tally:
    """Counts of codes in two classes."""

    def __init__(self):
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray, kind: int) -> None:
        if len(codes):
            some, n = np.unique(codes, return_counts=True)
            both = np.zeros((len(some), 2), np.int64)
            both[:, kind] = n
            self.waiting.append((some, both))
            self.size += len(some)

    def fold(self) -> None:
        if self.waiting:
            codes = np.concatenate([self.codes, *[c for c, _ in self.waiting]])
            counts = np.concatenate([self.counts, *[n for _, n in self.waiting]])
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            self.codes, self.counts = codes[first], np.add.reduceat(counts, first)
            self.waiting, self.size = [], 0


def _rows(tokens: list[bytes], codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n = len(tokens)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(tokens + [None] * len(codes), pa.binary()),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(codes, pa.int64())]),
            pa.array(counts[:, 0]), pa.array(counts[:, 1]),
        ],
        ["token", "gram", "n", "n_other"],
    )


def _count_task(batches):
    """Words and strings of the texts of a task with their occurrences in training texts and others."""
    tally, words = _Tally(), (Counter(), Counter())

    def word_rows():
        names = list(words[0].keys() | words[1].keys())
        counts = np.array([(words[0][w], words[1][w]) for w in names], np.int64).reshape(-1, 2)
        for own in words:
            own.clear()
        return _rows(names, np.zeros(0, np.int64), counts)

    def gram_rows():
        tally.fold()
        out = _rows([], tally.codes, tally.counts)
        tally.codes, tally.counts = tally.codes[:0], tally.counts[:0]
        return out

    for batch in batches:
        trains = batch["trains"].to_pylist()
        for held in _batches(batch["text"].to_pylist()):
            for kind in (0, 1):
                own = [x for x in held if (0 if trains[x[0]] else 1) == kind]
                tally.add(np.concatenate([np.zeros(0, np.int64), *[grams(x[1]) for x in own]]), kind)
                for _, _, found, last in own:
                    words[kind].update(found)
                    if last:
                        words[kind][END] += 1
            if tally.size > SPILL:
                tally.fold()
                if len(tally.codes) > SPILL:
                    yield gram_rows()
            if len(words[0]) + len(words[1]) > WORDS:
                yield word_rows()
    yield gram_rows()
    yield word_rows()


def count_corpus(docs: DataFrame, trains: Column, text: str = "text") -> DataFrame:
    """Rows (token, gram, n, n_other): occurrences in training texts and in others, of a word or of a string."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    counted = rows.mapInArrow(_count_task, _COUNTS)
    return counted.groupBy("token", "gram").agg(F.sum("n").alias("n"), F.sum("n_other").alias("n_other"))


# --- the trie as tables --------------------------------------------------------------------------


def _last_bytes(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


class Trie(NamedTuple):
    """``levels[k]`` has rows (gram, n) of strings of ``k + 1`` bytes, ``nodes[k]`` rows (context, total, kinds, below):
    count of a context of ``k`` bytes, its different next bytes, and what these count in the context without its first byte."""

    levels: list[DataFrame]
    nodes: list[DataFrame]


def build_trie(strings: DataFrame, work: Workspace) -> Trie:
    levels = [strings.filter("n > 0").select("gram", "n")]
    for k in range(DEPTH, 0, -1):
        shorter = levels[-1].groupBy(_last_bytes(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        levels.append(work.save(shorter, f"level-{k - 1}"))
    levels = levels[::-1]
    nodes = []
    for k, level in enumerate(levels):
        rows = level.select(_context(F.col("gram")).alias("context"), "n", _last_bytes(F.col("gram"), k).alias("shorter"))
        if k:
            low = levels[k - 1].select(F.col("gram").alias("shorter"), F.col("n").alias("low"))
            rows = rows.join(low, "shorter")
        else:
            rows = rows.withColumn("low", F.lit(0).cast("long"))
        node = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("low").alias("below"))
        nodes.append(work.save(node, f"nodes-{k}"))
    return Trie(levels, nodes)


def string_costs(strings: DataFrame, trie: Trie, work: Workspace) -> DataFrame:
    """Rows (gram, seen, cost): the log10 probability of the last byte after the others, of every string of the corpus."""
    open_ = strings.select(
        "gram", F.expr("n + n_other").alias("seen"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_kinds")
    )
    done = []
    for k in range(DEPTH, -1, -1):
        own = F.col("gram") if k == DEPTH else _last_bytes(F.col("gram"), k + 1)
        keyed = open_.withColumn("own", own).withColumn("context", _context(own))
        level = trie.levels[k].select(F.col("gram").alias("own"), "n")
        found = keyed.join(level, "own", "left").join(trie.nodes[k], "context", "left")
        left = F.coalesce("total", F.lit(0)) - F.col("gone")
        kinds = F.coalesce("kinds", F.lit(0)) - F.col("gone_kinds")
        step = F.when(F.col("n").isNotNull(), F.log10((F.col("n") - ESCAPE) / left)).when(left > 0, F.log10(ESCAPE * kinds / left)).otherwise(0.0)
        walked = work.save(
            found.select(
                "gram", "seen", (F.col("cost") + step).alias("cost"), F.col("n").isNotNull().alias("found"),
                F.coalesce("below", F.lit(0)).alias("gone"), F.coalesce("kinds", F.lit(0)).alias("gone_kinds"),
            ),
            f"walk-{k}",
        )
        done.append(walked.filter("found").select("gram", "seen", "cost"))
        open_ = walked.filter("NOT found").drop("found")
    done.append(open_.select("gram", "seen", (F.col("cost") - F.log10(F.lit(float(ALPHABET)) - F.col("gone_kinds"))).alias("cost")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# --- scores --------------------------------------------------------------------------------------


def _least_seen(rows: DataFrame, limit: int) -> int:
    """The least number of occurrences that at most ``limit`` rows reach, up to a step of an eighth of a power of two."""
    step = F.floor(F.log2("seen") * 8).cast("int")
    found = sorted(rows.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    total, least = 0, None
    for r in found:
        total += r["count"]
        if total > limit:
            break
        least = r["step"]
    return 1 << 62 if least is None else int(np.ceil(2 ** (least / 8) - 1e-9))


class Codes:
    """Values of 64-bit codes: a hash table of one code a slot, a sorted one for those that found theirs taken."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(codes)).bit_length())
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot = self._slot(codes)
        self.slots[slot[::-1]] = codes[::-1]  # of equal slots the first one stays
        own = self.slots[slot] == codes
        self.values[slot[own]] = values[own]
        order = np.argsort(codes[~own])
        self.rest, self.rest_values = codes[~own][order], values[~own][order]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether the codes are held."""
        slot = self._slot(codes)
        held = self.slots[slot]
        hit = held == codes
        value = np.where(hit, self.values[slot], 0.0)
        other = np.flatnonzero(~hit & (held != -1))
        if len(other) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, codes[other]), len(self.rest) - 1)
            same = self.rest[at] == codes[other]
            hit[other[same]] = True
            value[other[same]] = self.rest_values[at[same]]
        return value, hit


_tables: dict[int, tuple] = {}


def _table(shared):
    """Lookups of a broadcast, built once in a worker."""
    if shared.id not in _tables:
        codes, costs, words, counts, n, v = shared.value
        base = dict(zip(words.to_pylist(), zip(np.log10((counts + 1) / (n + v + 1)).tolist(), (counts > 0).tolist())))
        _tables.clear()
        _tables[shared.id] = Codes(codes, costs), base
    return _tables[shared.id]


class _Shared(NamedTuple):
    """A broadcast value under a name of its own."""

    id: str
    broadcast: object

    @property
    def value(self):
        return self.broadcast.value


def _score_udf(shared: _Shared):
    def make(column: pa.Array) -> pa.Array:
        strings, base_of = _table(shared)
        texts = column.to_pylist()
        n = len(texts)
        n_tokens, n_known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        rare, rare_of, rare_tokens = [], [], [[] for _ in range(n)]
        for held in _batches(texts):
            codes = [grams(x[1]) for x in held]
            of = np.repeat([x[0] for x in held], [len(c) for c in codes])
            codes = np.concatenate(codes)
            value, found = strings.find(codes)
            score += np.bincount(of, value, n)
            rare.append(codes[~found])
            rare_of.append(of[~found])
            for k, _, words, last in held:
                if last:
                    words.append(END)
                n_tokens[k] += len(words)
                costs = [base_of.get(w) for w in words]
                if None in costs:
                    rare_tokens[k] += [w for w, c in zip(words, costs) if c is None]
                    costs = [c for c in costs if c is not None]
                base[k] += sum(c[0] for c in costs)
                n_known[k] += sum(c[1] for c in costs)
        edges = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([np.zeros(0, np.int64), *rare_of]), minlength=n))])
        rare = np.concatenate([np.zeros(0, np.int64), *rare])  # pieces come in order of their texts
        return pa.StructArray.from_arrays(
            [
                pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score),
                pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(rare)), pa.array(rare_tokens, pa.list_(pa.binary())),
            ],
            ["n_tokens", "n_known", "base", "score", "grams", "tokens"],
        )

    return batch_udf(_SCORED, make)


def score_documents(
    docs: DataFrame, trains: Column, text: str = "text", keep: list[str] | None = None, into: str = "lm",
    frequent: int = FREQUENT, frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """The columns ``keep`` (all) of every row and a struct ``into``.

    ``n_tokens``, ``n_known`` (words that training texts have), ``train_tokens``, ``base_score`` (log10 probability by word
    counts plus one) and ``score`` (by the trie). Rows for which ``trains`` is true are learned from.
    """
    keep = docs.columns if keep is None else keep
    if into.lower() in [c.lower() for c in keep]:
        raise ValueError(f"the documents have a column {into!r}")
    spark = docs.sparkSession
    work = Workspace(spark, "ppm")
    counts = work.save(count_corpus(docs, trains, text), "counts")
    tokens = counts.filter("token IS NOT NULL").select("token", "n", F.expr("n + n_other").alias("seen"))
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    strings = counts.filter("gram IS NOT NULL").select("gram", "n", "n_other")
    costs = work.save(string_costs(strings, build_trie(strings, work), work), "costs")

    # Tables of bounded size: at most so many entries, of at most so many bytes.
    short = tokens.filter(F.octet_length("token") <= LONGEST_WORD)
    least, least_word = _least_seen(costs, frequent), _least_seen(short, frequent_words)
    top = costs.filter(F.col("seen") >= least).select("gram", "cost", "seen").toArrow().sort_by([("seen", "descending"), ("gram", "ascending")])
    top_words = short.filter(F.col("seen") >= least_word).select("token", "n").toArrow()
    shared = _Shared(work.root, spark.sparkContext.broadcast((
        top["gram"].to_numpy(), top["cost"].to_numpy(), top_words["token"].combine_chunks(), top_words["n"].to_numpy(), total["n"], total["v"],
    )))
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _score_udf(shared)(F.col(text).cast("string")).alias("own"))
    held = work.save(made.select(F.monotonically_increasing_id().alias("id"), "row", "own"), "parts")

    # What the broadcast tables don't have. The numbers of the rows are stored with them, so they stay.
    rare_cost = costs.filter(F.col("seen") < least).select("gram", "cost")
    by_string = held.select("id", F.explode("own.grams").alias("gram")).join(rare_cost, "gram").select("id", F.col("cost").alias("score"), F.lit(0.0).alias("base"), F.lit(0).alias("known"))
    rare_word = tokens.filter((F.col("seen") < least_word) | (F.octet_length("token") > LONGEST_WORD)).filter("n > 0").select("token", "n")
    n = F.coalesce("n", F.lit(0))
    by_word = held.select("id", F.explode("own.tokens").alias("token")).join(rare_word, "token", "left").select(
        "id", F.lit(0.0).alias("score"), F.log10((n + 1) / F.lit(float(total["n"] + total["v"] + 1))).alias("base"), (n > 0).cast("int").alias("known")
    )
    more = by_string.unionByName(by_word).groupBy("id").agg(F.sum("score").alias("score"), F.sum("base").alias("base"), F.sum("known").alias("known"))
    both = held.select("id", "row", *[F.col(f"own.{f}").alias(f"own_{f}") for f in ("n_tokens", "n_known", "base", "score")]).join(more, "id", "left")

    def with_more(own: str, other: str) -> Column:
        return F.col(own) + F.coalesce(other, F.lit(0))

    result = F.struct(
        F.col("own_n_tokens").alias("n_tokens"), with_more("own_n_known", "known").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        with_more("own_base", "base").alias("base_score"), with_more("own_score", "score").alias("score"),
    )
    return both.select("row", result.alias("own")).select("row.*", F.col("own").alias(into))
