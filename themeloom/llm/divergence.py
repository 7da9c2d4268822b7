"""How far the sources of a language differ in their words.

**Stripes.** Each task folds whole documents into a hash table from (language, term) to a stripe: the
number of documents that have the term, and its occurrences in each source. A table that has grown
to ``SPILL`` entries is given out and started anew, so a task's memory doesn't follow its input.
Stripes move once, dealt by (language, term); equal keys are added up there. A frequent term is
one stripe of each spill, whatever the number of its occurrences.

**Divergences.** Every language keeps the ``V`` terms of at least ``min_docs`` of its documents. The
smoothed share of a term in a group of ``N`` kept occurrences is the whole number
``p = 1 + floor(scale * (count + smooth) / (N + smooth * V))``. The merged stripes give out, with the
totals of their language beside them, their part of the distance of every two sources, and the terms
that a source has more often than its language. Distances are added by pairs; of the terms a
task keeps those that can be among the first ``top`` of their group. All sums are of whole numbers and exact (64 bits:
up to 9e15 occurrences in a group).

Defined results: null texts, languages and sources are empty strings. A group without terms, or a
language that keeps none, has distance rows all the same (0 if ``V`` is 0) and no term rows. A
language of one source has no distance rows. Repeated rows count as documents of their own. Equal values
are ranked by item, in order of its UTF-8 bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.lineage import Workspace

MIN_DOCS = 30
TOP = 50
SMOOTH = 5
SCALE = 1_000_000_000
SPILL = 400_000
PIECE = 1 << 22

# Fixed by the definition of a term: letters A-Z, a-z and all characters beyond ASCII, in UTF-8.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")

_STRIPE = "lang string, term string, stripe array<struct<source: string, n: bigint>>"
_PARTS = "lang string, source string, part string, item string, value bigint"


def term_counts(raw: bytes) -> Counter:
    """Terms of one text; long texts are read in pieces that end between terms."""
    raw = raw.lower()  # of bytes: A-Z only
    if len(raw) <= PIECE:
        return Counter(_TERM.findall(raw))
    counts, low = Counter(), 0
    while low < len(raw):
        gap = _GAP.search(raw, min(len(raw), low + PIECE))
        high = gap.start() if gap else len(raw)
        counts.update(_TERM.findall(raw, low, high))
        low = high
    return counts


def _given_out(stripes: dict) -> pa.RecordBatch:
    """Stripes as rows. The number of documents is the entry of a null source."""
    langs, terms, sources, counts, edges = [], [], [], [], [0]
    for lang, table in stripes.items():
        for term, (n_docs, own) in table.items():
            langs.append(lang)
            terms.append(term)
            sources.append(None)
            counts.append(n_docs)
            sources.extend(own)
            counts.extend(own.values())
            edges.append(len(sources))
    entries = pa.StructArray.from_arrays([pa.array(sources, pa.string()), pa.array(counts, pa.int64())], ["source", "n"])
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entries)],
        ["lang", "term", "stripe"],
    )


def _fold(batches):
    """Stripes of the documents of a task; the empty term has the sources of a language, terms or not."""
    stripes: dict[str, dict[bytes, list]] = {}
    held = 0
    for batch in batches:
        texts, langs, sources = (batch[name].to_pylist() for name in ("text", "lang", "source"))
        for text, lang, source in zip(texts, langs, sources):
            table = stripes.setdefault(lang, {})
            for term, n in [(b"", 0), *term_counts(text.encode()).items()]:
                stripe = table.get(term)
                if stripe is None:
                    table[term] = [1, {source: n}]
                    held += 1
                else:
                    stripe[0] += 1
                    own = stripe[1]
                    if source in own:
                        own[source] += n
                    else:
                        own[source] = n
                        held += 1
            if held >= SPILL:
                yield _given_out(stripes)
                stripes, held = {}, 0
    if stripes:
        yield _given_out(stripes)


def stripes_of(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, term, n_docs, stripe), one for each term of a language; the empty term has every source with count 0."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    spilled = rows.mapInArrow(_fold, _STRIPE).repartition("lang", "term")
    # Both groupings keep the deal by language and term: nothing moves again.
    merged = (
        spilled.select("lang", "term", F.explode("stripe").alias("e"))
        .groupBy("lang", "term", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    )
    return merged.groupBy("lang", "term").agg(
        F.sum(F.when(F.col("source").isNull(), F.col("n"))).alias("n_docs"),
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("stripe"),
    )


def shares(counts: np.ndarray, total: np.ndarray, scale: int = SCALE, smooth: int = SMOOTH) -> np.ndarray:
    """``1 + floor(scale * (counts + smooth) / total)`` by long division, three digits at a time."""
    steps, rest = divmod(len(str(scale)) - 1, 3)
    if 10 ** (3 * steps + rest) != scale:
        raise ValueError("scale must be a power of ten")
    quotient, left = np.divmod(counts + smooth, total)
    for base in [1000] * steps + [10**rest]:
        more, left = np.divmod(left * base, total)
        quotient = quotient * base + more
    return quotient + 1


def _emitter(top: int, scale: int, smooth: int):
    cells = 1 << 20

    def rows(lang, source, part, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), source.cast(pa.string()), pa.array([part] * n, pa.string()), item.cast(pa.string()), pa.array(value, pa.int64())],
            ["lang", "source", "part", "item", "value"],
        )

    def distances(lang, names, sums):
        i, j = np.nonzero(~np.eye(len(names), dtype=bool))
        return rows(lang, names.take(pa.array(i)), "pair", names.take(pa.array(j)), sums[i, j])

    def emit(batches):
        sums: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                sources = batch["groups"][int(own[0])].values  # of the language, the same in all its rows
                names, totals = sources.field("source"), sources.field("total").to_numpy()
                index = {s: k for k, s in enumerate(names.to_pylist())}
                total, lang_total = totals[None, :], totals.sum()
                step = max(1, cells // len(names))
                if lang not in sums:
                    sums[lang] = names, np.zeros((len(names), len(names)), np.int64)
                for low in range(0, len(own), step):
                    some = batch.take(pa.array(own[low : low + step]))
                    kept = some["n_kept"].to_numpy()[:, None]
                    entries = some["stripe"].flatten()
                    counts = np.zeros((len(some), len(names)), np.int64)
                    at = np.repeat(np.arange(len(some)), some["stripe"].value_lengths().to_numpy())
                    counts[at, [index[s] for s in entries.field("source").to_pylist()]] = entries.field("n").to_numpy()
                    p = shares(counts, total + smooth * kept, scale, smooth)
                    q = shares(counts.sum(1), lang_total + smooth * kept[:, 0], scale, smooth)
                    for i in range(len(names) - 1):
                        apart = np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0)
                        sums[lang][1][i, i + 1 :] += apart
                        sums[lang][1][i + 1 :, i] += apart
                    more = np.where((counts > 0) & (p > q[:, None]), p - q[:, None], 0)
                    if len(some) > top:  # what is below the value of rank ``top`` here is below it overall
                        more[more < np.partition(more, len(some) - top, 0)[len(some) - top]] = 0
                    t, s = np.nonzero(more)
                    yield rows(lang, names.take(pa.array(s)), "term", some["term"].take(pa.array(t)), more[t, s])
            if sum(x.size for _, x in sums.values()) > 4 * cells:
                for lang, (names, own_sums) in sums.items():
                    yield distances(lang, names, own_sums)
                sums = {}
        for lang, (names, own_sums) in sums.items():
            yield distances(lang, names, own_sums)

    return emit


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP, scale: int = SCALE, smooth: int = SMOOTH,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` rows for every other source of the language,
    ``term`` rows for the first ``top`` terms that the source has more often than its language."""
    work = Workspace(docs.sparkSession, "divergence")
    kept = work.save(stripes_of(docs, text, lang, source).filter((F.col("n_docs") >= min_docs) | (F.col("term") == "")), "stripes")
    terms = kept.filter("term <> ''")
    groups = kept.filter("term = ''").select("lang", F.explode("stripe.source").alias("source"))
    counted = terms.select("lang", F.explode("stripe").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    totals = groups.join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("total"))
    by_lang = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("n_kept"))
    beside = terms.join(by_lang, "lang").join(sizes, "lang").select("lang", "term", "stripe", "groups", "n_kept")
    parts = work.save(beside.mapInArrow(_emitter(top, scale, smooth), _PARTS), "parts")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    summed = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    most = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(most.select(ranked.columns))
