"""Quality classifier: text evidence combined with host and path posteriors by empirical Bayes.

**Evidence.** Two logistic models give the log-odds that a text is of low quality and that it is
toxic, from its format (shares of character classes, repeated words, word lengths) and from the
words whose use differs between labels. They are fitted on at most ``sample`` labelled rows,
chosen by a hash of the id: word weights on one half, the models on the other, so that words which
differ by chance gain no weight.

**Sites.** Every row gives its site a soft count, the probability that its text is good.
Grouped sums over all rows make a hierarchy global -> host -> path. At each level the strength of
the prior is the beta-binomial moment estimate from the spread between groups, so a sparse site
shrinks towards its parent and a site like all others moves nothing.

**Decision.** ``logit(text) + logit(path posterior) - logit(global)``; rows at or above ``keep_at`` stay.

Defined results: a null text counts as empty. A null host or path is a site of its own. Labels of
a repeated id count once, the worst of them; without labels of both kinds a model gives even odds for
all. Tables may be empty.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.llm.tokens import WORD, batch_udf, lists, text_bytes, words_of

SAMPLE = 20_000
LEXICON = 20_000
SIGNIFICANT = 4.5
SMALL_TABLE = 200_000

CLASSES = (
    np.isin(np.arange(256), np.arange(65, 91)),  # capital letters
    np.isin(np.arange(256), np.arange(48, 58)),
    np.isin(np.arange(256), np.frombuffer(b"|<>{}[]=_/\\", np.uint8)),
    np.isin(np.arange(256), np.frombuffer(b"*#$%&@^~", np.uint8)),
    np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8)),
    np.isin(np.arange(256), np.frombuffer(b".,;:'\"()-", np.uint8)),
    np.arange(256) == 10,
    WORD,
)


class Evidence(NamedTuple):
    """A fitted text model: word weights, and mean, scale and weights of the features."""

    words: np.ndarray
    weight: np.ndarray  # one column for each of low quality, toxic
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray  # one row for each, the intercept first


def format_features(text: pa.Array):
    """A row of numbers for each text, and the words they came from."""
    data, offsets = text_bytes(text)
    words = words_of(data, offsets)
    size = np.maximum(np.diff(offsets), 1)
    columns = [_sums(kind[data], offsets) / size for kind in CLASSES]
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    length = words.end - words.start
    columns.append(_sums(length, words.first) / some)
    owner = words.text_of()
    for step in (1, 2):
        same = np.zeros(len(words.hash), bool)
        same[step:] = (words.hash[step:] == words.hash[:-step]) & (owner[step:] == owner[:-step])
        columns.append(_sums(same, words.first) / some)
    order = np.lexsort((words.hash, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=len(count))
    columns += [distinct / some, distinct / np.sqrt(some), np.log1p(count)]
    return np.stack(columns, 1) if len(count) else np.zeros((0, len(CLASSES) + 6)), words, owner


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def word_features(words, owner: np.ndarray, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Strongest and mean weight of the known words of each text, for both labels."""
    n = len(words.first) - 1
    out = np.zeros((n, 4))
    if len(known) and len(words.hash):
        where = np.searchsorted(known, words.hash)
        where[where == len(known)] = 0
        hit = np.flatnonzero(known[where] == words.hash)
        some = np.maximum(np.diff(words.first), 1)
        for k in range(2):
            own = weight[where[hit], k]
            best = np.zeros(n)
            np.maximum.at(best, owner[hit], own)
            out[:, 2 * k] = best
            out[:, 2 * k + 1] = np.bincount(owner[hit], own, minlength=n) / np.sqrt(some)
    return out


def _distinct_words(text: pa.Array) -> pa.Array:
    words = words_of(*text_bytes(text))
    parts = [np.unique(words.hash[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return lists((np.concatenate(parts) if parts else words.hash).view(np.int64), first, pa.int64())


def _featurer(known: np.ndarray, weight: np.ndarray):
    def make(text: pa.Array) -> pa.Array:
        rows, words, owner = format_features(text)
        rows = np.concatenate([rows, word_features(words, owner, known, weight)], 1)
        return lists(rows.reshape(-1), np.arange(len(rows) + 1) * rows.shape[1], pa.float64())

    return batch_udf("array<double>", make)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; intercept first, not penalised."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_evidence(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality",
    toxic: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON,
) -> Evidence:
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(1 - F.col(quality)).cast("double").alias("low"), F.max(toxic).cast("double").alias("toxic")
    ).filter("low IS NOT NULL AND toxic IS NOT NULL")
    share = min(1.0, sample / max(1, marks.count()))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    chosen = marks.filter(place < int(share * (1 << 20))).withColumn("half", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")

    first = rows.filter("half = 0")
    totals = first.agg(F.count("*"), F.sum("low"), F.sum("toxic")).first()
    n, marked = totals[0], np.array([totals[1] or 0, totals[2] or 0], float)
    known, weight = np.zeros(0, np.uint64), np.zeros((0, 2))
    if n:
        counts = first.select("low", "toxic", F.explode(batch_udf("array<bigint>", _distinct_words)("text")).alias("w")).groupBy("w").agg(
            F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")
        )
        scores = [F.when(F.lit(m <= 0), 0.0).otherwise(
            (F.col(c) - F.col("n") * m / n) / F.sqrt(F.col("n") * (max(m, 1) / n) * (1 - min(m, n - 1) / n) + 0.25)
        ) for c, m in zip(("low", "toxic"), marked)]
        kept = counts.filter("n >= 4").withColumn("z", F.greatest(*scores)).filter(F.col("z") >= SIGNIFICANT)
        kept = kept.orderBy(F.desc("z"), "w").limit(lexicon).toArrow()
        known = kept["w"].to_numpy().astype(np.int64).view(np.uint64)
        times = kept["n"].to_numpy().astype(float)
        weight = np.zeros((len(known), 2))
        for k, c in enumerate(("low", "toxic")):
            hit = kept[c].to_numpy()
            inside = (hit + 0.5) / (times + 1)
            outside = (marked[k] - hit + 0.5) / (n - times + 1)
            weight[:, k] = np.clip(np.log(inside / (1 - inside)) - np.log(outside / (1 - outside)), 0, 8)
        order = np.argsort(known)
        known, weight = known[order], weight[order]
    second = rows.filter("half = 1").select("low", "toxic", _featurer(known, weight)("text").alias("x")).toArrow()
    width = len(CLASSES) + 10
    if not len(second):
        return Evidence(known, weight, np.zeros(width), np.ones(width), np.zeros((2, width + 1)))
    x = np.array(second["x"].to_pylist())
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    coef = []
    for c in ("low", "toxic"):
        y = second[c].to_numpy()
        coef.append(fit_logistic(z, y) if 0 < y.sum() < len(y) else np.append(0.0, np.zeros(width)))
    return Evidence(known, weight, mean, scale, np.array(coef))


def evidence_of(model: Evidence, spark):
    """Arrow UDF from a text to the probabilities of low quality and of being toxic."""
    shared = spark.sparkContext.broadcast(model)

    def make(text: pa.Array) -> pa.Array:
        own = shared.value
        rows, words, owner = format_features(text)
        rows = np.concatenate([rows, word_features(words, owner, own.words, own.weight)], 1)
        z = np.clip((rows - own.mean) / own.scale, -8, 8)
        p = 1 / (1 + np.exp(-np.clip(own.coef[:, :1] + own.coef[:, 1:] @ z.T, -30, 30)))
        return pa.StructArray.from_arrays([pa.array(p[0]), pa.array(p[1])], ["low", "toxic"])

    return batch_udf("struct<low: double, toxic: double>", make)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength of a level: beta-binomial moments over its groups."""
    found = groups.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("between"),
        F.avg(mean * (1 - mean)).alias("within"),
    ).first()
    spread = found["n"] - found["nn"] / found["n"] if found["g"] else 0
    if spread <= 0:
        return 1e9
    tau = (found["between"] - (found["g"] - 1) * found["within"]) / spread
    return min(1e9, max(1.0, found["within"] / max(tau, 1e-9) - 1))


def site_posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, global, host_p, path_p) from rows (host, path, p); p is a soft count."""
    work = Workspace(rows.sparkSession, "sites")
    paths = work.save(
        rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("k")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = hosts.agg(F.sum("n"), F.sum("k")).first()
    mean = F.lit(((whole[1] or 0) + 1) / ((whole[0] or 0) + 2))
    strength = F.lit(_strength(hosts, mean))
    hosts = hosts.select(
        F.col("host").alias("_host"), mean.alias("global"), ((F.col("k") + strength * mean) / (F.col("n") + strength)).alias("host_p")
    )
    paths = work.save(paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])).drop("_host"), "under-hosts")
    strength = F.lit(_strength(paths, F.col("host_p")))
    return paths.select(
        "host", "path", "global", "host_p",
        ((F.col("k") + strength * F.col("host_p")) / (F.col("n") + strength)).alias("path_p"),
    )


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
    path: str = "lang", quality: str = "quality", toxic: str = "toxic", keep_at: float = 0.5, sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` with ``judged``: text probabilities, site posteriors, the combined ``score`` and ``keep``."""
    spark = docs.sparkSession
    model = fit_evidence(docs, labels, id_col, text, quality, toxic, sample)
    # The caller's row is one column, so that none of its names can meet those below.
    evidence = evidence_of(model, spark)
    good = (1 - F.col("_e.low")) * (1 - F.col("_e.toxic"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scored = whole.withColumn("_e", evidence(F.col(f"_row.{text}"))).withColumn("_good", good)
    soft = docs.select(F.col(host).alias("host"), F.col(path).alias("path"), evidence(F.col(text)).alias("_e")).select("host", "path", good.alias("p"))
    sites = site_posteriors(soft)
    short = sites.count() <= SMALL_TABLE
    sites = sites.select(*[F.col(c).alias(f"_site_{c}") for c in sites.columns])
    joined = scored.join(
        F.broadcast(sites) if short else sites,
        F.col(f"_row.{host}").eqNullSafe(F.col("_site_host")) & F.col(f"_row.{path}").eqNullSafe(F.col("_site_path")), "left",
    )
    odds = _logit(F.col("_good")) + _logit(F.col("_site_path_p")) - _logit(F.col("_site_global"))
    score = 1 / (1 + F.exp(-odds))
    judged = F.struct(
        F.col("_e.low").alias("p_low"), F.col("_e.toxic").alias("p_toxic"), F.col("_site_host_p").alias("host_p"),
        F.col("_site_path_p").alias("path_p"), score.alias("score"), (score >= keep_at).alias("keep"),
    )
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "judged"], judged.alias("judged"))
