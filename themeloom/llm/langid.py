"""Language identification as inference over a mixture of languages.

**Learning.** Counts of byte n-grams (two to four bytes, words folded to lower case and set off by
one space, digits and symbols left out) of every training text, by language, over the whole corpus. Each task
adds up its own counts before the shuffle. N-grams are hashed into a table of fixed size, so the
model is bounded by ``BUCKETS`` times the number of languages, whatever the corpus.

**Prediction.** The n-grams of a text are drawn from a mixture of the languages. Expectation
maximisation estimates the proportions. The set of languages is chosen by penalised likelihood:
starting from all languages, the one of the least proportion is left out as long as
``log-likelihood - penalty * size * log(n-grams) / 2`` does not fall. The prediction is the language of
the largest proportion in the chosen set.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no proportions.
Texts with a null language don't train. Without any training text every text is ``und``. Of
languages of equal proportion the first in order of name is predicted.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.tokens import LOWER, batch_udf, text_bytes

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
PENALTY = 1.0
STEPS = 12
SMOOTH = 0.05
PART = 1 << 22

MIXTURE = "struct<lang: string, score: double, langs: array<string>, shares: array<double>>"


class Languages(NamedTuple):
    names: list[str]
    log_p: np.ndarray  # one row of log-probabilities for each bucket


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte n-grams of one text."""
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    own = np.where(letter, LOWER[data], 32)[keep]
    own = np.concatenate([[32], own]).astype(np.uint32)
    if len(own) < 2:
        return np.zeros(0, np.int64)
    out = []
    code = own.copy()
    for size in range(2, max(SIZES) + 1):
        code = (code[:-1] << np.uint32(8)) | own[size - 1 :]
        if size in SIZES:
            mixed = (code + np.uint32(size)) * np.uint32(2654435761)
            out.append(mixed >> np.uint32(16))
    return np.concatenate(out).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """Table of the n-gram buckets of one text, long texts in parts."""
    table = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(data), PART):
        table += np.bincount(grams(data[low : low + PART]), minlength=BUCKETS)
    return table


def _count_task(batches):
    """Counts of all texts of a task: one row for each language and bucket."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for i, lang in enumerate(batch["lang"].to_pylist()):
            table = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own = data[offsets[i] : offsets[i + 1]]
            for low in range(0, len(own), PART):
                np.add.at(table, grams(own[low : low + PART]), 1)
    for lang, table in totals.items():
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(table[some])],
            ["lang", "bucket", "n"],
        )


def learn(train: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Log-probabilities of n-gram buckets from all rows of ``train``."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(_count_task, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    table = np.full((BUCKETS, len(names)), 0.0)
    index = {x: k for k, x in enumerate(names)}
    columns = np.array([index[x] for x in found["lang"].to_pylist()], np.int64)
    table[found["bucket"].to_numpy(), columns] = found["n"].to_numpy()
    table += SMOOTH
    return Languages(names, np.log(table / table.sum(0)))


def mixture(log_p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages and the log-likelihood; ``log_p`` has a row for each n-gram."""
    top = log_p.max(1, keepdims=True)
    p = np.exp(log_p - top)
    total = weight.sum()
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(STEPS):
        joint = p @ share
        new = share * (p.T @ (weight / joint)) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(weight @ (np.log(p @ share) + top[:, 0]))


def infer(log_p: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions, 0 for languages outside the chosen set."""
    chosen = np.arange(log_p.shape[1])
    cost = penalty * 0.5 * np.log(max(weight.sum(), 2))
    share, fit = mixture(log_p, weight)
    while len(chosen) > 1:
        less = np.delete(chosen, share.argmin())
        other, other_fit = mixture(log_p[:, less], weight)
        if other_fit - cost * len(less) < fit - cost * len(chosen):
            break
        chosen, share, fit = less, other, other_fit
    out = np.zeros(log_p.shape[1])
    out[chosen] = share
    return out


def languages(model: Languages, spark, text: Column, penalty: float = PENALTY) -> Column:
    """The predicted language of a text, its proportion, and all chosen languages with theirs."""
    shared = spark.sparkContext.broadcast(model)

    def make(column: pa.Array) -> pa.Array:
        names, log_p = shared.value
        data, offsets = text_bytes(column)
        texts = column.to_pylist()
        pred, score, langs, shares = [], [], [], []
        for i, text_ in enumerate(texts):
            if not names or not has_letter(text_):
                pred.append("und")
                score.append(0.0)
                langs.append([])
                shares.append([])
                continue
            table = bucket_counts(data[offsets[i] : offsets[i + 1]])
            some = np.flatnonzero(table)
            own = infer(log_p[some], table[some].astype(np.float64), penalty)
            best = int(own.argmax())
            pred.append(names[best])
            score.append(float(min(1.0, own[best])))
            order = [k for k in np.argsort(-own, kind="stable") if own[k] > 0]
            langs.append([names[k] for k in order])
            shares.append([float(own[k]) for k in order])
        return pa.StructArray.from_arrays(
            [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
            ["lang", "score", "langs", "shares"],
        )

    return batch_udf(MIXTURE, make)(text)
