"""Text embedding and zero-shot, multi-label or direct classification.

Models are pluggable. A *column model* builds Spark expressions and stays in the JVM. A *batch
model* is a loader that returns a callable; it is loaded once per Python worker and fed Arrow
batches. All labels of a premise are scored and ranked inside its row, so classification needs
no shuffle whatever the number of premises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from themeloom.functions.binding import bind
from themeloom.functions.scores import rank_scores, softmax
from themeloom.functions.text import format_hypothesis, tokenize, truncate_pair
from themeloom.functions.vectors import l2_normalize, list_array

CODES_AT_ONCE = 1 << 18  # words of an embedding batch that are added up together

# Request defaults.
HYPOTHESIS_TEMPLATE = "This example is {}."
BATCH_SIZE = 128
MAX_LENGTH = 512  # words of a pair that a transformer head reads


# --- scorers ---------------------------------------------------------------------------------


def entailment_index(native_labels: Sequence[str]) -> tuple[int, int]:
    """Positions of the entailment and the contradiction class in a model head.

    Entailment is the first label that starts with ``entail``, else the last class; the
    contradiction class is at the other end of the head.
    """
    last = len(native_labels) - 1
    entail = next(
        (i for i, x in enumerate(native_labels) if str(x).lower().startswith("entail")), last
    )
    return entail, (last if entail == 0 else 0)


@dataclass
class LexicalScorer:
    """Stand-in model: logits from the words that premise and hypothesis share."""

    native_labels: Sequence[str] = ("contradiction", "neutral", "entailment")
    max_length: int | None = None  # reads whole texts

    def columns(self, premise: Column, hypothesis: Column) -> Column:
        """One logit per native class, from the share of hypothesis words in the premise."""
        n = len(self.native_labels)

        def share(words: Column) -> Column:
            shared = F.size(F.array_intersect(words, tokenize(premise)))
            return shared / F.greatest(F.size(words), F.lit(1))

        def logits(s: Column) -> Column:
            return F.array(*[s * float(i + 1) - float(i) / n for i in range(n)])

        return bind(bind(F.array_distinct(tokenize(hypothesis)), share), logits)


@dataclass
class BatchScorer:
    """Model behind ``load() -> score(premises, hypotheses) -> (pairs x classes)``."""

    load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]
    native_labels: Sequence[str] = ("entailment", "not_entailment")
    batch_size: int = BATCH_SIZE
    max_length: int | None = None  # the limit of the model, if it has one


def _batched(
    score: Callable, premises: list[str], hypotheses: list[str], batch_size: int
) -> np.ndarray:
    """Scores pairs in fixed-size batches of similar length, returned in input order."""
    lengths = np.array([len(p) + len(h) for p, h in zip(premises, hypotheses)])
    order = np.argsort(-lengths, kind="stable")
    out: np.ndarray | None = None
    for start in range(0, len(order), batch_size):
        part = order[start : start + batch_size]
        logits = np.asarray(
            score([premises[i] for i in part], [hypotheses[i] for i in part]), dtype=np.float64
        )
        if out is None:
            out = np.empty((len(order), logits.shape[1]))
        out[part] = logits
    return out if out is not None else np.empty((0, 0))


def score_batches(pairs: DataFrame, scorer: BatchScorer, batch_size: int | None = None) -> DataFrame:
    """Adds ``logits ARRAY<DOUBLE>`` to ``(premise, hypothesis)`` rows."""
    size = max(1, batch_size or scorer.batch_size)
    load = scorer.load

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for pdf in batches:
            logits = _batched(score, pdf["premise"].tolist(), pdf["hypothesis"].tolist(), size)
            yield pdf.assign(logits=list(logits))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{names}, logits array<double>")


def score_hypotheses(
    premises: DataFrame,
    hypotheses: Sequence[str],
    scorer: LexicalScorer | BatchScorer,
    max_length: int | None = None,
) -> DataFrame:
    """Adds ``logits ARRAY<ARRAY<DOUBLE>>`` (hypothesis x native class) to ``(id, premise)``.

    A null premise counts as empty. Without a ``max_length`` the scorer's own limit holds; the
    built-in one has none.
    """
    limit = scorer.max_length if max_length is None else max_length
    premise = F.coalesce(F.col("premise"), F.lit(""))
    if isinstance(scorer, LexicalScorer):
        texts = F.array(*[F.lit(h) for h in hypotheses])

        def one(hypothesis: Column) -> Column:
            if limit is None:
                return scorer.columns(premise, hypothesis)
            return bind(truncate_pair(premise, hypothesis, limit), lambda c: scorer.columns(c["premise"], c["hypothesis"]))

        return premises.withColumn("logits", F.transform(texts, one))

    load, size, texts = scorer.load, max(1, scorer.batch_size), list(hypotheses)
    # The premise goes to Python once; what each hypothesis leaves of it goes as two strings only
    # where there is a limit.
    if limit is None:
        sent = premises.withColumn("_text", premise)
    else:
        sent = premises.withColumn("_cuts", F.array(*[truncate_pair(premise, F.lit(h), limit) for h in texts]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for pdf in batches:
            if limit is None:
                flat = [(text, h) for text in pdf["_text"] for h in texts]
            else:
                flat = [(c["premise"], c["hypothesis"]) for row in pdf["_cuts"] for c in row]
            logits = _batched(score, [p for p, _ in flat], [h for _, h in flat], size)
            packed = logits.reshape(len(pdf), len(texts), -1) if len(pdf) else logits
            kept = pdf.drop(columns="_text" if limit is None else "_cuts")
            yield kept.assign(logits=[list(map(list, m)) for m in packed])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in premises.schema.fields)
    return sent.mapInPandas(run, f"{names}, logits array<array<double>>")


# --- requests --------------------------------------------------------------------------------


def pairs(
    premises: DataFrame, labels: Sequence[str], template: str = HYPOTHESIS_TEMPLATE
) -> DataFrame:
    """``(id, premise, ord, label, hypothesis)``: every premise with every label, premise by
    premise. The request's labels are a literal array, so there is no join at all."""
    names = F.array(*[F.lit(x) for x in labels])
    exploded = premises.select("id", "premise", F.posexplode(names).alias("ord", "label"))
    return exploded.withColumn("hypothesis", format_hypothesis(template, F.col("label")))


def direct_label_map(requested: Sequence[str], native: Sequence[str]) -> list[int]:
    """Positions of the requested labels among the native classes, matched by normalised name."""

    def norm(label: str) -> str:
        return str(label).strip().upper().translate(str.maketrans(" -", "__"))

    known = {norm(x): i for i, x in enumerate(native)}
    missing = [x for x in requested if norm(x) not in known]
    if missing:
        raise ValueError(f"labels {missing!r} match no native class of {list(native)!r}")
    return [known[norm(x)] for x in requested]


OPTIONS = {  # fixed values: request fields
    "labels", "template", "hypothesis", "multi_label", "batch_size", "passes", "max_length"
}


def check_request(
    labels: Sequence[str],
    passes: int = 3,
    hypothesis: str | None = None,
    native_labels: Sequence[str] | None = None,
    options: Sequence[str] = (),
) -> None:
    """Rejects unknown options, unsupported passes and incomplete direct requests."""
    unknown = sorted(set(options) - OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {unknown}")
    if passes not in (1, 3):
        raise ValueError("passes must be 3 (zero-shot) or 1 (direct)")
    if not labels:
        raise ValueError("no candidate labels")
    if passes == 1:
        if not hypothesis:
            raise ValueError("a direct request needs a non-empty hypothesis")
        if native_labels is not None:
            direct_label_map(labels, native_labels)


def _ranked(scored: DataFrame, scores: Column, labels: Sequence[str]) -> DataFrame:
    ranked = scored.select("id", scores.alias("_scores"))
    ranked = ranked.select("id", rank_scores(F.col("_scores"), labels).alias("_r"))
    return ranked.select("id", "_r.labels", "_r.scores")


def classify_zero_shot(
    premises: DataFrame,
    labels: Sequence[str],
    scorer: LexicalScorer | BatchScorer,
    template: str = HYPOTHESIS_TEMPLATE,
    max_length: int | None = None,
) -> DataFrame:
    """``(id, labels, scores)``: softmax of the entailment logits over the candidate labels."""
    check_request(labels)
    entail, _ = entailment_index(scorer.native_labels)
    texts = [template.replace("{}", x) for x in labels]
    scored = score_hypotheses(premises, texts, scorer, max_length)
    return _ranked(scored, softmax(F.transform("logits", lambda m: m[entail])), labels)


def classify_multi_label(
    premises: DataFrame,
    labels: Sequence[str],
    scorer: LexicalScorer | BatchScorer,
    template: str = HYPOTHESIS_TEMPLATE,
    max_length: int | None = None,
) -> DataFrame:
    """``(id, labels, scores)``: per label, entailment against contradiction. The scores of a
    premise do not sum to 1."""
    check_request(labels)
    entail, contra = entailment_index(scorer.native_labels)
    texts = [template.replace("{}", x) for x in labels]
    scored = score_hypotheses(premises, texts, scorer, max_length)
    each = F.transform("logits", lambda m: 1 / (1 + F.exp(m[contra] - m[entail])))
    return _ranked(scored, each, labels)


def classify_direct(
    premises: DataFrame,
    labels: Sequence[str],
    hypothesis: str,
    scorer: LexicalScorer | BatchScorer,
    max_length: int | None = None,
) -> DataFrame:
    """``(id, labels, scores)``: one pass per premise with a literal hypothesis; softmax over
    all native classes, of which the requested ones are returned without renormalising."""
    check_request(labels, passes=1, hypothesis=hypothesis, native_labels=scorer.native_labels)
    positions = direct_label_map(labels, scorer.native_labels)
    scored = score_hypotheses(premises, [hypothesis], scorer, max_length)
    native = scored.withColumn("_native", softmax(F.col("logits")[0]))
    return _ranked(native, F.array(*[F.col("_native")[i] for i in positions]), labels)


def classify(
    premises: DataFrame, labels: Sequence[str], scorer: LexicalScorer | BatchScorer, **options
) -> DataFrame:
    """One entry point for all three modes, by the request's own option names."""
    passes = options.get("passes", 3)
    check_request(
        labels, passes, options.get("hypothesis"),
        scorer.native_labels if passes == 1 else None, tuple(options),
    )
    length = options.get("max_length")
    if isinstance(scorer, BatchScorer) and options.get("batch_size"):
        scorer = BatchScorer(scorer.load, scorer.native_labels, options["batch_size"], scorer.max_length)
    if passes == 1:
        return classify_direct(premises, labels, options["hypothesis"], scorer, length)
    run = classify_multi_label if options.get("multi_label") else classify_zero_shot
    return run(premises, labels, scorer, options.get("template", HYPOTHESIS_TEMPLATE), length)


def save_scored(results: DataFrame, path: str) -> DataFrame:
    """Writes classified sequences to ``path`` and returns one row with their number, counted as they are written."""
    seen = Observation("scored")
    results.observe(seen, F.count(F.lit(1)).alias("sequences")).write.mode("overwrite").parquet(path)
    return results.sparkSession.createDataFrame([(seen.get["sequences"],)], "sequences long")


def sequences_scored(results: DataFrame) -> DataFrame:
    """One row with the number of classified sequences, of results that aren't kept."""
    return results.agg(F.count("*").alias("sequences"))


# --- embedding -------------------------------------------------------------------------------


def _cell_sums(dim: int) -> Callable:
    """Batch function from rows (id, codes) to (id, raw). Rows are added up in slices of about ``CODES_AT_ONCE`` words, so
    that long texts need no more memory than short ones."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.cumsum(batch.column("codes").value_lengths().to_numpy(zero_copy_only=False))
            piece = np.append(0, before[:-1]) // CODES_AT_ONCE if batch.num_rows else before
            starts = np.searchsorted(piece, np.unique(piece)).tolist()
            for low, high in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(low, high - low)
                codes = part.column("codes")
                flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = codes.value_lengths().to_numpy(zero_copy_only=False)
                place = np.repeat(np.arange(part.num_rows), counts) * dim + np.abs(flat) - 1
                sums = np.bincount(place, np.sign(flat), part.num_rows * dim).reshape(part.num_rows, dim)
                yield pa.RecordBatch.from_arrays([part.column("id"), list_array(sums)], names=["id", "raw"])

    return add_up


def embed_hashed(df: DataFrame, dim: int = 64, text_col: str = "text") -> DataFrame:
    """``(id, embedding)`` from hashed words: each word adds +1 or -1 to one of ``dim`` cells.

    Built-in stand-in for a model. Each row is embedded where it is, without a shuffle, and rows
    of one id stay apart: Spark turns every word into a signed cell number, counts of a slice of an
    Arrow batch add them up.
    """

    def coded(word: Column) -> Column:
        digest = F.md5(word.cast("binary"))
        cell = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim + 1).cast("int")
        return F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, cell).otherwise(-cell)

    codes = F.coalesce(F.transform(tokenize(F.col(text_col)), coded), F.array().cast("array<int>"))
    id_type = df.schema["id"].dataType.simpleString()
    sums = df.select("id", codes.alias("codes")).mapInArrow(_cell_sums(dim), f"id {id_type}, raw array<double>")
    return sums.select("id", l2_normalize(F.col("raw")).alias("embedding"))


def embed_text(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_size: int = BATCH_SIZE,
    normalize: bool = True,
    text_col: str = "text",
) -> DataFrame:
    """``(id, embedding)`` from a batch model loaded once per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            parts = [
                np.asarray(model(texts[i : i + batch_size]), dtype=np.float64)
                for i in range(0, len(texts), batch_size)
            ]
            if parts:
                yield pd.DataFrame({"id": pdf["id"], "embedding": list(np.vstack(parts))})

    id_type = df.schema["id"].dataType.simpleString()
    out = df.select("id", text_col).mapInPandas(run, f"id {id_type}, embedding array<double>")
    return out.withColumn("embedding", l2_normalize(F.col("embedding"))) if normalize else out
