"""Text columns: documents, tokens, n-grams, labels and pair truncation. All JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.binding import bind
from themeloom.functions.stopwords import ENGLISH

# Fixed value: a token is a run of two or more word characters of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def doc_text(title: Column, abstract: Column) -> Column:
    """Title and abstract with one space between, a missing part counting as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def normalize_id(col: Column) -> Column:
    return col.cast("string")


def tokenize(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def remove_stop_words(tokens: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Drops stop words, keeping order and repeats. The literal list becomes a hash set."""
    words = list(stop_words)
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def ngrams(tokens: Column, nmin: int = 1, nmax: int = 2) -> Column:
    """All word n-grams of ``nmin`` to ``nmax`` words, joined by one space."""
    if not 1 <= nmin <= nmax:
        raise ValueError(f"need 1 <= nmin <= nmax, got ({nmin}, {nmax})")

    def of_size(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    def all_sizes(t: Column) -> Column:
        parts = [of_size(t, n) for n in range(nmin, nmax + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return bind(tokens, all_sizes)


def topic_label(topic_id: Column, words: Column) -> Column:
    """``<id>_w1_w2_w3_w4``; the noise topic is ``-1_noise``."""
    named = F.concat(topic_id.cast("string"), F.lit("_"), F.array_join(F.slice(words, 1, 4), "_"))
    return F.when(topic_id == -1, F.lit("-1_noise")).otherwise(named)


def format_hypothesis(template: str, label: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{}"), label)


def normalize_label(col: Column) -> Column:
    return F.translate(F.upper(F.trim(col)), " -", "__")


def kept_lengths(n_first: Column, n_second: Column, max_length: int) -> tuple[Column, Column]:
    """Token counts left on each side when the longer side loses tokens first.

    The shorter side survives whole while it fits in half the budget; otherwise both sides
    shrink to half, the odd token going to the longer one (to the second side on a tie).
    """
    half = max_length // 2
    shorter = F.least(n_first, n_second)
    kept_short = F.least(shorter, F.lit(half))
    kept_long = F.lit(max_length) - kept_short
    fits = n_first + n_second <= max_length
    first = F.when(fits, n_first).when(n_first > n_second, kept_long).otherwise(kept_short)
    second = F.when(fits, n_second).when(n_first > n_second, kept_short).otherwise(kept_long)
    return first, second


def truncate_pair(premise: Column, hypothesis: Column, max_length: int) -> Column:
    """``struct(premise, hypothesis)`` cut to ``max_length`` whitespace tokens together."""
    sides = F.struct(
        F.filter(F.split(premise, r"\s+"), lambda t: t != "").alias("left"),
        F.filter(F.split(hypothesis, r"\s+"), lambda t: t != "").alias("right"),
    )

    def cut(pair: Column) -> Column:
        left, right = pair["left"], pair["right"]
        n_left, n_right = kept_lengths(F.size(left), F.size(right), max_length)
        return F.struct(
            F.array_join(F.slice(left, F.lit(1), n_left), " ").alias("premise"),
            F.array_join(F.slice(right, F.lit(1), n_right), " ").alias("hypothesis"),
        )

    return bind(sides, cut)
