"""Topic terms: counts, document frequency, tf-idf weights and top words.

No topic is ever concatenated into one document: terms are counted per document and summed,
with partial aggregation before the shuffle. N-grams stay inside one document.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.stopwords import ENGLISH
from themeloom.functions.text import doc_text, ngrams, remove_stop_words, tokenize
from themeloom.lineage import Workspace
from themeloom.operators.dedup import dedup_by_id

# Vectorizer defaults.
NGRAM = (1, 2)
MAX_FEATURES = 20_000
MIN_DF = 2
MAX_DF = 0.95
BROADCAST_TERMS = 500_000  # a vocabulary up to this size travels with the tasks
TOP_N_WORDS = 15


def attach_text(assignments: DataFrame, text: DataFrame) -> DataFrame:
    """``(id, topic_id, doc)``: assignments joined to their text, one text row per id."""
    left = assignments.select(F.col("id").cast("string").alias("id"), "topic_id")
    right = text.select(F.col("id").cast("string").alias("id"), "title_clean", "abstract_clean")
    # Texts of no assignment go before the copies of each text are sorted.
    right = dedup_by_id(right.join(left.select("id"), "id", "left_semi"))
    return left.join(right, "id").select(
        "id", "topic_id", doc_text(F.col("title_clean"), F.col("abstract_clean")).alias("doc")
    )


def drop_noise(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("topic_id") >= 0)


def topic_documents(assignments: DataFrame, text: DataFrame) -> DataFrame:
    """Documents of the non-noise topics as ``(topic_id, id, doc)``: one row per document, so
    no topic has to fit in one row or one task."""
    return attach_text(drop_noise(assignments), text).select("topic_id", "id", "doc")


def topic_order(df: DataFrame) -> DataFrame:
    return df.orderBy("topic_id")


def _count_terms(docs: DataFrame, ngram: tuple[int, int], stop_words: Sequence[str], boundary_ngrams: bool = False) -> DataFrame:
    """Term counts, with the bigrams between documents in the same shuffle if they are asked for, where a document without terms gives its topic a null term of count 0, so
    that a topic without terms still counts as a topic. Callers test ``tf`` and not ``term``:
    a test on a grouping key would be pushed below the aggregate, and the branches that read
    these counts would no longer share one shuffle."""
    tokens = docs.select("topic_id", remove_stop_words(tokenize(F.col("doc")), stop_words).alias("t"))
    terms = tokens.select("topic_id", F.explode_outer(ngrams(F.col("t"), *ngram)).alias("term"))
    if boundary_ngrams and ngram[0] <= 2 <= ngram[1]:
        terms = terms.unionByName(_boundary_terms(docs, stop_words))
    return terms.groupBy("topic_id", "term").agg(F.count("term").alias("tf"))


def boundary_bigrams(docs: DataFrame, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """``(topic_id, term, tf)`` of the bigrams that begin with the last word of a document and end
    with the first word of the next one with words in its topic, by id."""
    return _boundary_terms(docs, stop_words).groupBy("topic_id", "term").agg(F.count("*").alias("tf"))


def _boundary_terms(docs: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """A row for each of these bigrams, as often as it occurs.

    The words at the ends, not the documents, are stored and sorted into ranges of topic and id, so that the
    texts are read once and not again for the bounds of the ranges. Each range
    pairs its own neighbours; its last row of a topic takes the first row of the next range that
    has the topic from a table of one row for each range and topic.
    """
    words = remove_stop_words(tokenize(F.col("doc")), stop_words)
    ends = docs.select("topic_id", "id", words.alias("t")).filter(F.size("t") > 0).select(
        "topic_id", "id", F.element_at("t", 1).alias("head"), F.element_at("t", -1).alias("tail")
    )
    work = Workspace(docs.sparkSession, "boundaries")
    ranges = work.save(ends, "words").repartitionByRange("topic_id", "id").withColumn("part", F.spark_partition_id())
    placed = work.save(ranges, "ends")
    heads = placed.groupBy("topic_id", "part").agg(F.min_by("head", "id").alias("head"))
    later = F.lead("head").over(Window.partitionBy("topic_id").orderBy("part"))
    following = heads.select("topic_id", "part", later.alias("following"))
    own = F.lead("head").over(Window.partitionBy("topic_id", "part").orderBy("id"))
    paired = placed.withColumn("own", own).join(following, ["topic_id", "part"])
    term = F.concat_ws(" ", "tail", F.coalesce("own", "following"))
    return paired.filter("own IS NOT NULL OR following IS NOT NULL").select("topic_id", term.alias("term"))


def term_counts(
    docs: DataFrame, ngram: tuple[int, int] = NGRAM, stop_words: Sequence[str] = ENGLISH, boundary_ngrams: bool = False
) -> DataFrame:
    """``(topic_id, term, tf)`` over all documents of a topic.

    N-grams stay inside a document. ``boundary_ngrams`` adds the bigrams between one document of
    a topic and the next by id.
    """
    return _count_terms(docs, ngram, stop_words, boundary_ngrams).filter("tf > 0")


def _term_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def document_frequency(
    counts: DataFrame, n_topics: Column | int, min_df: int = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """``(term, df, total)`` for terms in ``min_df`` to ``max_df * n_topics`` topics."""
    limit = F.lit(max_df) * n_topics
    return _term_stats(counts).filter((F.col("df") >= min_df) & (F.col("df") <= limit))


def guard_vectorizer(n_docs: int, min_df: int = MIN_DF, max_df: float = MAX_DF) -> tuple[int, float]:
    """Document-frequency limits that are feasible for ``n_docs`` topics."""
    if n_docs == 0:
        raise ValueError(
            "no non-noise topics to describe: lower hdbscan_min_cluster_size or "
            "hdbscan_min_samples, or use supervised_umap"
        )
    if min_df > n_docs or max_df * n_docs < min_df:
        warnings.warn(
            f"min_df={min_df}, max_df={max_df} cannot hold for {n_docs} topics; "
            "using min_df=1, max_df=1.0",
            stacklevel=2,
        )
        return 1, 1.0
    return min_df, max_df


def limit_vocabulary(terms: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms over all topics; equal totals go by term."""
    return terms.orderBy(F.desc("total"), F.asc("term")).limit(max_features)


def ctfidf(
    docs: DataFrame,
    ngram: tuple[int, int] = NGRAM,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
    stop_words: Sequence[str] = ENGLISH,
    require_topics: bool = False,
    boundary_ngrams: bool = False,
    work: Workspace | None = None,
) -> DataFrame:
    """``(topic_id, term, tf, weight)``: tf * (ln((1+n)/(1+df)) + 1), unit length per topic.

    Infeasible frequency limits fall back to (1, 1.0), as does a vocabulary that would be
    empty. The rule is part of the plan: the number of topics and the number of kept terms are
    scalar subqueries over the term counts, whose shuffle is planned once and reused. The
    vocabulary has at most ``max_features`` rows, which bounds its broadcast. With
    ``require_topics`` an input without topics raises before any work. ``boundary_ngrams`` counts the
    bigrams between the documents of a topic too. With ``work`` the counts and the totals of the terms are
    stored there, so that texts are read once even where Spark plans the shuffle of the subqueries anew.
    """
    if require_topics and work is None and docs.isEmpty():
        guard_vectorizer(0)
    counted = _count_terms(docs, ngram, stop_words, boundary_ngrams)
    if work is not None:
        counted = work.save(counted, "counts")
        if require_topics and counted.isEmpty():  # every topic with a document has a row
            guard_vectorizer(0)
    n = counted.agg(F.countDistinct(F.when(F.col("tf") >= 0, F.col("topic_id")))).scalar()
    counts = counted.filter("tf > 0")
    infeasible = (n < min_df) | (F.lit(max_df) * n < min_df)
    totals = _term_stats(counts) if work is None else work.save(_term_stats(counts), "totals")
    stats = totals.withColumn(
        "in_range", infeasible | ((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    )
    n_kept = stats.agg(F.count_if("in_range")).scalar()
    kept = stats.filter(F.col("in_range") | (n_kept == 0))
    idf = (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")
    vocabulary = limit_vocabulary(kept, max_features).select("term", idf)
    # The caller's bound on terms is a bound on bytes; beyond it Spark chooses the join by size.
    joined = counts.join(F.broadcast(vocabulary) if max_features <= BROADCAST_TERMS else vocabulary, "term")
    raw = joined.withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("topic_id")))
    return raw.select("topic_id", "term", "tf", (F.col("raw") / length).alias("weight"))


def word_rank(weights: DataFrame) -> DataFrame:
    """Adds the 1-based rank by falling weight within a topic; equal weights go by term."""
    order = Window.partitionBy("topic_id").orderBy(F.desc(F.round("weight", 12)), F.asc("term"))
    return weights.withColumn("rank", F.row_number().over(order).cast("long"))


def top_words(
    weights: DataFrame, n: int = TOP_N_WORDS, zero_fill: bool = False, topics: DataFrame | None = None
) -> DataFrame:
    """``(topic_id, word, weight, rank)``: the ``n`` heaviest terms of each topic.

    ``zero_fill`` pads a topic that has fewer than ``n`` terms with vocabulary words of weight
    zero, alphabetically. Such a topic lacks at least ``n`` of the first ``2n`` vocabulary
    words, so only those are considered. ``topics`` lists the topics that get words, also those
    without any term of the vocabulary; by default the topics of ``weights``.
    """
    best = word_rank(weights.filter("weight > 0")).filter(F.col("rank") <= n)
    best = best.select("topic_id", F.col("term").alias("word"), "weight", "rank")
    if not zero_fill:
        return best
    first = weights.select("term").distinct().orderBy("term").limit(2 * n)
    fill = first.agg(F.array_sort(F.collect_list("term"))).scalar()
    listed = (weights if topics is None else topics).select("topic_id").distinct()
    own = best.groupBy("topic_id").agg(F.count("*").alias("have"), F.collect_list("word").alias("words"))
    short = listed.join(own, "topic_id", "left").withColumns(
        {"have": F.coalesce("have", F.lit(0)), "words": F.coalesce("words", F.array().cast("array<string>"))}
    )
    padded = (
        short.filter(F.col("have") < n)
        .select(
            "topic_id",
            "have",
            F.posexplode(F.array_except(fill, F.col("words"))).alias("pos", "word"),
        )
        .filter(F.col("have") + F.col("pos") < n)
        .select(
            "topic_id", "word", F.lit(0.0).alias("weight"),
            (F.col("have") + F.col("pos") + 1).cast("long").alias("rank"),
        )
    )
    return best.unionByName(padded)
