"""Queries of the text and topic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions.stopwords import ENGLISH
from themeloom.functions.text import doc_text
from themeloom.operators import terms, topics
from themeloom.operators.dedup import dedup_by_id, fallback_minus_primary
from themeloom.plans.inputs import (
    ASSIGNED, CORPUS, PRIMARY, TEXTS, TOPICS, VECTORS,
    assigned, corpus, primary, table, texts, topic_parts, vectors,
)
from themeloom.plans.registry import query

STOP = ", ".join(f"'{w}'" for w in ENGLISH)

DOCS = """docs AS (
  SELECT a.topic_id, t.id, coalesce(t.title_clean, '') || ' ' || coalesce(t.abstract_clean, '') AS doc
  FROM texts t JOIN assigned a USING (id) WHERE a.topic_id >= 0)"""

TOKENS = f"""tokens AS (
  SELECT topic_id, id, list_filter(regexp_extract_all(lower(doc), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
         lambda w: NOT list_contains([{STOP}], w)) AS t FROM docs)"""

COUNTS = """counts AS (
  SELECT topic_id, term, count(*) AS tf FROM (
    SELECT topic_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
    FROM tokens) GROUP BY ALL)"""

WEIGHTS = """n AS (SELECT count(DISTINCT topic_id) AS n FROM docs),
stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term),
vocabulary AS (
  SELECT term, df, total, ln((1.0 + n.n) / (1.0 + df)) + 1 AS idf FROM stats, n
  WHERE (df >= 2 AND df <= 0.95 * n.n) OR n.n < 2 OR 0.95 * n.n < 2
  ORDER BY total DESC, term LIMIT 20000),
weights AS (
  SELECT topic_id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY topic_id)) AS weight
  FROM counts JOIN vocabulary USING (term))"""

WORDS = """words AS (
  SELECT topic_id, term AS word, weight, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 12) DESC, term) AS rank FROM weights)
  WHERE rank <= 15)"""

INFO = """info AS (
  SELECT topic_id, topic_id || '_' || coalesce(array_to_string(top_words[1:4], '_'), '') AS label, top_words
  FROM (SELECT DISTINCT topic_id FROM assigned WHERE topic_id >= 0)
  LEFT JOIN (SELECT topic_id, list(word ORDER BY rank) AS top_words FROM words GROUP BY topic_id) USING (topic_id)
  UNION ALL
  SELECT DISTINCT topic_id, '-1_noise', CAST([] AS VARCHAR[]) FROM assigned WHERE topic_id = -1)"""

SOURCE_COUNTS = """source_counts AS (
  SELECT topic_id, count(*) FILTER (source = 'corpus') AS n_corpus,
         count(*) FILTER (source = 'keypaper') AS n_keypapers FROM topics GROUP BY topic_id)"""

TEXT_INPUT = (TEXTS, ASSIGNED, DOCS, TOKENS, COUNTS)
ALL_TERMS = (*TEXT_INPUT, WEIGHTS, WORDS)


def documents(spark, folder):
    return terms.topic_documents(assigned(spark, folder), texts(spark, folder))


def weights(spark, folder):
    return terms.ctfidf(documents(spark, folder))


def words(spark, folder):
    return terms.top_words(weights(spark, folder))


def full_info(spark, folder):
    base = assigned(spark, folder)
    return topics.append_noise_topic(topics.topic_info(words(spark, folder), base), base)


@query(
    "scan_dedup",
    "SELECT id, batch, CAST(len(embedding) AS INTEGER) AS width FROM corpus "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch) = 1",
    (CORPUS,),
)
def scan_dedup(spark, folder):
    kept = dedup_by_id(corpus(spark, folder), order_by=["batch"])
    return kept.select("id", "batch", F.size("embedding").alias("width"))


@query(
    "text_scan",
    "SELECT id, md5(coalesce(title_clean, '') || ' ' || coalesce(abstract_clean, '')) AS doc_md5, "
    "CAST(length(coalesce(title_clean, '') || ' ' || coalesce(abstract_clean, '')) AS BIGINT) AS n_chars FROM texts",
    (TEXTS,),
)
def text_scan(spark, folder):
    doc = doc_text(F.col("title_clean"), F.col("abstract_clean"))
    unique = dedup_by_id(texts(spark, folder))
    return unique.select(
        "id", F.md5(doc.cast("binary")).alias("doc_md5"), F.length(doc).cast("long").alias("n_chars")
    )


@query(
    "attach_text",
    "SELECT a.id, a.topic_id, CAST(length(coalesce(title_clean, '') || ' ' || coalesce(abstract_clean, '')) AS BIGINT) AS n_chars "
    "FROM assigned a JOIN texts USING (id)",
    (TEXTS, ASSIGNED),
)
def attach_text(spark, folder):
    joined = terms.attach_text(assigned(spark, folder), texts(spark, folder))
    return joined.select("id", "topic_id", F.length("doc").cast("long").alias("n_chars"))


@query(
    "topic_documents",
    "SELECT topic_id, id, md5(doc) AS doc_md5 FROM docs",
    (TEXTS, ASSIGNED, DOCS),
)
def topic_documents(spark, folder):
    return documents(spark, folder).select("topic_id", "id", F.md5(F.col("doc").cast("binary")).alias("doc_md5"))


@query(
    "fallback_anti",
    "SELECT id FROM vectors WHERE id NOT IN (SELECT id FROM primary_variant)",
    (TEXTS, VECTORS, PRIMARY),
)
def fallback_anti(spark, folder):
    return fallback_minus_primary(vectors(spark, folder), primary(spark, folder)).select("id")


NULLABLE = """nullable AS (SELECT CASE WHEN abstract_clean IS NOT NULL THEN id END AS id FROM texts),
labelled AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels)"""


@query(
    "fallback_anti_nulls",
    """WITH unique_ids AS (SELECT DISTINCT id FROM nullable)
    SELECT 'null in fallback' AS case_name, id FROM unique_ids WHERE id NOT IN (SELECT id FROM labelled)
    UNION ALL
    SELECT 'null in primary', id FROM labelled WHERE id NOT IN (SELECT id FROM unique_ids)
    UNION ALL
    SELECT 'empty primary', id FROM unique_ids WHERE id NOT IN (SELECT id FROM labelled WHERE id IS NULL)""",
    (TEXTS, NULLABLE),
)
def fallback_anti_nulls(spark, folder):
    nullable = texts(spark, folder).select(F.when(F.col("abstract_clean").isNotNull(), F.col("id")).alias("id"))
    labelled = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"))

    def case(name, fallback, first):
        return fallback_minus_primary(fallback, first).select(F.lit(name).alias("case_name"), "id")

    return (
        case("null in fallback", nullable, labelled)
        .unionByName(case("null in primary", labelled, nullable))
        .unionByName(case("empty primary", nullable, labelled.filter("id IS NULL")))
    )


BOUNDARY = """ends AS (
  SELECT topic_id, t[len(t)] AS tail, lead(t[1]) OVER (PARTITION BY topic_id ORDER BY id) AS following
  FROM tokens WHERE len(t) > 0),
with_boundary AS (
  SELECT topic_id, term, CAST(sum(tf) AS BIGINT) AS tf FROM (
    SELECT topic_id, term, tf FROM counts
    UNION ALL SELECT topic_id, tail || ' ' || following, 1 FROM ends WHERE following IS NOT NULL)
  GROUP BY topic_id, term)"""


@query("term_counts_boundary", "SELECT * FROM with_boundary", (*TEXT_INPUT, BOUNDARY))
def term_counts_boundary(spark, folder):
    """With the bigrams between a document and the next one of its topic."""
    return terms.term_counts(documents(spark, folder), boundary_ngrams=True)


@query("term_counts", "SELECT topic_id, term, tf FROM counts", TEXT_INPUT)
def term_counts(spark, folder):
    return terms.term_counts(documents(spark, folder))


@query(
    "doc_frequency",
    "SELECT term, df, total FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term) "
    "WHERE df >= 2 AND df <= 0.95 * (SELECT count(DISTINCT topic_id) FROM docs)",
    TEXT_INPUT,
)
def doc_frequency(spark, folder):
    docs = documents(spark, folder)
    n_topics = docs.agg(F.countDistinct("topic_id")).scalar()
    return terms.document_frequency(terms.term_counts(docs), n_topics)


@query("vocabulary", "SELECT term, df, total FROM vocabulary", (*TEXT_INPUT, WEIGHTS))
def vocabulary(spark, folder):
    docs = documents(spark, folder)
    n_topics = docs.agg(F.countDistinct("topic_id")).scalar()
    return terms.limit_vocabulary(terms.document_frequency(terms.term_counts(docs), n_topics))


@query(
    "ctfidf",
    "SELECT topic_id, term, tf, round(weight, 6) AS weight FROM weights",
    (*TEXT_INPUT, WEIGHTS),
)
def ctfidf(spark, folder):
    return weights(spark, folder).withColumn("weight", F.round("weight", 6))


@query(
    "ctfidf_boundary",
    "SELECT topic_id, term, tf, round(weight, 6) AS weight FROM weights",
    (*TEXT_INPUT, BOUNDARY, WEIGHTS.replace("FROM counts", "FROM with_boundary")),
)
def ctfidf_boundary(spark, folder):
    """Weights that count the bigrams between documents."""
    found = terms.ctfidf(documents(spark, folder), boundary_ngrams=True)
    return found.withColumn("weight", F.round("weight", 6))


@query(
    "ctfidf_infeasible",
    "SELECT topic_id, term, tf, round(weight, 6) AS weight FROM weights",
    (*TEXT_INPUT, WEIGHTS.replace("WHERE (df >= 2 AND df <= 0.95 * n.n) OR n.n < 2 OR 0.95 * n.n < 2", "")),
)
def ctfidf_infeasible(spark, folder):
    """Limits that no number of topics can hold: every term is kept."""
    found = terms.ctfidf(documents(spark, folder), min_df=1_000_000)
    return found.withColumn("weight", F.round("weight", 6))


@query(
    "topic_words",
    "SELECT topic_id, word, round(weight, 6) AS weight, rank FROM words",
    ALL_TERMS,
)
def topic_words(spark, folder):
    return words(spark, folder).withColumn("weight", F.round("weight", 6))


@query(
    "topic_words_filled",
    """WITH padded AS (
      SELECT topic_id, word, row_number() OVER (PARTITION BY topic_id ORDER BY word) AS pos
      FROM (SELECT DISTINCT topic_id FROM words), (SELECT DISTINCT term AS word FROM weights)
      WHERE (topic_id, word) NOT IN (SELECT (topic_id, word) FROM words)),
    have AS (SELECT topic_id, count(*) AS have FROM words GROUP BY topic_id)
    SELECT topic_id, word, round(weight, 6) AS weight, rank FROM words
    UNION ALL
    SELECT topic_id, word, 0.0, have + pos FROM padded JOIN have USING (topic_id) WHERE have + pos <= 15""",
    ALL_TERMS,
)
def topic_words_filled(spark, folder):
    filled = terms.top_words(weights(spark, folder), zero_fill=True)
    return filled.withColumn("weight", F.round("weight", 6))


@query(
    "topic_info",
    "SELECT topic_id, label, coalesce(array_to_string(top_words, '|'), '') AS top_words FROM info",
    (*ALL_TERMS, INFO),
)
def topic_info(spark, folder):
    return full_info(spark, folder).withColumn("top_words", F.array_join("top_words", "|"))


@query("union_assignments", "SELECT * FROM topics", (TEXTS, ASSIGNED, TOPICS))
def union_assignments(spark, folder):
    return topics.union_assignments(*topic_parts(spark, folder))


@query("topic_source_counts", "SELECT * FROM source_counts", (TEXTS, ASSIGNED, TOPICS, SOURCE_COUNTS))
def topic_source_counts(spark, folder):
    return topics.topic_source_counts(topics.union_assignments(*topic_parts(spark, folder)))


@query(
    "topic_outputs",
    """SELECT topic_id, label, coalesce(array_to_string(top_words, '|'), '') AS top_words,
      coalesce(n_corpus, 0) AS n_corpus, coalesce(n_keypapers, 0) AS n_keypapers,
      coalesce(n_corpus, 0) + coalesce(n_keypapers, 0) AS n_total, coalesce(n_keypapers, 0) >= 3 AS is_relevant,
      'test' AS embedding_config, 'run1' AS bertopic_config, 'title_abstract' AS variant
    FROM info LEFT JOIN source_counts USING (topic_id)""",
    (*ALL_TERMS, INFO, TOPICS, SOURCE_COUNTS),
)
def topic_outputs(spark, folder):
    """The flagship: topic info with words, counts, relevance and provenance."""
    outputs = topics.compose_outputs(
        topics.union_assignments(*topic_parts(spark, folder)),
        full_info(spark, folder), words(spark, folder), "test", "run1", "title_abstract",
    )
    return outputs["topic_info"].withColumn("top_words", F.array_join("top_words", "|"))


@query(
    "run_summary",
    """SELECT (SELECT count(*) FROM (SELECT DISTINCT topic_id FROM assigned WHERE topic_id >= 0)) AS topics,
      count(*) FILTER (topic_id = -1) AS noise, count(*) FILTER (topic_source = 'fallback') AS fallback,
      count(*) FILTER (topic_source = 'projected') AS projected FROM topics""",
    (TEXTS, ASSIGNED, TOPICS),
)
def run_summary(spark, folder):
    everything = topics.union_assignments(*topic_parts(spark, folder))
    info = topics.topic_info(words(spark, folder), assigned(spark, folder))
    return topics.run_summary(info, everything)
