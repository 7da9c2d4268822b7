"""Registered queries of the pipeline operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import (
    alignment, decontaminate, divergence, fingerprints, langid, licences, line_dedup, ngram_join, pieces, pii, ppm, quality, urltree,
)

QUERIES = {}
ORACLE = {}

MODEL_FILE = "piece_bpe_32k.model"


BYTE_FILE = "byte_bpe_50k.json"


def model_path(name: str = MODEL_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its repeated blocks cut out, and the number of characters cut."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


@query
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests; how far the source spans reach."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_digests(docs)


def piece_digests(docs: DataFrame) -> DataFrame:
    made = docs.withColumn("e", pieces.round_trip(model_path())(F.col("text")))
    return made.select(
        "doc_id", pieces.n_ids(F.col("e.ids")).alias("n_tokens"), F.sha2("e.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("e.decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("e.covered").alias("n_source_bytes"),
    )


@query
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.edited_fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The judgement of every document: text evidence, site posteriors, score and decision."""
    docs = table(spark, folder, "documents")
    judged = quality.classify_quality(docs, table(spark, folder, "labels"))
    return judged.select("doc_id", "judged.*")


RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


@query
def op5_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page, with its path template and that one's purity."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urltree.judge_urls(pages, RULES).select("page_id", "judged.*")


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = docs.withColumn("f", pii.spans(pii.fit_detector(docs), spark, F.col("text")))

    def count(kind: str):
        return F.size(F.filter("f.base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS],
        F.sha2(pii.written(F.col("f.base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(pii.all_spans(F.col("f"))).alias("spans"),
    )


@query
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near copies and number of links of every document."""
    return ngram_join.near_copies(table(spark, folder, "documents")).drop("key", "class_key", "text_hash")


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those whose hash modulo 4 is not 2."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    held_out = F.coalesce(held_out, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.languages(model, spark, F.col("text")).alias("m"))
    return found.select(
        "doc_id", "held_out", F.col("m.lang").alias("lang_pred"), F.col("m.score").alias("score"),
        F.array_join("m.langs", ",").alias("languages"),
    )


@query
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = decontaminate.find_hits(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    hits = F.col("hits")
    return found.select(
        "doc_id", "hits.n_words", decontaminate.n_hit(hits).alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(hits).alias("contaminated"),
    )


@query
def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = docs.select("doc_id", licences.licences(F.col("text")).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["licence"])))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licences"),
        F.array_max(F.transform("found", lambda x: x["dice"])).alias("best_dice"), "found",
    )


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between two tokenizers of every document, as counts and a digest."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    a, b = model_path(BYTE_FILE), model_path()
    made = docs.select(F.struct("doc_id").alias("row"), alignment.aligned(a, b)(F.col("text")).alias("own"))
    digest = F.when(F.col("own.n_a") == 0, "").otherwise(F.sha2(F.col("own.groups").cast("binary"), 256))
    kept = [F.col(f"own.{f}").alias(f) for f in ("n_a", "n_b", "n_groups", "n_links", "links")]
    found = alignment.with_strength(made.select("row", F.struct(*kept, digest.alias("groups_sha256")).alias("own")), a, b)
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select("row.doc_id", *[f"own.{f}" for f in fields])


@query
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of the sources of each language, and the terms that set a source apart."""
    return divergence.source_divergence(table(spark, folder, "documents"))


ORACLE["op12_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS n_docs FROM words GROUP BY ALL
), kept AS (
    SELECT lang, term FROM counts GROUP BY ALL HAVING sum(n_docs) >= 30
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), own AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
    SELECT lang, source, term, n, 1 + (1000000000 * (n::HUGEINT + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p
    FROM own JOIN sizes USING (lang)
), whole AS (
    SELECT lang, term, sum(n) AS n FROM own GROUP BY ALL
), q AS (
    SELECT lang, term, 1 + (1000000000 * (n::HUGEINT + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
    FROM whole JOIN sizes USING (lang)
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL
    SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_ppm(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document, learned from those whose hash modulo 7 is not 2."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    docs = docs.withColumn("held_out", F.coalesce(out, F.lit(False)))
    found = ppm.score_documents(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score")
