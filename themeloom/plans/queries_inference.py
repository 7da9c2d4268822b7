"""Queries of the embedding and classification operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from themeloom.functions.text import normalize_label, truncate_pair
from themeloom.lineage import Workspace
from themeloom.operators import inference
from themeloom.plans.inputs import table
from themeloom.plans.queries_vectors import long_form
from themeloom.plans.registry import query

LABELS = ["agrees with", "argues against", "says nothing about"]
CLAIM = "The text {} one statement: the words of the text are shared by the claim."
DIRECT_LABELS = ["no opinion", "agrees"]
DIRECT_CLASSES = ("AGREES", "DISAGREES", "NO_OPINION")
TOKEN = r"[\p{L}\p{N}_]{2,}"


def premises(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("premise"))


def flat(results):
    """Labels and rounded scores as one row per rank."""
    zipped = F.posexplode(F.arrays_zip("labels", "scores")).alias("pos", "r")
    return results.select("id", zipped).select(
        "id", F.col("pos").cast("long").alias("pos"), F.col("r.labels").alias("label"),
        F.round("r.scores", 6).alias("score"),
    )


def truncated(max_length: int) -> str:
    """SQL of the pair cut to ``max_length`` whitespace tokens, the longer side first."""
    half = max_length // 2
    return f"""split_pairs AS (
      SELECT *, list_filter(string_split_regex(premise, '\\s+'), lambda t: t <> '') AS p,
             list_filter(string_split_regex(hypothesis, '\\s+'), lambda t: t <> '') AS h FROM all_pairs),
    cut AS (
      SELECT * EXCLUDE (premise, hypothesis),
        array_to_string(p[1:CASE WHEN len(p) + len(h) <= {max_length} THEN len(p)
          WHEN len(p) > len(h) THEN {max_length} - least(len(h), {half}) ELSE least(len(p), {half}) END], ' ') AS premise,
        array_to_string(h[1:CASE WHEN len(p) + len(h) <= {max_length} THEN len(h)
          WHEN len(p) > len(h) THEN least(len(h), {half}) ELSE {max_length} - least(len(p), {half}) END], ' ') AS hypothesis
      FROM split_pairs)"""


WHOLE = "cut AS (SELECT * FROM all_pairs)"

ALL_PAIRS = f"""all_pairs AS (
  SELECT doc_id AS id, text AS premise, ord, label, replace('{CLAIM}', '{{}}', label) AS hypothesis
  FROM documents, (VALUES (0, 'agrees with'), (1, 'argues against'), (2, 'says nothing about')) l(ord, label))"""

ONE_PAIR = """all_pairs AS (
  SELECT doc_id AS id, text AS premise, 'the words of the text are shared by the claim' AS hypothesis FROM documents)"""

SHARE = f"""shared AS (
  SELECT *, len(list_intersect(hw, list_distinct(regexp_extract_all(lower(premise), '{TOKEN}')))) / greatest(len(hw), 1) AS share
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(hypothesis), '{TOKEN}')) AS hw FROM cut)),
logits AS (SELECT *, share - 0.0 AS l0, share * 2 - 1.0 / 3 AS l1, share * 3 - 2.0 / 3 AS l2 FROM shared)"""

RANKED = "SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) - 1 AS pos, label, round(score, 6) AS score FROM scored"


@query(
    "pairs",
    "SELECT id, CAST(ord AS INTEGER) AS ord, label, hypothesis, md5(premise) AS premise_md5 FROM all_pairs",
    (ALL_PAIRS,),
)
def all_pairs(spark, folder):
    return inference.pairs(premises(spark, folder), LABELS, CLAIM).select(
        "id", "ord", "label", "hypothesis", F.md5(F.col("premise").cast("binary")).alias("premise_md5")
    )


@query(
    "truncate_pair",
    "SELECT id, md5(premise) AS premise_md5, hypothesis FROM cut",
    (ONE_PAIR, truncated(15)),
)
def truncate(spark, folder):
    cut = truncate_pair(F.col("premise"), F.lit("the words of the text are shared by the claim"), 15)
    rows = premises(spark, folder).select("id", cut.alias("c"))
    return rows.select("id", F.md5(F.col("c.premise").cast("binary")).alias("premise_md5"), F.col("c.hypothesis").alias("hypothesis"))


@query(
    "classify_zero_shot",
    f"WITH scored AS (SELECT *, exp(l2 - m) / sum(exp(l2 - m)) OVER (PARTITION BY id) AS score "
    f"FROM (SELECT *, max(l2) OVER (PARTITION BY id) AS m FROM logits)) {RANKED}",
    (ALL_PAIRS, WHOLE, SHARE),
)
def zero_shot(spark, folder):
    scorer = inference.LexicalScorer()
    return flat(inference.classify_zero_shot(premises(spark, folder), LABELS, scorer, CLAIM))


@query(
    "classify_multi_label",
    f"WITH scored AS (SELECT *, 1 / (1 + exp(l0 - l2)) AS score FROM logits) {RANKED}",
    (ALL_PAIRS, WHOLE, SHARE),
)
def multi_label(spark, folder):
    scorer = inference.LexicalScorer()
    return flat(inference.classify_multi_label(premises(spark, folder), LABELS, scorer, CLAIM))


@query(
    "classify_direct",
    f"""WITH native AS (SELECT id, exp(l0) / (exp(l0) + exp(l1) + exp(l2)) AS agrees,
        exp(l2) / (exp(l0) + exp(l1) + exp(l2)) AS other FROM logits),
    scored AS (SELECT id, 0 AS ord, 'no opinion' AS label, other AS score FROM native
               UNION ALL SELECT id, 1, 'agrees', agrees FROM native) {RANKED}""",
    (ONE_PAIR, WHOLE, SHARE),
)
def direct(spark, folder):
    scorer = inference.LexicalScorer(DIRECT_CLASSES)
    hypothesis = "the words of the text are shared by the claim"
    return flat(inference.classify_direct(premises(spark, folder), DIRECT_LABELS, hypothesis, scorer))


def load_overlap():
    """A batch model with the logits of the lexical one, computed in Python."""
    import regex

    words = regex.compile(TOKEN)

    def score(premises: list[str], hypotheses: list[str]) -> np.ndarray:
        shares = []
        for p, h in zip(premises, hypotheses):
            wanted = set(words.findall(h.lower()))
            shares.append(len(wanted & set(words.findall(p.lower()))) / max(1, len(wanted)))
        s = np.array(shares)[:, None]
        return s * np.array([1.0, 2.0, 3.0]) - np.array([0.0, 1.0, 2.0]) / 3

    return score


@query(
    "classify_batch_model",
    f"WITH scored AS (SELECT *, exp(l2 - m) / sum(exp(l2 - m)) OVER (PARTITION BY id) AS score "
    f"FROM (SELECT *, max(l2) OVER (PARTITION BY id) AS m FROM logits)) {RANKED}",
    (ALL_PAIRS, WHOLE, SHARE),
)
def batch_model(spark, folder):
    """The same request through a Python model fed by Arrow batches."""
    scorer = inference.BatchScorer(load_overlap, ("contradiction", "neutral", "entailment"))
    return flat(inference.classify(premises(spark, folder), LABELS, scorer, template=CLAIM, batch_size=64))


@query(
    "score_batches",
    "SELECT id, CAST(ord AS INTEGER) AS ord, round(l0, 6) AS l0, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM logits",
    (ALL_PAIRS, WHOLE, SHARE),
)
def batches(spark, folder):
    pairs = inference.pairs(premises(spark, folder), LABELS, CLAIM)
    scored = inference.score_batches(pairs, inference.BatchScorer(load_overlap))
    return scored.select("id", "ord", *[F.round(F.col("logits")[i], 6).alias(f"l{i}") for i in range(3)])


@query("sequences_scored", "SELECT count(*) AS sequences FROM documents")
def scored(spark, folder):
    results = inference.classify_zero_shot(premises(spark, folder), LABELS, inference.LexicalScorer(), CLAIM)
    return inference.save_scored(results, f"{Workspace(spark, 'scored').root}/results")


@query(
    "normalize_label",
    "SELECT DISTINCT source || ' - ' || lang AS label, upper(translate(trim(source || ' - ' || lang), ' -', '__')) AS name FROM documents",
)
def labels(spark, folder):
    label = F.concat("source", F.lit(" - "), "lang")
    return table(spark, folder, "documents").select(label.alias("label"), normalize_label(label).alias("name")).distinct()


HASHED = f"""words AS (
  SELECT doc_id AS id, md5(unnest(regexp_extract_all(lower(text), '{TOKEN}'))) AS h FROM documents),
sums AS (
  SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS pos,
         sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS s FROM words GROUP BY ALL),
norms AS (SELECT id, sqrt(CAST(sum(s * s) AS DOUBLE)) AS n FROM sums GROUP BY id)"""


@query(
    "embed_hashed",
    """SELECT d.doc_id AS id, p.pos, round(coalesce(s, 0) / greatest(coalesce(n, 0), 1e-12), 6) + 0.0 AS value
    FROM documents d CROSS JOIN (SELECT unnest(range(0, 64)) AS pos) p
    LEFT JOIN sums ON sums.id = d.doc_id AND sums.pos = p.pos LEFT JOIN norms ON norms.id = d.doc_id""",
    (HASHED,),
)
def hashed(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return long_form(inference.embed_hashed(docs))


def load_lengths():
    """A batch embedding model: word, letter and line counts."""

    def embed(texts: list[str]) -> np.ndarray:
        return np.array([[len(t.split()), len(t), t.count("\n") + 1] for t in texts], dtype=float)

    return embed


@query(
    "embed_batch_model",
    """SELECT doc_id AS id, unnest(range(0, 3)) AS pos, round(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) + 0.0 AS value
    FROM (SELECT doc_id, [CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS DOUBLE),
      CAST(length(text) AS DOUBLE), CAST(len(string_split(text, chr(10))) AS DOUBLE)] AS v FROM documents)""",
)
def embed_model(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return long_form(inference.embed_text(docs, load_lengths))
