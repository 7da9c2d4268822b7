"""Queries of the fitted models, the whole run and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.operators import monitor, preprocess
from themeloom.operators.concepts import supervised_labels
from themeloom.operators.density import fit_hdbscan, predict_hdbscan
from themeloom.operators.manifold import ManifoldModel, fit_manifold, transform_manifold
from themeloom.operators.neighbors import knn_join
from themeloom.plans.inputs import (
    LOG, SAMPLES, TEXTS, VECTORS, concepts, planted, resource_log, table, texts, vectors,
)
from themeloom.plans.queries_monitor import IDLE, PARSED, RATES, SESSIONS, SPINE, spine
from themeloom.plans.queries_vectors import long_form
from themeloom.plans.registry import query
from themeloom.plans.topic_model import FittedModels, run_topic_model
from themeloom.streaming import monitor as live
from themeloom.streaming.projection import score_stream
from themeloom.streaming.run import drain, drain_in_parts, stream_of

# Labels are the planted clusters: topics count from 0 by falling size, then by smallest id.
PLANTED_TOPICS = """planted_topics AS (
  SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS topic_id FROM embeddings GROUP BY label)"""


def planted_clusters(spark, folder):
    return fit_hdbscan(planted(spark, folder).select("id", "embedding"), min_cluster_size=10, min_samples=5)


@query(
    "hdbscan_fit",
    "SELECT vec_id AS id, topic_id FROM embeddings JOIN planted_topics USING (label)",
    (PLANTED_TOPICS,),
)
def hdbscan_fit(spark, folder):
    return planted_clusters(spark, folder).labels


@query(
    "hdbscan_predict",
    "SELECT vec_id AS id, topic_id FROM embeddings JOIN planted_topics USING (label)",
    (PLANTED_TOPICS,),
)
def hdbscan_predict(spark, folder):
    """Fitted points find their own cluster again."""
    model = planted_clusters(spark, folder)
    return predict_hdbscan(model, planted(spark, folder).select("id", "embedding")).select("id", "topic_id")


@query("manifold_fit")
def manifold_fit(spark, folder):
    return long_form(fit_manifold(planted(spark, folder).select("id", "embedding")).coords)


@query("manifold_neighbours", "SELECT count(*) AS n, true AS labels_together FROM embeddings")
def manifold_neighbours(spark, folder):
    """In two dimensions at least 97 of 100 points have a nearest neighbour of their own label;
    without epochs, from the principal components alone, it is about 91."""
    rows = planted(spark, folder)
    work = Workspace(spark, "layout")
    labels = work.save(rows.select("id", "label"), "labels")
    coords = fit_manifold(rows.select("id", "embedding"), n_components=2).coords
    near = knn_join(coords, coords, 1, exclude_self=True)
    other = labels.select(F.col("id").alias("neighbor_id"), F.col("label").alias("other"))
    same = near.join(labels.withColumnRenamed("id", "query_id"), "query_id").join(other, "neighbor_id")
    return same.agg(F.count("*").alias("n"), (F.avg((F.col("label") == F.col("other")).cast("int")) >= 0.97).alias("labels_together"))


@query("manifold_supervised")
def manifold_supervised(spark, folder):
    rows = vectors(spark, folder).select("id", "embedding")
    labels = supervised_labels(rows, concepts(spark, folder), 0.3)
    return long_form(fit_manifold(rows, labels=labels, n_epochs=10).coords)


# The width at which the memberships of 5 sorted distances sum to log2(5), by bisection: the
# list holds (low, high, width) and every step halves or doubles the interval.
TRANSFORM = """near AS (
  SELECT a.vec_id AS id, b.vec_id AS neighbor_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a, embeddings b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) <= 5),
packed AS (
  SELECT id, list(d ORDER BY d, neighbor_id) AS d, list(neighbor_id ORDER BY d, neighbor_id) AS n,
         min(d) FILTER (d > 0) AS rho FROM near GROUP BY id),
scaled AS (
  SELECT *, list_reduce(list_prepend([0.0, 1e300, 1.0], list_transform(range(64), lambda i: [0.0, 0.0, 0.0])),
    lambda s, x: CASE WHEN list_sum(list_transform(d, lambda v: exp(-greatest(v - rho, 0) / s[3]))) > log2(5)
      THEN [s[1], s[3], (s[1] + s[3]) / 2]
      ELSE [s[3], s[2], CASE WHEN s[2] >= 1e300 THEN s[3] * 2 ELSE (s[3] + s[2]) / 2 END] END)[3] AS sigma FROM packed),
weighed AS (
  SELECT id, unnest(n) AS neighbor_id,
         unnest(list_transform(d, lambda v: exp(-greatest(v - rho, 0) / greatest(sigma, 0.001 * list_avg(d))))) AS w FROM scaled)"""


@query(
    "manifold_transform",
    "SELECT w.id, unnest(range(0, 2)) AS pos, round(unnest([sum(w * e.embedding[1]) / sum(w), sum(w * e.embedding[2]) / sum(w)]), 6) + 0.0 AS value "
    "FROM weighed w JOIN embeddings e ON e.vec_id = w.neighbor_id GROUP BY w.id",
    (TRANSFORM,),
)
def manifold_transform(spark, folder):
    """Membership-weighted placement; the first two components play the fitted coordinates."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    coords = rows.select("id", F.slice("embedding", 1, 2).cast("array<double>").alias("embedding"))
    return long_form(transform_manifold(ManifoldModel(rows, coords, 5, "euclidean"), rows))


OPTIONS = {
    "primary_variant": "title_abstract", "fallback_variant": "title", "pca_n_components": 16, "umap_n_components": 5,
    "hdbscan_min_cluster_size": 10, "hdbscan_min_samples": 5,
}


def run_inputs(spark, folder):
    """Planted works; those with an abstract are fitted, all are the fallback variant, and works
    labelled good are the reference set."""
    work = Workspace(spark, "run-inputs")
    rows = planted(spark, folder).select(F.col("id").cast("string").alias("id"), "embedding")
    rows = work.save(rows, "rows")
    text = texts(spark, folder)
    fitted = rows.join(text.filter("abstract_clean IS NOT NULL").select("id"), "id")
    good = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return work.save(fitted, "fitted"), text, rows.join(good, "id"), rows


@query("topic_model")
def topic_model(spark, folder):
    corpus, text, references, everything = run_inputs(spark, folder)
    tables = run_topic_model(corpus, text, references, OPTIONS, everything, "test", "run1")
    return tables["topic_info"].withColumn("top_words", F.array_join("top_words", "|"))


# Works with an abstract are fitted; topics are their labels by falling size, then smallest id.
# Reference works and works without an abstract are placed in the topic of their label.
RUN_TOPICS = """fitted AS (
  SELECT v.id, v.label FROM vectors v JOIN texts t USING (id) WHERE t.abstract_clean IS NOT NULL),
run_topics AS (
  SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS topic_id FROM fitted GROUP BY label)"""

# One component less than labels: their centres span as much, and whitening adds no noise.
RUN_OPTIONS = {**OPTIONS, "pca_n_components": 9}


RUN_ROWS = """SELECT v.id, r.topic_id, 'corpus' AS source, 'embedding' AS topic_source FROM fitted v JOIN run_topics r USING (label)
    UNION ALL SELECT v.id, r.topic_id, 'keypaper', 'projected' FROM vectors v JOIN run_topics r USING (label)
      JOIN labels l ON CAST(l.doc_id AS VARCHAR) = v.id WHERE l.quality = 1
    UNION ALL SELECT v.id, r.topic_id, 'corpus', 'fallback' FROM vectors v JOIN run_topics r USING (label)
      WHERE v.id NOT IN (SELECT id FROM fitted)"""


@query("topic_model_rows", RUN_ROWS, (VECTORS, TEXTS, RUN_TOPICS))
def topic_model_rows(spark, folder):
    """Every row of a whole run through layout and clusters, against the planted labels."""
    corpus, text, references, everything = run_inputs(spark, folder)
    tables = run_topic_model(corpus, text, references, RUN_OPTIONS, everything, "test", "run1")
    return tables["topics"].select("id", "topic_id", "source", "topic_source")


@query("topic_model_graph", RUN_ROWS, (VECTORS, TEXTS, RUN_TOPICS))
def topic_model_graph(spark, folder):
    """The same run with neighbours from refined graphs."""
    corpus, text, references, everything = run_inputs(spark, folder)
    tables = run_topic_model(corpus, text, references, {**RUN_OPTIONS, "knn_search": "graph"}, everything, "test", "run1")
    return tables["topics"].select("id", "topic_id", "source", "topic_source")


@query(
    "project_new_rows",
    "SELECT CAST(vec_id AS VARCHAR) AS id, 'keypaper' AS source, topic_id, 'projected' AS topic_source "
    "FROM embeddings JOIN planted_topics USING (label) JOIN labels ON doc_id = vec_id WHERE quality = 1",
    (PLANTED_TOPICS,),
)
def project_new_rows(spark, folder):
    """Reference works placed in models fitted on all works; the layout is the PCA itself."""
    from themeloom.plans.topic_model import project_reference

    _, _, references, rows = run_inputs(spark, folder)
    rows = rows.select(F.col("id").cast("long").alias("id"), "embedding")
    pca = preprocess.fit_pca(rows, 10, whiten=False)
    ready = Workspace(spark, "project").save(preprocess.apply_pca(rows, pca), "ready")
    density = fit_hdbscan(ready, 10, 5)
    models = FittedModels(None, pca, ManifoldModel(ready, ready, 15, "euclidean"), density)
    return project_reference(references, models).select("id", "source", "topic_id", "topic_source")


# --- streams ---------------------------------------------------------------------------------


@query("stream_counter_rate", "SELECT * FROM rates", (SAMPLES, SPINE, RATES.format("spine")))
def stream_counter_rate(spark, folder):
    work = Workspace(spark, "stream")
    seen = work.save(spine(spark, folder), "samples")
    return drain_in_parts(seen, work, "arriving", live.stream_counter_rate, "rates")


@query(
    "stream_idle",
    """SELECT host, ts, count, CASE WHEN served THEN 'IDLE' ELSE 'STARTUP' END AS phase, startup_seconds, idle_seconds,
      coalesce(ts = stop_at, false) AS stop
    FROM timers LEFT JOIN stops USING (host) WHERE stop_at IS NULL OR ts <= stop_at""",
    (SAMPLES, SPINE, IDLE),
)
def stream_idle(spark, folder):
    work = Workspace(spark, "stream")
    seen = work.save(spine(spark, folder), "samples")
    return drain_in_parts(seen, work, "arriving", lambda rows: live.stream_idle_detector(rows, 720, 2880, 21_600), "idle")


@query(
    "stream_heartbeat",
    """WITH last_ts AS (SELECT max(ts) AS now FROM events),
    first AS (SELECT host, min(started) AS first_beat, arg_min(ended, idle_at) AS ended, min(idle_at) AS idle_at FROM sessions GROUP BY host),
    born AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS host, TIMESTAMP '2023-12-31 00:00:00' AS started FROM pages
             UNION SELECT DISTINCT host, TIMESTAMP '2023-12-31 00:00:00' FROM beats),
    base AS (SELECT *, first_beat IS NULL OR epoch_us(first_beat) - epoch_us(started) >= 172800000000 AS late
             FROM born LEFT JOIN first USING (host), last_ts)
    SELECT host, CASE WHEN late THEN 'STARTUP' ELSE 'IDLE' END AS phase, CASE WHEN NOT late THEN ended END AS last_beat,
      CASE WHEN late THEN started + INTERVAL 48 HOUR ELSE idle_at END AS stop_at, true AS stop FROM base
    WHERE CASE WHEN late THEN started + INTERVAL 48 HOUR ELSE idle_at END < date_trunc('millisecond', now)""",
    (SESSIONS,),
)
def stream_heartbeat(spark, folder):
    """Hosts are named by the pages and by the beats; decisions follow the watermark."""
    work = Workspace(spark, "stream")
    beats = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("host"), "ts", F.lit(False).alias("born"))
    names = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("host")).union(beats.select("host")).distinct()
    start = names.select("host", F.lit("2023-12-31 00:00:00").cast("timestamp").alias("ts"), F.lit(True).alias("born"))
    seen = work.save(start.unionByName(beats), "beats")
    # The beats arrive in order, so nothing is late and decisions need not wait.
    return drain_in_parts(
        seen, work, "arriving", lambda rows: live.stream_idle_heartbeat(rows, 720, 2880, "0 seconds"), "decisions"
    )


@query(
    "stream_sessions",
    "SELECT * FROM sessions WHERE idle_at <= (SELECT date_trunc('millisecond', max(ts)) FROM events)",
    (SESSIONS,),
)
def stream_sessions(spark, folder):
    """Runs that have ended; the beats arrive in order, in three parts."""
    work = Workspace(spark, "stream")
    beats = work.save(table(spark, folder, "events").select(F.col("user_id").cast("string").alias("host"), "ts"), "beats")
    return drain_in_parts(beats, work, "arriving", lambda rows: live.stream_sessions(rows, 720, "0 seconds"), "sessions")


@query(
    "stream_resource_series",
    """SELECT file, floor(minutes / 1440.0) * 1440.0 AS window_start, count(*) AS n, round(avg(cpu), 6) AS cpu,
      max(pod_mem) AS pod_mem_peak, max(rss) AS rss_peak, round(max(gpu_gib), 6) AS gpu_gib_peak,
      count(*) FILTER (danger) AS n_danger FROM parsed GROUP BY 1, 2""",
    (LOG, PARSED),
)
def stream_resource_series(spark, folder):
    """Log lines arrive in any order and are parsed one by one; a line finds the next one of its
    log among all that have arrived."""
    work = Workspace(spark, "stream")
    saved = work.save(resource_log(spark, folder), "logs")
    typed = drain(monitor.typed_lines(stream_of(spark, work, "logs", saved)), work, "typed")
    found = monitor.resource_series(monitor.pair_typed_lines(typed), 1440.0)
    return found.withColumns({"cpu": F.round("cpu", 6), "gpu_gib_peak": F.round("gpu_gib_peak", 6)})


@query(
    "stream_score",
    "SELECT CAST(vec_id AS VARCHAR) AS id, topic_id FROM embeddings JOIN planted_topics USING (label)",
    (PLANTED_TOPICS,),
)
def stream_score(spark, folder):
    """All works arrive as a stream and are placed in models fitted on them."""
    work = Workspace(spark, "stream")
    _, _, _, rows = run_inputs(spark, folder)
    keyed = rows.select(F.col("id").cast("long").alias("id"), "embedding")
    pca = preprocess.fit_pca(keyed, 10, whiten=False)
    ready = work.save(preprocess.apply_pca(keyed, pca), "ready")
    models = FittedModels(None, pca, ManifoldModel(ready, ready, 15, "euclidean"), fit_hdbscan(ready, 10, 5))
    arriving = work.save(rows, "arriving")
    out = f"{work.root}/scored"
    score_stream(stream_of(spark, work, "arriving", arriving), models, out, f"{out}-checkpoint")
    return spark.read.parquet(out).select("id", "topic_id")
