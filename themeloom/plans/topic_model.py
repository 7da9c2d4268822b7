"""A whole topic run: layout, clusters, words, reference and fallback rows, result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.stopwords import ENGLISH
from themeloom.lineage import Workspace
from themeloom.operators import preprocess, terms, topics
from themeloom.operators.concepts import supervised_labels
from themeloom.operators.dedup import fallback_minus_primary
from themeloom.operators.density import DensityModel, fit_hdbscan, index_hdbscan, predict_hdbscan
from themeloom.operators.manifold import ManifoldModel, fit_manifold, index_manifold, transform_manifold
from themeloom.plans import config
from themeloom.sources.stages import data_fingerprint, stage_cache, write_results
from themeloom.sources.variants import read_embeddings_only, read_text_only


@dataclass
class FittedModels:
    """What later rows need to be placed: preprocessing, layout and clusters."""

    mean: list[float] | None
    pca: preprocess.PcaModel | None
    manifold: ManifoldModel
    density: DensityModel


def index_models(models: FittedModels, **search) -> FittedModels:
    """The models with the points of both searches made ready once, for many small projections."""
    return replace(models, manifold=index_manifold(models.manifold, **search), density=index_hdbscan(models.density, **search))


def project(rows: DataFrame, models: FittedModels, source: str, topic_source: str) -> DataFrame:
    """``(id, source, topic_id, topic_source, probability)`` of rows placed in fitted models."""
    ready = preprocess.apply_preprocessing(rows.select("id", "embedding"), models.mean, models.pca)
    placed = predict_hdbscan(models.density, transform_manifold(models.manifold, ready))
    return placed.select(
        "id", F.lit(source).alias("source"), "topic_id",
        F.lit(topic_source).alias("topic_source"), "probability",
    )


def project_reference(references: DataFrame, models: FittedModels) -> DataFrame:
    return project(references, models, "keypaper", "projected")


def project_fallback(fallback: DataFrame, primary: DataFrame, models: FittedModels) -> DataFrame:
    return project(fallback_minus_primary(fallback, primary), models, "corpus", "fallback")


def describe_topics(
    assignments: DataFrame, text: DataFrame, options: Mapping[str, object], stop_words: Sequence[str] = ENGLISH
) -> tuple[DataFrame, DataFrame]:
    """Topic info and topic words of fitted assignments."""
    documents = terms.topic_documents(assignments, text)
    ngram = tuple(options["vectorizer_ngram"])
    work = Workspace(assignments.sparkSession, "words")
    weights = terms.ctfidf(
        documents, (int(ngram[0]), int(ngram[1])), int(options["vectorizer_min_df"]),
        float(options["vectorizer_max_df"]), int(options["vectorizer_max_features"]), stop_words,
        require_topics=True, boundary_ngrams=bool(options["boundary_ngrams"]), work=work,
    )
    words = terms.top_words(weights, int(options["top_n_words"]))
    words = work.save(words, "words")
    info = topics.append_noise_topic(topics.topic_info(words, assignments), assignments)
    return info, words


def fit_layout(
    corpus: DataFrame, options: Mapping[str, object], references: DataFrame | None = None
) -> tuple[list[float] | None, preprocess.PcaModel | None, ManifoldModel]:
    """Optional labels on raw vectors, then PCA or centring, then the layout."""
    labels = None
    if options["supervised_umap"]:
        if references is None:
            raise ValueError("supervised_umap needs reference embeddings")
        labels = supervised_labels(corpus, references, float(options["supervised_min_similarity"]))
    mean = pca = None
    seed = int(options["random_seed"])
    if options["pca_n_components"]:
        sample = options["pca_sample_size"]
        pca = preprocess.fit_pca(
            corpus, int(options["pca_n_components"]), bool(options["pca_whiten"]), int(sample) if sample else None, seed
        )
    elif options["center_embeddings"]:
        mean = list(preprocess.mean_vector(corpus).first()["mean"])
    layout = fit_manifold(
        preprocess.apply_preprocessing(corpus, mean, pca), int(options["umap_n_components"]),
        int(options["umap_n_neighbors"]), float(options["umap_min_dist"]), str(options["umap_metric"]), seed,
        labels, float(options["target_weight"]), search=str(options["knn_search"]),
    )
    return mean, pca, layout


def run_topic_model(
    corpus: DataFrame,
    text: DataFrame,
    references: DataFrame,
    options: Mapping[str, object],
    fallback: DataFrame | None = None,
    config_name: str = "default",
    run_name: str = "run",
    cache: str | None = None,
    stop_words: Sequence[str] = ENGLISH,
) -> dict[str, DataFrame]:
    """The three result tables, from deduplicated ``(id, embedding)`` and text frames.

    Every stage is stored below ``cache`` (by default in the session's shared folder) under a
    fingerprint of its options, of the options before it and of the data it read.
    """
    spark = corpus.sparkSession
    options = config.resolve(options)
    root = cache or Workspace(spark, "stages").root
    data = data_fingerprint(corpus)
    if options["supervised_umap"]:
        data += "/" + data_fingerprint(references)
    base = f"{root.rstrip('/')}/intermediate/config={config_name}"

    def subset(fields: tuple[str, ...]) -> dict[str, object]:
        return {name: options[name] for name in fields}

    layout_path = f"{base}/umap_cfg={config.config_fingerprint(options, config.LAYOUT, data)}"
    empty_pca = "component int, loadings array<double>, mean array<double>, scale double, explained double"

    def build_layout() -> dict[str, DataFrame]:
        mean, pca, layout = fit_layout(corpus, options, references)
        return {
            "points": layout.points, "coords": layout.coords,
            "pca": pca.table(spark) if pca else spark.createDataFrame([], empty_pca),
            "mean": spark.createDataFrame([(mean,)] if mean else [], "mean array<double>"),
        }

    stored = stage_cache(
        spark, layout_path, "umap", subset(config.LAYOUT), ("points", "coords", "pca", "mean"), build_layout
    )
    pca = preprocess.PcaModel.from_table(stored["pca"]) if options["pca_n_components"] else None
    mean_row = stored["mean"].first()
    layout = ManifoldModel(
        stored["points"], stored["coords"], int(options["umap_n_neighbors"]), str(options["umap_metric"])
    )

    cluster_path = f"{layout_path}/hdbscan_cfg={config.config_fingerprint(options, config.CLUSTERS, data)}"
    min_samples = int(options["hdbscan_min_samples"])

    def build_clusters() -> dict[str, DataFrame]:
        model = fit_hdbscan(layout.coords, int(options["hdbscan_min_cluster_size"]), min_samples, search=str(options["knn_search"]))
        return {"topics": model.labels, "points": model.points, "tree": model.tree}

    clusters = stage_cache(
        spark, cluster_path, "hdbscan", subset(config.CLUSTERS), ("topics", "points", "tree"), build_clusters
    )
    density = DensityModel(clusters["topics"], clusters["points"], clusters["tree"], min_samples)
    models = FittedModels(list(mean_row["mean"]) if mean_row else None, pca, layout, density)
    fitted = density.labels.select(
        "id", "topic_id", F.lit("embedding").alias("topic_source"),
        F.lit(None).cast("double").alias("probability"), F.lit("corpus").alias("source"),
    )

    text_data = data + "/" + data_fingerprint(text)
    words_path = f"{cluster_path}/ctfidf_cfg={config.config_fingerprint(options, config.TERMS, text_data)}"

    def build_words() -> dict[str, DataFrame]:
        info, words = describe_topics(fitted, text, options, stop_words)
        return {"topic_info": info, "topic_words": words}

    described = stage_cache(
        spark, words_path, "ctfidf", subset(config.TERMS), ("topic_info", "topic_words"), build_words
    )

    parts = [fitted, project_reference(references, models)]
    if options["fallback_variant"] is not None and fallback is not None:
        fallback_data = data + "/" + data_fingerprint(fallback)
        fallback_path = f"{cluster_path}/fallback_cfg={config.config_fingerprint(options, config.FALLBACK, fallback_data)}"
        extra = stage_cache(
            spark, fallback_path, "fallback", subset(config.FALLBACK), ("fallback_topics",),
            lambda: {"fallback_topics": project_fallback(fallback, corpus, models)},
        )
        parts.append(extra["fallback_topics"])
    # Stored once: all three result tables read the rows that have been placed.
    assignments = Workspace(spark, "assignments").save(topics.union_assignments(*parts), "topics")
    return topics.compose_outputs(
        assignments, described["topic_info"], described["topic_words"],
        config_name, run_name, str(options["primary_variant"]), int(options["keypaper_threshold"]),
    )


def topic_model(
    spark: SparkSession,
    corpus_root: str,
    reference_root: str,
    options: Mapping[str, object],
    run_name: str,
    out: str,
    config_name: str | None = None,
    cache: str | None = None,
    stop_words: Sequence[str] = ENGLISH,
) -> str:
    """Runs from variant folders to result files and returns the folder of the results.

    The rows of the variants are made unique once and stored; every stage reads them from there.
    """
    full = config.resolve(options)
    primary, second = str(full["primary_variant"]), full["fallback_variant"]
    name = config_name or config.config_name_of(corpus_root, reference_root)
    work = Workspace(spark, "run-inputs")
    corpus = work.save(read_embeddings_only(spark, corpus_root, primary), "corpus")
    text = work.save(read_text_only(spark, corpus_root, primary), "text")
    references = work.save(read_embeddings_only(spark, reference_root, primary), "references")
    fallback = work.save(read_embeddings_only(spark, corpus_root, str(second)), "fallback") if second else None
    tables = run_topic_model(corpus, text, references, options, fallback, name, run_name, cache, stop_words)
    return write_results(out, name, run_name, primary, tables)
