"""Scoring arriving rows with fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame

from themeloom.plans.topic_model import FittedModels, index_models, project
from themeloom.streaming.run import drain_batches


def score_stream(
    stream: DataFrame, models: FittedModels, out: str, checkpoint: str, topic_source: str = "fallback", **search
) -> None:
    """Places every micro-batch of ``(id, embedding)`` in fitted models and writes it below
    ``out``. A batch has its own folder, so one that is run again replaces its rows. The fitted points are made ready
    for searches once, before the first batch."""
    models = index_models(models, **search)

    def score(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            project(batch, models, "corpus", topic_source).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain_batches(stream, score, checkpoint)
