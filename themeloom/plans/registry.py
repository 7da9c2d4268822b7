"""Registered queries: one per operator, each beside the SQL that defines its answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a query; ``needs`` are the derived inputs its SQL starts from."""

    def register(run):
        def pinned(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = run(spark, folder)
            # Times are compared without a zone.
            times = [f.name for f in out.schema.fields if f.dataType.typeName() == "timestamp"]
            return out.withColumns({c: out[c].cast("timestamp_ntz") for c in times}) if times else out

        QUERIES[name] = pinned
        if sql is not None:
            body = sql.strip()
            if needs:
                joined = ", ".join(needs)
                body = f"WITH {joined}, {body[5:]}" if body.startswith("WITH ") else f"WITH {joined} {body}"
            ORACLE[name] = body
        return run

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from themeloom.plans import (  # noqa: F401
        queries_inference, queries_models, queries_monitor, queries_sources, queries_topics, queries_vectors,
    )
