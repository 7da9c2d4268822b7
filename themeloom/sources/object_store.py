"""S3-compatible object store settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def object_store_conf(
    endpoint: str | None,
    region: str = "auto",
    timeout_ms: int = 120_000,
    retries: int = 8,
    backoff_ms: int = 2_000,
) -> dict[str, str]:
    """Hadoop settings for ``s3a://`` paths; empty when no endpoint is given.

    Credentials are left to the provider chain of the cluster.
    """
    if not endpoint:
        return {}
    return {
        "fs.s3a.endpoint": endpoint,
        "fs.s3a.endpoint.region": region,
        "fs.s3a.path.style.access": "true",
        "fs.s3a.connection.ssl.enabled": "true",
        "fs.s3a.connection.timeout": str(timeout_ms),
        "fs.s3a.attempts.maximum": str(retries),
        "fs.s3a.retry.limit": str(retries),
        "fs.s3a.retry.interval": f"{backoff_ms}ms",
    }


def apply_object_store_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    """Spark copies session settings into the Hadoop configuration of each read and write."""
    for key, value in conf.items():
        spark.conf.set(key, value)
