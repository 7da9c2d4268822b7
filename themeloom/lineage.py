"""Intermediate tables for iterative work.

Iterative operators cut lineage by writing a parquet table to the shared folder named in
``spark.checkpoint.dir`` and reading it back: losing an executor then costs one re-read, and
Catalyst sees the true size of the table when it picks the next join.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. Local masters without a setting get a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="themeloom-")
    return _local_dirs[app]


class Workspace:
    """Names tables of one run inside the shared folder.

    ``save`` writes a table once. ``rotate`` is for loops: it alternates between two folders of
    the same name, so a loop keeps two generations on disk however many rounds it takes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._turn: dict[str, int] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def rotate(self, df: DataFrame, name: str) -> DataFrame:
        turn = self._turn.get(name, 0)
        self._turn[name] = 1 - turn
        return self.save(df, f"{name}-{turn}")

    def number(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """``df``, stored, with the numbers 0, 1, ... in its order as ``column``. No task sees more than its own rows."""
        stored = self.save(df.withColumn("_place", F.monotonically_increasing_id()), name)
        part = F.shiftright("_place", 33)
        counts = sorted(stored.groupBy(part.alias("part")).count().collect())  # a row for each partition
        before, rows = 0, []
        for r in counts:
            rows.append((r["part"], before))
            before += r["count"]
        offsets = F.broadcast(self.spark.createDataFrame(rows or [(-1, 0)], "_part long, _before long"))
        own = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
        numbered = stored.withColumn("_part", part).join(offsets, "_part").withColumn(column, own)
        return numbered.select(*df.columns, column)
