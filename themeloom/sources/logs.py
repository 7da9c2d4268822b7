"""Text sources: metric scrapes and resource logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.lineage import Workspace


def scrape_lines(text: DataFrame) -> DataFrame:
    """``(host, ts, line)`` from text rows that carry the path of their scrape file.

    A scrape file is named ``<host>_<epoch seconds>.prom``; host and time come from the name.
    """
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    return text.select(
        F.regexp_extract(name, r"^(.*)_[0-9]+\.prom$", 1).alias("host"),
        F.timestamp_seconds(F.regexp_extract(name, r"_([0-9]+)\.prom$", 1).cast("long")).alias("ts"),
        F.col("value").alias("line"),
    )


def read_metrics_text(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", "*.prom").text(path)
    return scrape_lines(lines.select("value", F.col("_metadata.file_path").alias("path")))


def stream_metrics_text(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as a stream over newly arriving scrape files."""
    lines = spark.readStream.option("pathGlobFilter", "*.prom").text(path)
    return scrape_lines(lines.select("value", F.col("_metadata.file_path").alias("path")))


def numbered_lines(whole: DataFrame) -> DataFrame:
    """Of a stream, where files arrive whole: ``(file, line_no, line)`` from rows ``(file, value)``."""
    return whole.select(
        "file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")
    )


def read_resource_log(spark: SparkSession, path: str, log: str | None = None) -> DataFrame:
    """``(file, line_no, line)``: numbered lines of resource logs of any size, numbers from 0.

    Every file is a log. Of logs that are cut into files, ``log`` is a pattern whose first group names the log in the path of a
    file; numbers then go on from file to file, in the order of their paths.

    Files are read in splits. The lines are stored with the split they come from and their place in it; the
    number of lines of every split, summed over the splits before it, completes the number. What follows
    the last line break of a file is a line only if it isn't empty.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("line"),
    )
    stored = Workspace(spark, "log-lines").save(lines, "lines")
    splits = stored.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # A split is a block or a whole file, so a log has few of them.
    own = F.col("file") if log is None else F.regexp_extract("file", log, 1)
    before = F.sum("n").over(Window.partitionBy(own).orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "split", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    return stored.join(offsets, ["file", "split"]).select(
        "file", (F.col("place") + F.col("offset")).alias("line_no"), "line"
    )


def stream_resource_log(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.readStream.text(path, wholetext=True)
    return numbered_lines(whole.select(F.col("_metadata.file_path").alias("file"), "value"))


def latest_file(spark: SparkSession, folder: str, pattern: str = "pod_watch_*.log") -> str | None:
    """Path of the newest matching file, from file metadata only."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "modificationTime")
    )
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"]
