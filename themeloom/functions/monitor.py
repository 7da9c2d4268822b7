"""Columns for resource logs and pool dashboards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log line formats.
PROCESS_LINE = (
    r"etime=([0-9:-]+).*cpu=\s*([0-9.]+)%.*pod_mem=\s*([0-9.]+)%.*rss=\s*([0-9.]+)GB"
)
GPU_LINE = r"([0-9]+)\s*%,\s*([0-9]+)\s*MiB"
DANGER_PERCENT = 90.0  # fixed value: danger line of pod memory
FULL_BLOCK, LIGHT_BLOCK = "█", "░"  # fixed values: bar characters


def etime_to_minutes(col: Column) -> Column:
    """``MM:SS``, ``HH:MM:SS`` or ``D-HH:MM:SS`` to minutes; anything else is null."""
    day = F.when(F.contains(col, F.lit("-")), F.split_part(col, F.lit("-"), F.lit(1)).try_cast("double"))
    clock = F.when(F.contains(col, F.lit("-")), F.split_part(col, F.lit("-"), F.lit(2))).otherwise(col)
    parts = F.transform(F.split(clock, ":"), lambda p: p.try_cast("double"))
    minutes = (
        F.when(F.size(parts) == 2, parts[0] + parts[1] / 60)
        .when(F.size(parts) == 3, parts[0] * 60 + parts[1] + parts[2] / 60)
    )
    return minutes + F.coalesce(day, F.lit(0.0)) * 1440


def parse_process_line(line: Column) -> Column:
    """``struct(minutes, cpu, pod_mem, rss)`` or null when the line is of another kind."""

    def group(i: int) -> Column:
        return F.regexp_extract(line, PROCESS_LINE, i)

    return F.when(
        F.regexp_like(line, F.lit(PROCESS_LINE)),
        F.struct(
            etime_to_minutes(group(1)).alias("minutes"),
            group(2).try_cast("double").alias("cpu"),
            group(3).try_cast("double").alias("pod_mem"),
            group(4).try_cast("double").alias("rss"),
        ),
    )


def parse_gpu_line(line: Column) -> Column:
    """``struct(gpu, gpu_gib)``; both null when the line is not a GPU reading."""
    found = F.regexp_like(line, F.lit(GPU_LINE))
    return F.struct(
        F.when(found, F.regexp_extract(line, GPU_LINE, 1).try_cast("double")).alias("gpu"),
        F.when(found, F.regexp_extract(line, GPU_LINE, 2).try_cast("double") / 1024).alias("gpu_gib"),
    )


def memory_share(rss_kb: Column, limit_kb: Column, host_kb: Column) -> Column:
    """Percent of the pod limit in use; an unlimited pod is measured against its host."""
    return rss_kb * 100.0 / F.coalesce(limit_kb, host_kb)


def kb_to_gb(col: Column) -> Column:
    return col / 1024 / 1024


def danger(pod_mem: Column, limit: float = DANGER_PERCENT) -> Column:
    return pod_mem >= limit


def host_label(url: Column) -> Column:
    """Short host name: no scheme, path, domain or trailing ``-port``."""
    host = F.regexp_replace(url, r"^.*?://", "")
    host = F.split_part(F.split_part(host, F.lit("/"), F.lit(1)), F.lit("."), F.lit(1))
    return F.regexp_replace(host, r"-[^-]*$", "")


def throughput_bar(value: Column, peak: float, width: int) -> Column:
    cells = F.floor(F.lit(float(width)) * value / peak + 0.5) if peak > 0 else F.lit(0)
    filled = F.greatest(F.lit(0), F.least(F.lit(width), cells)).cast("int")
    return F.concat(
        F.repeat(F.lit(FULL_BLOCK), filled), F.repeat(F.lit(LIGHT_BLOCK), F.lit(width) - filled)
    )
