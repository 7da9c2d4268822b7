"""Counters, host states, idle decisions and resource logs in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.monitor import danger, parse_gpu_line, parse_process_line, throughput_bar
from themeloom.lineage import Workspace
from themeloom.operators.scan import bucket_of, running

# Monitor defaults.
METRIC = "nli_request_count"
BAR_PEAK = 25.0
BAR_WIDTH = 18
IDLE_MIN = 5
STARTUP_GRACE_MIN = 60
POLL_SEC = 30

BUCKET_SEC = 86_400


def sum_metric(lines: DataFrame, prefix: str = METRIC) -> DataFrame:
    """``(host, ts, count)``: the last fields of the lines starting with ``prefix``, summed per
    scrape. Histogram lines (``_bucket``, ``_sum``) are left out; a scrape without a matching
    line is kept with a null count."""
    wanted = F.startswith(F.col("line"), F.lit(prefix)) & ~F.regexp_like("line", F.lit("_bucket|_sum"))
    field = F.element_at(F.split(F.rtrim("line"), r"\s+"), -1)
    value = F.when(wanted, field.try_cast("double"))
    return lines.groupBy("host", "ts").agg(F.sum(value).alias("count"))


def with_missing(samples: DataFrame, hosts: Column) -> DataFrame:
    """One row per host and pass: passes seen anywhere in the pool, times the list of hosts.

    ``hosts`` is an array column (a literal list, or a scalar subquery); a fleet is a bounded
    list, the passes are not, so only the list travels.
    """
    spine = samples.select("ts").distinct().select("ts", F.explode(hosts).alias("host"))
    return spine.join(samples, ["host", "ts"], "left").select("host", "ts", "count")


def counter_rate(samples: DataFrame, bucket_sec: int = BUCKET_SEC) -> DataFrame:
    """Adds ``rate`` (per second, one decimal) and ``reset`` to a full host x pass table.

    The rate needs a reading now and on the pass right before. A counter that went down was
    restarted: its rate is null and ``reset`` is true.
    """
    seen = F.struct("ts", "count")
    prior = running(
        samples, "host", "ts", bucket_of(F.col("ts"), bucket_sec), last_before={"_prev": seen}
    )
    elapsed = F.unix_timestamp("ts") - F.unix_timestamp(F.col("_prev.ts"))
    change = F.col("count") - F.col("_prev.count")
    reset = F.coalesce(change < 0, F.lit(False))
    rate = F.when((elapsed > 0) & (change >= 0), F.round(change / elapsed, 1))
    return prior.withColumns({"rate": rate, "reset": reset}).drop("_prev")


def host_status(rates: DataFrame) -> DataFrame:
    """Adds ``status``: ``DOWN`` without a reading, ``BUSY`` at a positive rate, else ``idle``."""
    status = (
        F.when(F.col("count").isNull(), "DOWN")
        .when(F.col("rate") > 0, "BUSY")
        .otherwise("idle")
    )
    return rates.withColumn("status", status)


def with_bar(rates: DataFrame, peak: float = BAR_PEAK, width: int = BAR_WIDTH) -> DataFrame:
    return rates.withColumn("bar", throughput_bar(F.coalesce("rate", F.lit(0.0)), peak, width))


def pool_totals(rates: DataFrame) -> DataFrame:
    """``(ts, total_rate, n_busy, n_hosts)`` per pass."""
    return rates.groupBy("ts").agg(
        F.round(F.coalesce(F.sum("rate"), F.lit(0.0)), 1).alias("total_rate"),
        F.count_if(F.col("rate") > 0).alias("n_busy"),
        F.count("*").alias("n_hosts"),
    )


def idle_detector(
    samples: DataFrame,
    idle_min: float = IDLE_MIN,
    startup_grace_min: float = STARTUP_GRACE_MIN,
    poll_sec: int = POLL_SEC,
    bucket_sec: int = BUCKET_SEC,
) -> DataFrame:
    """Two-phase idle decisions on ``(host, ts, count)``, one row per poll.

    Startup lasts until the count is first positive; every poll in it adds to the grace timer.
    After that an unchanged count adds a poll to the idle timer, a changed one resets it and an
    unreadable one (null or negative) holds it. A limit of 0 is switched off. ``stop`` marks
    the poll that ends the host; later polls of that host are dropped.
    """
    bucket = bucket_of(F.col("ts"), bucket_sec)
    work = Workspace(samples.sparkSession, "idle")
    # Each pass reads its input twice, so the passes go through stored tables.
    armed = samples.groupBy("host").agg(F.min(F.when(F.col("count") > 0, F.col("ts"))).alias("_armed"))
    rows = samples.join(armed, "host").withColumns(
        {
            "_reading": F.when(F.col("count") >= 0, F.col("count")),
            "_idle": F.coalesce(F.col("ts") >= F.col("_armed"), F.lit(False)),
        }
    )
    in_idle = F.col("_idle")
    rows = running(
        work.save(rows, "armed"), "host", "ts", bucket,
        sums={"_polls": F.lit(1)},
        last_known_before={"_known": F.when(in_idle, F.col("_reading"))},
    )
    readable = in_idle & F.col("_reading").isNotNull()
    changed = readable & F.coalesce(F.col("_reading") != F.col("_known"), F.lit(False))
    rows = work.save(rows.withColumn("_changed", changed), "changes")
    rows = running(
        rows, "host", "ts", bucket,
        sums={"_quiet": F.when(readable & ~F.col("_changed"), 1).otherwise(0)},
    )
    rows = work.save(rows, "quiet")
    # The timer since the last reset is the quiet count minus its value at that reset.
    rows = running(
        rows, "host", "ts", bucket,
        last_known_before={"_before": F.when(F.col("_changed"), F.col("_quiet"))},
    )
    base = F.when(F.col("_changed"), F.col("_quiet")).otherwise(
        F.coalesce("_before", F.lit(0))
    )
    timed = rows.withColumns(
        {
            "phase": F.when(in_idle, "IDLE").otherwise("STARTUP"),
            "startup_seconds": F.when(~in_idle, F.col("_polls") * poll_sec).cast("long"),
            "idle_seconds": F.when(in_idle, (F.col("_quiet") - base) * poll_sec).cast("long"),
        }
    )
    timed = work.save(timed.select("host", "ts", "count", "phase", "startup_seconds", "idle_seconds"), "timed")
    idle_limit, startup_limit = int(idle_min * 60), int(startup_grace_min * 60)
    over = F.lit(False)
    if startup_limit > 0:
        over = over | F.coalesce(F.col("startup_seconds") >= startup_limit, F.lit(False))
    if idle_limit > 0:
        over = over | F.coalesce(F.col("idle_seconds") >= idle_limit, F.lit(False))
    stops = timed.filter(over).groupBy("host").agg(F.min("ts").alias("_stop_at"))
    ended = timed.join(stops.withColumnRenamed("host", "_h"), F.col("host") == F.col("_h"), "left")
    alive = ended.filter(F.col("_stop_at").isNull() | (F.col("ts") <= F.col("_stop_at")))
    return alive.select(
        "host", "ts", "count", "phase", "startup_seconds", "idle_seconds",
        F.coalesce(F.col("ts") == F.col("_stop_at"), F.lit(False)).alias("stop"),
    )


def heartbeat_sessions(
    beats: DataFrame, idle_min: float = IDLE_MIN, bucket_sec: int = BUCKET_SEC
) -> DataFrame:
    """``(host, started, ended, n_beats, idle_at)``: runs of activity with no gap of
    ``idle_min`` or more; ``idle_at`` is when the idle limit after the run is reached."""
    limit = float(idle_min) * 60
    ticks = beats.groupBy("host", "ts").agg(F.count("*").alias("beats"))
    bucket = bucket_of(F.col("ts"), bucket_sec)
    linked = running(ticks, "host", "ts", bucket, last_before={"_prev": F.col("ts")})
    gap = (F.unix_micros("ts") - F.unix_micros("_prev")) / 1e6
    fresh = F.col("_prev").isNull() | (gap >= limit)
    numbered = running(
        linked.withColumn("_fresh", fresh), "host", "ts", bucket,
        sums={"_session": F.col("_fresh").cast("long")},
    )
    sessions = numbered.groupBy("host", "_session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sum("beats").alias("n_beats")
    )
    idle_at = F.timestamp_micros(F.unix_micros("ended") + F.lit(int(limit * 1e6)))
    return sessions.select("host", "started", "ended", "n_beats", idle_at.alias("idle_at"))


def idle_detector_heartbeat(
    beats: DataFrame,
    hosts: DataFrame,
    now: Column,
    idle_min: float = IDLE_MIN,
    startup_grace_min: float = STARTUP_GRACE_MIN,
) -> DataFrame:
    """``(host, phase, last_beat, stop_at, stop)`` as of ``now`` for ``hosts(host, started)``.

    A host is in startup until its first beat after ``started``, bounded by the grace; from
    then on it stops when the idle limit has passed since its latest beat. A limit of 0 is
    switched off. Only the first gap long enough counts, since a stopped host stays stopped.
    """
    seen = beats.filter(F.col("ts") <= now).join(
        hosts.select(F.col("host"), F.col("started").alias("_born")), "host"
    )
    seen = seen.filter(F.col("ts") > F.col("_born"))
    grace = int(startup_grace_min * 60)
    late = F.unix_micros("first_beat") - F.unix_micros("started") >= F.lit(grace * 1_000_000)
    first = seen.groupBy("host").agg(F.min("ts").alias("first_beat"), F.max("ts").alias("last_beat"))
    base = hosts.join(first, "host", "left")
    no_start = F.lit(False) if grace <= 0 else (F.col("first_beat").isNull() | late)
    if idle_min > 0:
        runs = heartbeat_sessions(seen.select("host", "ts"), idle_min)
        ends = runs.groupBy("host").agg(F.min_by(F.struct("ended", "idle_at"), "idle_at").alias("run"))
        base = base.join(ends, "host", "left")
        idle_at, last = F.col("run.idle_at"), F.col("run.ended")
    else:
        idle_at, last = F.lit(None).cast("timestamp"), F.col("last_beat")
    grace_at = F.timestamp_micros(F.unix_micros("started") + F.lit(grace * 1_000_000))
    in_startup = no_start | F.col("first_beat").isNull()
    stop_at = F.when(no_start, grace_at).when(F.col("first_beat").isNotNull(), idle_at)
    return base.select(
        "host",
        F.when(in_startup, "STARTUP").otherwise("IDLE").alias("phase"),
        F.when(~in_startup, last).alias("last_beat"),
        stop_at.alias("stop_at"),
        F.coalesce(stop_at <= now, F.lit(False)).alias("stop"),
    )


def pair_next_line(lines: DataFrame) -> DataFrame:
    """``(file, line_no, line, next_line)`` by an equi join on the following line number, so
    that one long file is not sorted in one task."""
    following = lines.select(
        F.col("file"), (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("next_line")
    )
    return lines.join(following, ["file", "line_no"], "left")


def typed_lines(lines: DataFrame) -> DataFrame:
    """``(file, line_no, p, g)``: the process and GPU lines of resource logs, parsed line by line.
    It keeps no state, so that it also runs on a stream of arriving lines."""
    parsed = lines.select("file", "line_no", parse_process_line(F.col("line")).alias("p"), parse_gpu_line(F.col("line")).alias("g"))
    return parsed.filter("p IS NOT NULL OR g.gpu IS NOT NULL")


def parse_resource_log(lines: DataFrame) -> DataFrame:
    """Typed rows of a resource log: each process line with the GPU line right after it."""
    return pair_typed_lines(typed_lines(lines))


def pair_typed_lines(typed: DataFrame) -> DataFrame:
    """Each process line with the GPU line right after it, by an equi join on the line number."""
    process = typed.select("file", "line_no", "p").filter("p IS NOT NULL")
    following = typed.select("file", (F.col("line_no") - 1).alias("line_no"), "g").filter("g.gpu IS NOT NULL")
    joined = process.join(following, ["file", "line_no"], "left")
    return joined.select(
        "file", "line_no", "p.minutes", "p.cpu", "p.pod_mem", "p.rss", "g.gpu", "g.gpu_gib",
        danger(F.col("p.pod_mem")).alias("danger"),
    )


def resource_series(parsed: DataFrame, window_min: float = 5.0) -> DataFrame:
    """Resource rows per tumbling window of elapsed minutes: means, peaks and danger rows."""
    start = F.floor(F.col("minutes") / window_min) * window_min
    return parsed.groupBy("file", start.cast("double").alias("window_start")).agg(
        F.count("*").alias("n"),
        F.avg("cpu").alias("cpu"),
        F.max("pod_mem").alias("pod_mem_peak"),
        F.max("rss").alias("rss_peak"),
        F.max("gpu_gib").alias("gpu_gib_peak"),
        F.count_if("danger").alias("n_danger"),
    )
