"""Queries of the monitoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions.monitor import host_label, kb_to_gb, memory_share, throughput_bar
from themeloom.operators import monitor
from themeloom.plans.inputs import LOG, SAMPLES, SCRAPES, resource_log, samples, scrapes, table
from themeloom.plans.registry import query

PROCESS = r"etime=([0-9:-]+).*cpu=\s*([0-9.]+)%.*pod_mem=\s*([0-9.]+)%.*rss=\s*([0-9.]+)GB"
GPU = r"([0-9]+)\s*%,\s*([0-9]+)\s*MiB"


@query(
    "metric_sum",
    r"""SELECT host, ts, sum(CASE WHEN line LIKE 'te_request_count%' AND NOT regexp_matches(line, '_bucket|_sum')
      THEN TRY_CAST(regexp_extract(line, '(\S+)$', 1) AS DOUBLE) END) AS count FROM scrapes GROUP BY host, ts""",
    (SCRAPES,),
)
def metric_sum(spark, folder):
    return monitor.sum_metric(scrapes(spark, folder), "te_request_count")


SPINE = """spine AS (
  SELECT h.host, t.ts, s.count FROM (SELECT DISTINCT ts FROM samples) t CROSS JOIN (SELECT DISTINCT host FROM samples) h
  LEFT JOIN samples s ON s.host = h.host AND s.ts = t.ts)"""

RATES = """rates AS (
  SELECT host, ts, count, CASE WHEN elapsed > 0 AND count >= before THEN round((count - before) / elapsed, 1) END AS rate,
         coalesce(count < before, false) AS reset
  FROM (SELECT *, lag(count) OVER w AS before, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS elapsed
        FROM {0} WINDOW w AS (PARTITION BY host ORDER BY ts)))"""

STATUS = "CASE WHEN count IS NULL THEN 'DOWN' WHEN rate > 0 THEN 'BUSY' ELSE 'idle' END AS status"


def spine(spark, folder):
    seen = samples(spark, folder)
    hosts = seen.agg(F.array_sort(F.collect_set("host"))).scalar()
    return monitor.with_missing(seen, hosts)


@query("scrape_spine", "SELECT * FROM spine", (SAMPLES, SPINE))
def scrape_spine(spark, folder):
    return spine(spark, folder)


@query("counter_rate", "SELECT * FROM rates", (SAMPLES, SPINE, RATES.format("spine")))
def counter_rate(spark, folder):
    return monitor.counter_rate(spine(spark, folder))


# Rates of the samples are far below one per second, so busy hosts need finer counters: here a
# count stands for the summed values of the events, in thousandths.
FINE = """fine AS (
  SELECT host, ts, CASE WHEN last_type <> 'error' THEN CAST(sum(v) OVER (PARTITION BY host, date_trunc('week', ts) ORDER BY ts) AS DOUBLE) END AS count
  FROM (SELECT CAST(user_id AS VARCHAR) AS host, date_trunc('day', ts) + INTERVAL 1 DAY AS ts,
               CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS v, arg_max(event_type, event_id) AS last_type
        FROM events GROUP BY 1, 2))"""


def fine(spark, folder):
    from pyspark.sql import Window

    day = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
    days = table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("host"), day.alias("ts")).agg(
        F.sum(F.floor(F.col("value") * 1000)).alias("v"), F.max_by("event_type", "event_id").alias("last_type")
    )
    # A week of days is seven rows, so the window is small whatever the traffic.
    week = Window.partitionBy("host", F.date_trunc("week", "ts")).orderBy("ts")
    return days.select(
        "host", "ts", F.when(F.col("last_type") != "error", F.sum("v").over(week).cast("double")).alias("count")
    )


FINE_RATES = (FINE, SPINE.replace("samples", "fine"), RATES.format("spine"))


def fine_rates(spark, folder):
    seen = fine(spark, folder)
    hosts = seen.agg(F.array_sort(F.collect_set("host"))).scalar()
    return monitor.counter_rate(monitor.with_missing(seen, hosts), bucket_sec=7 * 86_400)


@query("host_status", f"SELECT host, ts, rate, {STATUS} FROM rates", FINE_RATES)
def host_status(spark, folder):
    return monitor.host_status(fine_rates(spark, folder)).select("host", "ts", "rate", "status")


@query(
    "pool_totals",
    """SELECT ts, round(coalesce(sum(rate), 0.0), 1) AS total_rate, count(*) FILTER (rate > 0) AS n_busy, count(*) AS n_hosts
    FROM rates GROUP BY ts""",
    FINE_RATES,
)
def pool_totals(spark, folder):
    return monitor.pool_totals(fine_rates(spark, folder))


@query(
    "throughput_bar",
    """SELECT event_id, repeat('█', f) || repeat('░', 18 - f) AS bar FROM (
      SELECT event_id, CAST(greatest(0, least(18, floor(18.0 * value / 25 + 0.5))) AS INTEGER) AS f FROM events)""",
)
def bars(spark, folder):
    bar = throughput_bar(F.col("value"), monitor.BAR_PEAK, monitor.BAR_WIDTH)
    return table(spark, folder, "events").select("event_id", bar.alias("bar"))


@query(
    "host_label",
    r"""SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(url, '^.*?://', ''), '/', 1), '.', 1), '-[^-]*$', '') AS label,
      'pod' || page_id AS pod FROM pages""",
)
def hosts(spark, folder):
    proxied = F.concat(F.lit("https://pod"), F.col("page_id").cast("string"), F.lit("-8080.proxy.example.net/metrics"))
    return table(spark, folder, "pages").select("page_id", host_label(F.col("url")).alias("label"), host_label(proxied).alias("pod"))


IDLE = """polls AS (
  SELECT *, CASE WHEN count >= 0 THEN count END AS reading,
         sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) OVER w > 0 AS served, row_number() OVER w AS poll FROM spine
  WINDOW w AS (PARTITION BY host ORDER BY ts)),
steps AS (
  SELECT *, served AND reading IS NOT NULL AND coalesce(reading <> last_value(CASE WHEN served THEN reading END IGNORE NULLS)
         OVER (PARTITION BY host ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS changed FROM polls),
runs AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts) AS run FROM steps),
timers AS (
  SELECT *, CASE WHEN NOT served THEN poll * 21600 END AS startup_seconds,
    CASE WHEN served THEN CAST(21600 * sum(CASE WHEN served AND reading IS NOT NULL AND NOT changed THEN 1 ELSE 0 END)
      OVER (PARTITION BY host, run ORDER BY ts) AS BIGINT) END AS idle_seconds FROM runs),
stops AS (
  SELECT host, min(ts) AS stop_at FROM timers
  WHERE coalesce(startup_seconds >= 172800, false) OR coalesce(idle_seconds >= 43200, false) GROUP BY host)"""


@query(
    "idle_counter",
    """SELECT host, ts, count, CASE WHEN served THEN 'IDLE' ELSE 'STARTUP' END AS phase, startup_seconds, idle_seconds,
      coalesce(ts = stop_at, false) AS stop
    FROM timers LEFT JOIN stops USING (host) WHERE stop_at IS NULL OR ts <= stop_at""",
    (SAMPLES, SPINE, IDLE),
)
def idle_counter(spark, folder):
    """Polls are six hours apart here: 12 idle hours or 48 hours of startup end a host."""
    return monitor.idle_detector(spine(spark, folder), idle_min=720, startup_grace_min=2880, poll_sec=21_600)


SESSIONS = """beats AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS host, ts FROM events),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY ts) AS session FROM (
    SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts)) < 43200000000, false)
           THEN 0 ELSE 1 END AS fresh FROM beats)),
sessions AS (
  SELECT host, min(ts) AS started, max(ts) AS ended, count(*) AS n_beats, max(ts) + INTERVAL 12 HOUR AS idle_at
  FROM numbered GROUP BY host, session)"""


@query("idle_sessions", "SELECT * FROM sessions", (SESSIONS,))
def idle_sessions(spark, folder):
    beats = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("host"), "ts")
    return monitor.heartbeat_sessions(beats, idle_min=720)


@query(
    "idle_heartbeat",
    """WITH last_ts AS (SELECT max(ts) AS now FROM events),
    first AS (SELECT host, min(started) AS first_beat, arg_min(ended, idle_at) AS ended, min(idle_at) AS idle_at FROM sessions GROUP BY host),
    born AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS host, TIMESTAMP '2023-12-31 00:00:00' AS started FROM pages),
    base AS (SELECT *, first_beat IS NULL OR epoch_us(first_beat) - epoch_us(started) >= 172800000000 AS late
             FROM born LEFT JOIN first USING (host), last_ts)
    SELECT host, CASE WHEN late THEN 'STARTUP' ELSE 'IDLE' END AS phase, CASE WHEN NOT late THEN ended END AS last_beat,
      CASE WHEN late THEN started + INTERVAL 48 HOUR ELSE idle_at END AS stop_at,
      CASE WHEN late THEN started + INTERVAL 48 HOUR ELSE idle_at END <= now AS stop FROM base""",
    (SESSIONS,),
)
def idle_heartbeat(spark, folder):
    """Hosts are named by the pages table, so some of them never beat."""
    events = table(spark, folder, "events")
    beats = events.select(F.col("user_id").cast("string").alias("host"), "ts")
    started = F.lit("2023-12-31 00:00:00").cast("timestamp")
    born = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("host"), started.alias("started")).distinct()
    now = events.agg(F.max("ts").cast("timestamp")).scalar()
    return monitor.idle_detector_heartbeat(beats, born, now, idle_min=720, startup_grace_min=2880)


PARSED = rf"""process AS (
  SELECT file, line_no, regexp_extract(line, '{PROCESS}', 1) AS etime, CAST(regexp_extract(line, '{PROCESS}', 2) AS DOUBLE) AS cpu,
    CAST(regexp_extract(line, '{PROCESS}', 3) AS DOUBLE) AS pod_mem, CAST(regexp_extract(line, '{PROCESS}', 4) AS DOUBLE) AS rss
  FROM log WHERE regexp_matches(line, '{PROCESS}')),
gpu AS (
  SELECT file, line_no, CAST(regexp_extract(line, '{GPU}', 1) AS DOUBLE) AS gpu,
    CAST(regexp_extract(line, '{GPU}', 2) AS DOUBLE) / 1024 AS gpu_gib FROM log WHERE regexp_matches(line, '{GPU}')),
clocks AS (
  SELECT *, CASE WHEN contains(etime, '-') THEN CAST(split_part(etime, '-', 1) AS DOUBLE) ELSE 0 END AS days,
    string_split(CASE WHEN contains(etime, '-') THEN split_part(etime, '-', 2) ELSE etime END, ':') AS c FROM process),
parsed AS (
  SELECT p.file, p.line_no, days * 1440 + CAST(c[1] AS DOUBLE) * 60 + CAST(c[2] AS DOUBLE) + CAST(c[3] AS DOUBLE) / 60 AS minutes,
    cpu, pod_mem, rss, gpu, gpu_gib, pod_mem >= 90 AS danger
  FROM clocks p LEFT JOIN gpu g ON g.file = p.file AND g.line_no = p.line_no + 1)"""


@query(
    "resource_rows",
    "SELECT * REPLACE (round(minutes, 6) AS minutes, round(gpu_gib, 6) AS gpu_gib) FROM parsed",
    (LOG, PARSED),
)
def resource_rows(spark, folder):
    parsed = monitor.parse_resource_log(resource_log(spark, folder))
    return parsed.withColumns({"minutes": F.round("minutes", 6), "gpu_gib": F.round("gpu_gib", 6)})


@query(
    "pair_next_line",
    "SELECT l.file, l.line_no, l.line, n.line AS next_line FROM log l LEFT JOIN log n ON n.file = l.file AND n.line_no = l.line_no + 1",
    (LOG,),
)
def next_line(spark, folder):
    return monitor.pair_next_line(resource_log(spark, folder))


@query(
    "resource_series",
    """SELECT file, floor(minutes / 1440.0) * 1440.0 AS window_start, count(*) AS n, round(avg(cpu), 6) AS cpu,
      max(pod_mem) AS pod_mem_peak, max(rss) AS rss_peak, round(max(gpu_gib), 6) AS gpu_gib_peak,
      count(*) FILTER (danger) AS n_danger FROM parsed GROUP BY 1, 2""",
    (LOG, PARSED),
)
def resource_series(spark, folder):
    series = monitor.resource_series(monitor.parse_resource_log(resource_log(spark, folder)), 1440.0)
    return series.withColumns({"cpu": F.round("cpu", 6), "gpu_gib_peak": F.round("gpu_gib_peak", 6)})


@query(
    "memory_share",
    """SELECT event_id, round(value * 1000 * 100 / coalesce(CASE WHEN event_type <> 'view' THEN 524288.0 END, 1048576.0), 6) AS share,
      round(value * 1000 / 1024 / 1024, 9) AS gb FROM events""",
)
def shares(spark, folder):
    rss = F.col("value") * 1000
    limit = F.when(F.col("event_type") != "view", F.lit(524288.0))
    return table(spark, folder, "events").select(
        "event_id", F.round(memory_share(rss, limit, F.lit(1048576.0)), 6).alias("share"),
        F.round(kb_to_gb(rss), 9).alias("gb"),
    )
