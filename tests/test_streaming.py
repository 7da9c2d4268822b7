import datetime as dt

from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.operators import monitor
from themeloom.plans import queries_models
from themeloom.streaming import monitor as live
from themeloom.streaming.run import drain, stream_of

START = dt.datetime(2024, 1, 1)


def samples(spark, counts, host="h", first=0):
    rows = [(host, START + dt.timedelta(seconds=30 * (first + i)), c) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "host string, ts timestamp, count double")


COUNTS = [0.0, None, 0.0, 5.0, 5.0, None, 5.0, 9.0, 9.0, 3.0, 3.0, 3.0]


def streamed(spark, make, name):
    """Feeds two micro-batches, so that the second one starts from stored state."""
    work = Workspace(spark, "test-stream")
    whole = samples(spark, COUNTS)
    cut = F.lit(START + dt.timedelta(seconds=150))
    saved = work.save(whole.filter(F.col("ts") < cut), "in")
    out = drain(make(stream_of(spark, work, "in", saved)), work, name)
    whole.filter(F.col("ts") >= cut).write.mode("append").parquet(f"{work.root}/in")
    drain(make(stream_of(spark, work, "in", saved)), work, name)
    return spark.read.schema(out.schema).parquet(f"{work.root}/{name}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rates_of_batches_equal_rates_of_a_stream(spark):
    batch = monitor.counter_rate(samples(spark, COUNTS), bucket_sec=60)
    got = streamed(spark, live.stream_counter_rate, "rates")
    assert rows(got) == rows(batch.select(*got.columns))
    reset = batch.filter("reset").collect()
    assert [(r["count"], r["rate"]) for r in reset] == [(3.0, None)]


def test_idle_decisions_of_batches_equal_those_of_a_stream(spark):
    for idle, grace in [(1, 60), (0, 1), (0, 0), (60, 0)]:
        batch = monitor.idle_detector(samples(spark, COUNTS), idle, grace, bucket_sec=60)
        got = streamed(spark, lambda s: live.stream_idle_detector(s, idle, grace), f"idle-{idle}-{grace}")
        assert rows(got) == rows(batch.select(*got.columns)), (idle, grace)


def test_idle_timer_holds_and_resets(spark):
    got = monitor.idle_detector(samples(spark, COUNTS), 60, 60, bucket_sec=90).orderBy("ts").collect()
    assert [r["phase"] for r in got[:4]] == ["STARTUP"] * 3 + ["IDLE"]
    assert [r["startup_seconds"] for r in got[:3]] == [30, 60, 90]
    assert [r["idle_seconds"] for r in got[3:]] == [30, 60, 60, 90, 0, 30, 0, 30, 60]


def test_down_hosts_and_pool_totals(spark):
    seen = samples(spark, [0.0, 300.0, 300.0]).unionByName(samples(spark, [4.0], "g"))
    spine = monitor.with_missing(seen, F.array(F.lit("g"), F.lit("h"), F.lit("never")))
    states = monitor.host_status(monitor.counter_rate(spine))
    got = {(r["host"], r["ts"].minute * 60 + r["ts"].second): r["status"] for r in states.collect()}
    assert got[("h", 30)] == "BUSY" and got[("h", 60)] == "idle" and got[("never", 0)] == "DOWN"
    totals = {r["ts"].second: (r["total_rate"], r["n_busy"], r["n_hosts"]) for r in monitor.pool_totals(states).collect()}
    assert totals[30] == (10.0, 1, 3)


def test_heartbeat_phases(spark):
    beats = spark.createDataFrame(
        [("a", START + dt.timedelta(minutes=m)) for m in (1, 2, 20)], "host string, ts timestamp"
    )
    hosts = spark.createDataFrame([("a", START), ("b", START)], "host string, started timestamp")
    now = F.lit(START + dt.timedelta(minutes=90))
    got = {r["host"]: r for r in monitor.idle_detector_heartbeat(beats, hosts, now, 5, 60).collect()}
    assert got["a"]["phase"] == "IDLE" and got["a"]["stop_at"] == START + dt.timedelta(minutes=7) and got["a"]["stop"]
    assert got["b"]["phase"] == "STARTUP" and got["b"]["stop_at"] == START + dt.timedelta(minutes=60)
    off = {r["host"]: r for r in monitor.idle_detector_heartbeat(beats, hosts, now, 0, 0).collect()}
    assert not off["a"]["stop"] and not off["b"]["stop"]


def fed(spark, make, batches, name):
    """Every batch of (host, second, count) is one micro-batch."""
    work = Workspace(spark, "test-late")
    schema = "host string, ts timestamp, count double"
    out = None
    for batch in batches:
        rows = spark.createDataFrame([(h, START + dt.timedelta(seconds=s), c) for h, s, c in batch], schema)
        rows.coalesce(1).write.mode("append").parquet(f"{work.root}/in")
        out = drain(make(stream_of(spark, work, "in", rows)), work, name)
    return out


def test_late_samples_leave_the_rate_alone(spark):
    got = fed(spark, live.stream_counter_rate, [[("a", 0, 10.0), ("a", 60, 70.0)], [("a", 30, 20.0)], [("a", 120, 190.0)]], "rates")
    rates = {(r["ts"] - START).seconds: (r["rate"], r["reset"]) for r in got.collect()}
    assert rates == {0: (None, False), 60: (1.0, False), 30: (None, False), 120: (2.0, False)}


def test_late_samples_leave_the_idle_timer_alone(spark):
    batches = [[("a", 0, 5.0), ("a", 30, 5.0)], [("a", 15, 9.0)], [("a", 60, 5.0)]]
    got = fed(spark, lambda s: live.stream_idle_detector(s, 60, 60), batches, "idle")
    assert {(r["ts"] - START).seconds: r["idle_seconds"] for r in got.collect()} == {0: 30, 30: 60, 60: 90}


def test_silent_hosts_are_forgotten(spark):
    hours = 3600
    batches = [[("a", 0, 10.0), ("b", 0, 1.0)], [("b", 30 * hours, 2.0)], [("b", 31 * hours, 3.0)], [("a", 32 * hours, 20.0)]]
    got = fed(spark, lambda s: live.stream_counter_rate(s, "1 hour", "1 day"), batches, "rates")
    last = [r for r in got.collect() if r["host"] == "a" and r["count"] == 20.0]
    assert len(last) == 1 and last[0]["rate"] is None


def test_log_lines_arrive_apart(spark):
    """The two lines of a sample come in different micro-batches, the later one first."""
    work = Workspace(spark, "test-log-lines")
    rows = [("a", 7, "9 %, 2048 MiB"), ("a", 5, "--- 12:00:05 ---"), ("b", 7, "1 %, 1024 MiB"), ("a", 9, "3 %, 1 MiB")]
    process = "  etime=01:05    cpu= 99.5%  pod_mem= 92.1%  vsz=  80.2GB  rss=  49.3GB"
    later = [("a", 6, process), ("b", 5, process)]
    first, second = (spark.createDataFrame(x, "file string, line_no long, line string") for x in (rows, later))
    saved = work.save(first, "in")
    drain(monitor.typed_lines(stream_of(spark, work, "in", saved)), work, "typed")
    second.write.mode("append").parquet(f"{work.root}/in")
    typed = drain(monitor.typed_lines(stream_of(spark, work, "in", saved)), work, "typed")
    got = sorted(monitor.pair_typed_lines(typed).select("file", "line_no", "gpu_gib", "danger").collect())
    assert [tuple(r) for r in got] == [("a", 6, 2.0, True), ("b", 5, None, True)]


def test_stream_query_collects_no_log(spark, folder, monkeypatch):
    saved = []
    monkeypatch.setattr(queries_models, "stream_of", lambda s, w, name, table: saved.append(table) or stream_of(s, w, name, table))
    assert queries_models.stream_resource_series(spark, folder).count()
    assert saved[0].columns == ["file", "line_no", "line"]


def test_timers_of_many_hosts_share_a_bucket(spark):
    """The same decisions whatever the buckets; the state has a row for each bucket, not for each host."""
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    names = [f"h{i}" for i in range(60)]
    beats = [(h, at(1 + (7 * i * k) % (40 + i)), False) for i, h in enumerate(names) for k in range(i % 5)]
    beats += [("h1", at(1), False), (None, at(3), False), ("end", at(300), False)]
    born = [(h, START, True) for h in names]
    for buckets in (1, 3, 1000):
        work = Workspace(spark, "test-buckets")
        got = None
        for low, high in ((-1, 20), (20, 45), (45, 1000)):
            part = [r for r in born + beats if at(low) <= r[1] < at(high)]
            rows_in = spark.createDataFrame(part, "host string, ts timestamp, born boolean")
            rows_in.coalesce(1).write.mode("append").parquet(f"{work.root}/in")
            stream = stream_of(spark, work, "in", rows_in)
            got = drain(live.stream_idle_heartbeat(stream, 5, 30, "0 seconds", buckets=buckets), work, "out")
        found = {r["host"]: (r["phase"], r["last_beat"], r["stop_at"]) for r in got.collect()}
        assert got.count() == len(found)

        def decided(host):
            times = sorted(t for h, t, _ in beats if h == host)
            if host in names and (not times or times[0] >= at(30)):
                return "STARTUP", None, at(30)
            run = [times[0]]
            for t in times[1:]:
                if t >= run[-1] + dt.timedelta(minutes=5):
                    break
                run.append(t)
            return "IDLE", run[-1], run[-1] + dt.timedelta(minutes=5)

        assert found == {h: decided(h) for h in [*names, None]}
    held = spark.read.format("statestore").load(f"{work.root}/out-checkpoint")
    assert held.count() == held.select("key").distinct().count() <= 62
    assert held.selectExpr("sum(size(value.groupState.hosts)) AS n").first()["n"] == 62
