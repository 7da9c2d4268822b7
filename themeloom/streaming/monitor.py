"""Live counter rates, idle decisions and resource series.

The samples of a host are put in order by time within a micro-batch. A sample that arrives after a
later one of its host has been used is late: it is shown without a rate, or left out of the idle
decision, and the state stays as it is. Rows older than the watermark, which follows the newest
time of any host, are dropped by Spark; set it above the largest delay between hosts. A host that
has been silent for ``forget`` of event time loses its state, so state is bounded by the hosts
seen lately. Batch forms of the same operators are in ``themeloom.operators.monitor``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from themeloom.operators.monitor import IDLE_MIN, POLL_SEC, STARTUP_GRACE_MIN

RATE_SCHEMA = "host string, ts timestamp, count double, rate double, reset boolean"
IDLE_SCHEMA = (
    "host string, ts timestamp, count double, phase string, startup_seconds long, idle_seconds long, stop boolean"
)
BEAT_SCHEMA = "host string, phase string, last_beat timestamp, stop_at timestamp, stop boolean"


FORGET = "7 days"  # silence after which a host's state goes
HOST_BUCKETS = 4_096  # groups of hosts whose timers are kept together, since a call of Python costs more than a host


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("ts", kind="stable")


def _remember(state: GroupState, last_ts: int, forget: str) -> None:
    due = int((last_ts + pd.Timedelta(forget).total_seconds()) * 1000)
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def stream_counter_rate(samples: DataFrame, watermark: str = "1 hour", forget: str = FORGET) -> DataFrame:
    """Rate per second from the reading before, kept per host. ``samples(host, ts, count)`` has
    a row with a null count for a pass that could not be read. A late sample has no rate."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_ts, last = state.get if state.exists else (None, None)
        rows = []
        for ts, count in _in_order(frames)[["ts", "count"]].itertuples(index=False):
            now, value = int(ts.timestamp()), None if pd.isna(count) else float(count)
            rate, reset = None, False
            if last_ts is not None and now <= last_ts:
                rows.append((key[0], ts, value, rate, reset))
                continue
            if last is not None and value is not None:
                reset = value < last
                if not reset:
                    # Half away from zero, as the SQL round does.
                    rate = int((value - last) / (now - last_ts) * 10 + 0.5) / 10
            rows.append((key[0], ts, value, rate, reset))
            last_ts, last = now, value
        state.update((last_ts, last))
        _remember(state, last_ts, forget)
        out = pd.DataFrame(rows, columns=["host", "ts", "count", "rate", "reset"])
        yield out.astype({"count": "float64", "rate": "float64"})

    return (
        samples.withWatermark("ts", watermark).groupBy("host").applyInPandasWithState(
            step, RATE_SCHEMA, "last_ts long, last double", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def stream_idle_detector(
    samples: DataFrame,
    idle_min: float = IDLE_MIN,
    startup_grace_min: float = STARTUP_GRACE_MIN,
    poll_sec: int = POLL_SEC,
    watermark: str = "1 hour",
    forget: str = FORGET,
) -> DataFrame:
    """The two-phase idle decision as a state machine per host; nothing follows a stop. Late
    samples don't count."""
    idle_limit, startup_limit = int(idle_min * 60), int(startup_grace_min * 60)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = (None, False, None, 0, 0, False)
        last_ts, served, last, idle, startup, stopped = state.get if state.exists else first
        rows = []
        for ts, count in _in_order(frames)[["ts", "count"]].itertuples(index=False):
            now = int(ts.timestamp())
            if last_ts is not None and now <= last_ts:
                continue
            last_ts = now
            if stopped:
                continue
            shown = None if pd.isna(count) else float(count)
            value = shown if shown is not None and shown >= 0 else None
            if not served and value is not None and value > 0:
                served, last, idle = True, value, 0
            if not served:
                startup += poll_sec
                stopped = 0 < startup_limit <= startup
                rows.append((key[0], ts, shown, "STARTUP", startup, None, stopped))
                continue
            if value is not None:
                idle, last = (idle + poll_sec, last) if value == last else (0, value)
            stopped = 0 < idle_limit <= idle
            rows.append((key[0], ts, shown, "IDLE", None, idle, stopped))
        state.update((last_ts, served, last, idle, startup, stopped))
        _remember(state, last_ts, forget)
        names = ["host", "ts", "count", "phase", "startup_seconds", "idle_seconds", "stop"]
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"count": "float64", "startup_seconds": "Int64", "idle_seconds": "Int64", "stop": "bool"})

    kept = "last_ts long, served boolean, last double, idle long, startup long, stopped boolean"
    return (
        samples.withWatermark("ts", watermark).groupBy("host").applyInPandasWithState(
            step, IDLE_SCHEMA, kept, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def stream_idle_heartbeat(
    beats: DataFrame,
    idle_min: float = IDLE_MIN,
    startup_grace_min: float = STARTUP_GRACE_MIN,
    watermark: str = "1 hour",
    buckets: int = HOST_BUCKETS,
) -> DataFrame:
    """One decision row per host when its limit has passed in event time.

    Beats of a host may lag behind those of other hosts by ``watermark``; older ones are lost, so
    take it above the largest delay. Decisions wait for as long.

    ``beats(host, ts, born)``: a host is announced by a row with ``born`` true, whose time starts
    its grace; every later row is activity. The timer follows the watermark, so a quiet host is
    decided as soon as any other host's time has moved past its limit.

    Hosts are dealt by hash into ``buckets``; the state of a bucket lists its hosts, and its timer is the earliest of theirs.
    """
    idle_us, grace_us = int(idle_min * 60e6), int(startup_grace_min * 60e6)

    def limit_of(served, started, last):
        if served:
            return last + idle_us if idle_us > 0 else None
        return started + grace_us if started is not None and grace_us > 0 else None

    def rows_by_host(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        rows = _in_order(frames)
        code, names = pd.factorize(rows["host"], use_na_sentinel=False)
        order = np.argsort(code, kind="stable")
        at = (rows["ts"].to_numpy().astype("datetime64[ns]").astype(np.int64) // 1000)[order]
        born = rows["born"].to_numpy()[order]
        ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(names))))
        for n, name in enumerate(names):
            own = slice(ends[n], ends[n + 1])
            yield None if pd.isna(name) else name, at[own].tolist(), born[own].tolist()

    def after(host: tuple, at: list[int], born: list[bool]) -> tuple:
        served, started, last, stopped = host
        for now, is_born in zip(at, born):
            due = limit_of(served, started, last)
            stopped = stopped or (due is not None and now >= due)
            if stopped:
                break
            if is_born:
                started = now if started is None else started
            else:
                served, last = True, now
        return served, started, last, stopped

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hosts = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        open_before = {h for h, x in hosts.items() if not x[3]}
        if not state.hasTimedOut:
            for name, at, born in rows_by_host(frames):
                if name not in hosts:
                    hosts[name] = (False, None, None, False)
                    open_before.add(name)
                if not hosts[name][3]:
                    hosts[name] = after(hosts[name], at, born)
        watermark_ms, found, waiting = state.getCurrentWatermarkMs(), [], []
        for name in open_before:
            served, started, last, stopped = hosts[name]
            due = limit_of(served, started, last)
            if stopped or (due is not None and due // 1000 < watermark_ms):
                hosts[name] = (served, started, last, True)
                found.append((name, "IDLE" if served else "STARTUP", last if served else None, due))
            elif due is not None:
                waiting.append(due // 1000)
        state.update((list(hosts), *map(list, zip(*hosts.values()))))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting), watermark_ms + 1))
        if found:
            out = pd.DataFrame(found, columns=["host", "phase", "last_beat", "stop_at"])
            for c in ("last_beat", "stop_at"):
                out[c] = pd.to_datetime(out[c].astype("Int64"), unit="us")
            yield out.assign(stop=True)

    kept = "hosts array<string>, served array<boolean>, started array<long>, last array<long>, stopped array<boolean>"
    dealt = beats.withWatermark("ts", watermark).select(
        F.pmod(F.xxhash64("host"), F.lit(buckets)).alias("bucket"), F.col("host").cast("string").alias("host"), "ts", "born"
    )
    return dealt.groupBy("bucket").applyInPandasWithState(step, BEAT_SCHEMA, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_sessions(beats: DataFrame, idle_min: float = IDLE_MIN, watermark: str = "1 hour") -> DataFrame:
    """``(host, started, ended, n_beats, idle_at)``: the runs of activity of ``beats(host, ts)`` that have ended.

    The same runs as ``heartbeat_sessions``. A run is given out when the watermark has passed its idle limit, so
    that the last run of a quiet table comes when another host's time moves on. Spark keeps one row for
    each open run and host, and merges runs as beats between them arrive; beats behind the watermark are dropped.
    """
    # A window reaches the gap after its last beat, and one that begins there is the next.
    runs = beats.withWatermark("ts", watermark).groupBy("host", F.session_window("ts", f"{int(idle_min * 60_000_000)} microseconds"))
    found = runs.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_beats"))
    return found.select("host", "started", "ended", "n_beats", F.col("session_window.end").alias("idle_at"))
