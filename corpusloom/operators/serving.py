"""Statistics and state of serving: counters, latency histograms, rate limits, answer cache."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def latency_histogram(rows: DataFrame, seconds: str, *labels: str) -> DataFrame:
    """Cumulative counts per upper bound, with sum and count."""
    out = rows.where(F.col(seconds).isNotNull()).groupBy(*labels).agg(*[F.count_if(F.col(seconds) <= x).alias(f"b{i}") for i, x in enumerate(C.LATENCY_BUCKETS)], F.count("*").alias("count"), F.round(F.sum(seconds), 6).alias("sum"))
    pairs = F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"b{i}").alias("n")) for i, x in enumerate(C.LATENCY_BUCKETS)])
    return out.select(*labels, F.explode(pairs).alias("p"), "count", "sum").select(*labels, "p.le", "p.n", "count", "sum")


def rate_limited(requests: DataFrame, user: str = "user_id", at: str = "ts", per_minute: int = 30, key: str = "event_id") -> DataFrame:
    """(key, user, allowed, wait_s): a token bucket per user over its requests in order. A new user starts full, refused
    requests still advance the clock; a limit of 0 or less allows all.

    Requests of one user are folded in time order within the user's own array; ids break ties of time."""
    e = requests.dropDuplicates([key]).where(F.col(at).isNotNull())
    if per_minute <= 0:
        return e.select(key, user, F.lit(True).alias("allowed"), F.lit(0.0).alias("wait_s"))
    rate, full = per_minute / 60.0, float(per_minute)

    def run(batches):
        who, tokens, last = None, full, 0.0
        for b in batches:
            ok, wait = [], []
            for u, t in zip(b["u"], b["t"], strict=True):
                if u != who:
                    who, tokens, last = u, full, t
                tokens = min(full, tokens + (t - last) * rate)
                last = t
                allowed = tokens >= 1
                ok.append(allowed)
                wait.append(0.0 if allowed else (1 - tokens) / rate)
                tokens -= allowed
            yield pd.DataFrame({key: b["k"], user: b["u"], "allowed": ok, "wait_s": wait})

    kk, uk = e.schema[key].dataType.simpleString(), e.schema[user].dataType.simpleString()
    ordered = e.select(F.col(key).alias("k"), F.col(user).alias("u"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t")).repartition("u").sortWithinPartitions("u", "t", "k")
    return ordered.mapInPandas(run, f"{key} {kk}, {user} {uk}, allowed boolean, wait_s double")


def cache_outcomes(requests: DataFrame, cache_key: str, at: str = "ts", ttl_s: float = 600.0, key: str = "event_id") -> DataFrame:
    """(key, cache_key, hit): an entry set on a miss serves until its age passes `ttl_s`; a hit doesn't extend it. The
    entries of one key are folded in time order; the number of entries isn't bounded."""
    e = requests.dropDuplicates([key]).where(F.col(at).isNotNull())

    def run(batches):
        who, until = None, None
        for b in batches:
            hit = []
            for c, t in zip(b["c"], b["t"], strict=True):
                if c != who:
                    who, until = c, None
                hit.append(until is not None and until >= t)
                if not hit[-1]:
                    until = t + ttl_s
            yield pd.DataFrame({key: b["k"], cache_key: b["c"], "hit": hit})

    kk, ck = e.schema[key].dataType.simpleString(), e.schema[cache_key].dataType.simpleString()
    ordered = e.select(F.col(key).alias("k"), F.col(cache_key).alias("c"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t")).repartition("c").sortWithinPartitions("c", "t", "k")
    return ordered.mapInPandas(run, f"{key} {kk}, {cache_key} {ck}, hit boolean")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total)."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, n): events of a user less than `gap` apart."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
