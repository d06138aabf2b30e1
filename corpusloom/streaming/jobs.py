"""Structured Streaming: incremental ingestion, request statistics with watermarks, and a stateful rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import index


def ingest_stream(chunks: DataFrame, root: str, checkpoint: str):
    """A stream of chunk rows kept up to date in the index at `root`; repeating a batch changes nothing."""
    return chunks.writeStream.foreachBatch(lambda df, _: index.ingest(root, df)).option("checkpointLocation", checkpoint)


def windowed_requests(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and type; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def rate_limiter(requests: DataFrame, per_minute: int = 30) -> DataFrame:
    """(event_id, user_id, allowed, wait_s) of a stream of requests (event_id, user_id, ts), one token bucket per user."""
    rate, full = per_minute / 60.0, float(per_minute)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        tokens, last = state.get if state.exists else (full, None)
        ok, wait = [], []
        for t in (b["ts"].astype("int64") / 1e9 if str(b["ts"].dtype).startswith("datetime64[ns") else b["ts"].astype("datetime64[ns]").astype("int64") / 1e9):
            tokens = min(full, tokens + max(0.0, t - (t if last is None else last)) * rate)
            last = t
            ok.append(tokens >= 1)
            wait.append(0.0 if tokens >= 1 else (1 - tokens) / rate)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({"event_id": b["event_id"], "user_id": key[0], "allowed": ok, "wait_s": wait})

    return requests.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(fold, "event_id long, user_id long, allowed boolean, wait_s double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
