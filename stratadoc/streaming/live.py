"""Structured Streaming: answers parsed from token streams, usage counters and quotas on events as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratadoc.operators.answers import State, advance, finish
from stratadoc.operators.usage import DAILY_LIMIT

_STATE = "waiting string, everything string, cited boolean, seq int"
_EVENTS = "session string, seq int, type string, text string, n int, raw string"


def parse_tokens(tokens: DataFrame, idle_ms: int = 300_000) -> DataFrame:
    """Events of token streams (``session string, at bigint, token string, done boolean, ts timestamp``), state
    kept for each session: what waits, all there was and whether a source was cited. A session ends with
    ``done``, or when the watermark has passed its last token by ``idle_ms``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, seq = state.get if state.exists else (*State(), 0)
        now, events, done = State(*held), [], state.hasTimedOut
        rows = pd.concat([b for b in batches]) if not state.hasTimedOut else None
        if rows is not None:
            for r in rows.sort_values("at").itertuples():
                now, new = advance(now, r.token or "")
                events, done = events + new, done or bool(r.done)
        if done:
            events += finish(now)
            state.remove()
        else:
            state.update((*now, seq + len(events)))
            latest = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        if events:
            columns = {c: [e.get(c) for e in events] for c in ("type", "text", "n", "raw")}
            out = pd.DataFrame({"session": key[0], "seq": range(seq, seq + len(events)), **columns})
            yield out.astype({"n": "Int32"})

    timed = tokens.withWatermark("ts", f"{idle_ms} milliseconds")
    return timed.groupBy("session").applyInPandasWithState(step, _EVENTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def usage_counts(events: DataFrame, delay: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts by hour (or ``width``) and event type. The watermark, which batch counting has no need of, is ours."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def admitted(events: DataFrame, limit: int = DAILY_LIMIT, delay: str = "1 day") -> DataFrame:
    """Requests (``client string, ts timestamp``) with ``allowed``: the first ``limit`` of a client's day in order
    of arrival. State is one number for each client and day, dropped with the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count = state.get[0] if state.exists else 0
        for rows in batches:
            place = count + pd.Series(range(1, len(rows) + 1), index=rows.index)
            count += len(rows)
            yield pd.DataFrame({"client": rows["client"], "ts": rows["ts"], "allowed": place <= limit})
        state.update((count,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(pd.Timestamp(key[1]).timestamp() * 1000)) + 2 * 86_400_000)

    keyed = events.withWatermark("ts", delay).withColumn("day", F.to_date("ts")).groupBy("client", "day")
    return keyed.applyInPandasWithState(step, "client string, ts timestamp, allowed boolean", "n bigint", "append", GroupStateTimeout.EventTimeTimeout)
