"""Streams of events and requests. Everything that waits has an event-time bound, so that state doesn't grow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.advise import advise

STATE = "interaction string, seq int, at timestamp, type string, before array<string>"


def advice(requests: DataFrame, obligations: DataFrame, recommendations: DataFrame, log: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Answers each batch of requests against the rules and hands the answers to `log`, by batch number."""

    def answer(batch: DataFrame, number: int) -> None:
        log(advise(batch, obligations, recommendations), number)

    return requests.writeStream.foreachBatch(answer)


def live_coverage(answers: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, verdict, answers, once a window is over. answers: at, verdict."""
    return answers.withWatermark("at", late).groupBy(F.window("at", window), "verdict").agg(F.count("*").alias("answers"))


def live_sessions(events: DataFrame, gap: str = "1 day", late: str = "1 hour") -> DataFrame:
    """interaction, session (window), events, of events (interaction, at) without episodes."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), "interaction").agg(F.count("*").alias("events"))


def live_before(events: DataFrame, late: str = "1 hour", forget: str = "7 days") -> DataFrame:
    """events (interaction, at, type) with seq and before: the different types that the contact had until then.

    A contact's state is its types and a count; it is dropped when the watermark is `forget` past its last event.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        types, seq = state.get if state.exists else ([], 0)
        types, out, last = list(types), [], 0
        rows = pd.concat(list(frames)).sort_values(["at", "type"])
        for at, kind in zip(rows["at"], rows["type"]):
            out.append((key[0], seq, at, kind, list(types)))
            seq, last = seq + 1, max(last, int(at.timestamp() * 1000))
            if kind not in types:
                types.append(kind)
        state.update((types, seq))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=["interaction", "seq", "at", "type", "before"])

    return events.withWatermark("at", late).groupBy("interaction").applyInPandasWithState(step, STATE, "types array<string>, seq int", "append", GroupStateTimeout.EventTimeTimeout)


def late_outcomes(points: DataFrame, outcomes: DataFrame, lag: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Decision points (interaction, at, action) with the outcome that came within `lag`, or null once none can come."""
    left = points.withWatermark("at", late).alias("p")
    right = outcomes.withWatermark("outcome_at", late).alias("o")
    within = F.expr(f"p.interaction = o.interaction AND o.outcome_at >= p.at AND o.outcome_at <= p.at + INTERVAL {lag}")
    return left.join(right, within, "leftOuter").select("p.interaction", "p.at", "p.action", "o.outcome", "o.outcome_at")
