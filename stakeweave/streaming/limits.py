"""Sliding-window rate limits with escalating lockouts, as a keyed stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Lockouts in seconds, one after another.
LOCKOUTS = (900, 3600, 14400, 86400)


def decide(stamps: list[float], until: float, count: int, now: float, most: int, window: int) -> tuple[bool, list[float], float, int]:
    """Whether an attempt at ``now`` is allowed, and the key's state after it."""
    if now < until:
        return False, stamps, until, count
    recent = [t for t in stamps if t > now - window]
    if len(recent) >= most:
        lock = LOCKOUTS[min(count, len(LOCKOUTS) - 1)]
        return False, [], now + lock, count + 1
    return True, [*recent, now], 0.0, count


def rate_limit(events: DataFrame, most: int, window: int = 3600) -> DataFrame:
    """``key, ts, allowed`` of a stream (or table) of ``key, ts`` (seconds); state is at most ``most`` stamps a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, until, count = state.get if state.exists else ([], 0.0, 0)
        stamps = list(stamps)
        for frame in frames:
            allowed = []
            frame = frame.sort_values("ts", kind="stable")
            for now in frame["ts"]:
                ok, stamps, until, count = decide(stamps, until, count, float(now), most, window)
                allowed.append(ok)
            yield pd.DataFrame({"key": frame["key"], "ts": frame["ts"], "allowed": allowed})
        state.update((stamps, until, count))

    return events.groupBy("key").applyInPandasWithState(
        step, "key string, ts double, allowed boolean", "stamps array<double>, until double, count int", "append", GroupStateTimeout.NoTimeout
    )
