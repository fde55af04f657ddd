"""Custom state: moves, and tile states with backoff.

State is kept per key; each key's state is a few numbers.  Rows of a batch are taken in event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _rows(parts: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(by, kind="stable")


def moves(events: DataFrame, share: float = 0.001) -> DataFrame:
    """Events (user, ts, x, y, zoom, distance) at which the target changed or the distance did by more than ``share``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for r in _rows(parts, ["ts"]).itertuples(index=False):
            moved = last is None or (r.x, r.y) != last[:2]
            zoomed = last is not None and abs(r.distance - last[2]) > share * last[2]
            if moved or zoomed:
                out.append((key[0], r.ts, moved, zoomed))
            last = (float(r.x), float(r.y), float(r.distance))
        state.update(last)
        yield pd.DataFrame(out, columns=["user", "ts", "moved", "zoomed"])

    return events.groupBy("user").applyInPandasWithState(run, "user string, ts timestamp, moved boolean, zoomed boolean", "x double, y double, distance double", "append", GroupStateTimeout.NoTimeout)


def tile_states(results: DataFrame, first_s: int = 10, most_s: int = 160) -> DataFrame:
    """State of a tile after each result (key, ts, status): loaded, waiting with the time of the next try, or failed for ever (404, 410)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, gone = state.get if state.exists else (0, False)
        out = []
        for r in _rows(parts, ["ts"]).itertuples(index=False):
            if gone:
                name, wait = "failed", None
            elif r.status == 200:
                n, name, wait = 0, "loaded", None
            elif r.status in (404, 410):
                gone, name, wait = True, "failed", None
            else:
                n += 1
                name, wait = "waiting", r.ts + pd.Timedelta(seconds=min(first_s * 2 ** min(n - 1, 30), most_s))
            out.append((key[0], r.ts, name, n, wait))
        state.update((n, gone))
        yield pd.DataFrame(out, columns=["key", "ts", "state", "attempts", "next_try"])

    return results.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, state string, attempts int, next_try timestamp", "n int, gone boolean", "append", GroupStateTimeout.NoTimeout)
