"""Collapse points of growing runs as a stream: each group's curve is state, and a change of its collapse point is an event.

Each task adds up its part of a batch by group and level before anything is
shuffled, so a group that holds most rows is a few of them for each task. The
state of a group is ten counts, however many runs it has; a group that is silent
for `idle` of event time is closed by a timer, with a last event, and its state
is dropped. Of a task's part, rows later than the watermark are dropped if all of
it is. Every run of the stream counts; runs arrive once if they come through a
ledger (sources.results).

The baseline is given: its runs end before those under stress begin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregates import COLLAPSE, CUTOFF, LEVELS, correct

EVENTS = "category string, cp string, n long, closed boolean, at timestamp"


def _rounded(hits: int, n: int) -> float:
    """As Spark rounds a double: half up on its decimal digits."""
    return float(Decimal(repr(hits / n)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def collapse_of(hits: list[int], n: list[int], tau: float) -> str | None:
    """The first level whose accuracy is below tau."""
    return next((v for v, h, m in zip(LEVELS, hits, n) if m and _rounded(h, m) < tau), None)


def partial_counts(runs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """category, level, hits, n, ts (the latest) of each task's rows of a batch."""
    rows = runs.where("category IS NOT NULL").where(F.col("level").isin(*LEVELS)).select("category", "level", correct(F.col("sim"), cutoff).cast("long").alias("hit"), "ts")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, n, last = Counter(), Counter(), {}
        for b in batches:
            for key, own in b.groupby(["category", "level"]):
                hits[key] += int(own["hit"].sum())
                n[key] += len(own)
                last[key] = max(own["ts"].max(), last.get(key, own["ts"].max()))
        if n:
            yield pd.DataFrame([(*k, hits[k], n[k], last[k]) for k in n], columns=["category", "level", "hits", "n", "ts"])

    return rows.mapInPandas(count, "category string, level string, hits long, n long, ts timestamp")


def collapse_points(runs: DataFrame, baseline: float, late: str = "1 hour", idle_ms: int = 86_400_000, cutoff: float = CUTOFF) -> DataFrame:
    """Events (category, cp, n, closed, at): a group's new collapse point, null for none, whenever it changes, and at its closing.

    runs: a stream of ts, category, level, sim; baseline: the accuracy at L0, to four places.
    """
    tau = COLLAPSE * baseline
    counts = partial_counts(runs, cutoff).withWatermark("ts", late)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, n, last, known = state.get if state.exists else ([0] * len(LEVELS), [0] * len(LEVELS), "", 0)
        hits, n = list(hits), list(n)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], last or None, sum(n), True, pd.Timestamp(known, unit="ms"))], columns=["category", "cp", "n", "closed", "at"])
            return
        for p in parts:
            for level, h, m, ts in zip(p["level"], p["hits"], p["n"], p["ts"]):
                i = LEVELS.index(level)
                hits[i] += int(h)
                n[i] += int(m)
                known = max(known, int(ts.timestamp() * 1000))
        now = collapse_of(hits, n, tau)
        new = not state.exists or (now or "") != last
        state.update((hits, n, now or "", known))
        state.setTimeoutTimestamp(max(known + idle_ms, state.getCurrentWatermarkMs() + 1))
        if new:
            yield pd.DataFrame([(key[0], now, sum(n), False, pd.Timestamp(known, unit="ms"))], columns=["category", "cp", "n", "closed", "at"])

    return counts.groupBy("category").applyInPandasWithState(follow, EVENTS, "hits array<long>, n array<long>, cp string, known long", "append", GroupStateTimeout.EventTimeTimeout)
