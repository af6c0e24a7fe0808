"""Adaptive windowing (Bifet and Gavaldà 2007) over many keyed series.

The detector keeps exponential-histogram buckets, so its state grows with the
logarithm of the window.  A series is read in order as a stream of Arrow
batches and never held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

DELTA = 0.002
CLOCK = 32
MAX_BUCKETS = 5
MIN_SIDE = 5
GRACE = 10


class Adwin:
    """Change detector for the mean of a sequence."""

    def __init__(self, delta: float = DELTA, clock: int = CLOCK):
        self.delta, self.clock, self.ticks = delta, clock, 0
        # levels[i]: oldest-first (sum, spread) of buckets that merge 2**i values
        self.levels: list[list[tuple[float, float]]] = [[]]
        self.width, self.total, self.spread = 0, 0.0, 0.0

    def update(self, value: float) -> bool:
        """Add a value; True when the window's mean has changed."""
        self.ticks += 1
        if self.width:
            gap = value - self.total / self.width
            self.spread += self.width * gap * gap / (self.width + 1)
        self.width += 1
        self.total += value
        self.levels[0].append((value, 0.0))
        self._merge()
        if self.ticks % self.clock or self.width <= GRACE:
            return False
        changed = False
        while self._cut():
            changed = True
            self._drop_oldest()
        return changed

    def _merge(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) <= MAX_BUCKETS:
                return
            (s1, v1), (s2, v2) = level[0], level[1]
            del level[:2]
            n = 2 ** i
            gap = (s1 - s2) / n
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append((s1 + s2, v1 + v2 + n * gap * gap / 2))

    def _cut(self) -> bool:
        """Whether some split into old and recent differs beyond the bound."""
        if self.width <= GRACE:
            return False
        variance = self.spread / self.width
        log_term = math.log(2.0 * math.log(self.width) / self.delta)
        n0, sum0 = 0, 0.0
        for i in range(len(self.levels) - 1, -1, -1):
            for s, _ in self.levels[i]:
                n0, sum0 = n0 + 2 ** i, sum0 + s
                n1 = self.width - n0
                if n0 < MIN_SIDE:
                    continue
                if n1 < MIN_SIDE:
                    return False
                inverse = 1.0 / (n0 - MIN_SIDE + 1) + 1.0 / (n1 - MIN_SIDE + 1)
                bound = math.sqrt(2.0 * inverse * variance * log_term) + 2.0 / 3.0 * log_term * inverse
                if abs(sum0 / n0 - (self.total - sum0) / n1) > bound:
                    return True
        return False

    def _drop_oldest(self) -> None:
        while not self.levels[-1]:
            self.levels.pop()
        n = 2 ** (len(self.levels) - 1)
        s, v = self.levels[-1].pop(0)
        rest = self.width - n
        if rest:
            gap = s / n - (self.total - s) / rest
            self.spread -= v + n * rest * gap * gap / self.width
        self.spread = max(self.spread, 0.0)
        self.width, self.total = rest, self.total - s
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()


RESULT = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("n_values", T.LongType()),
    T.StructField("drifted", T.BooleanType()),
    T.StructField("n_detections", T.LongType()),
    T.StructField("drift_at_index", T.LongType()),
])


def detect(series: DataFrame, key: str, order: list[str], value: str, delta: float = DELTA) -> DataFrame:
    """Per key: whether the mean drifted and the index of the last detection.

    The detector restarts after each detection.  Sequences are inherently
    ordered; merge a busy key to time slots first (see ``slot_means``).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, detector, n, hits, last = None, None, 0, 0, None

        def row():
            return pd.DataFrame([[current, n, hits > 0, hits, last]], columns=RESULT.names).astype(
                {"drift_at_index": "Int64"})

        for pdf in batches:
            for k, v in zip(pdf["key"], pdf["value"]):
                if detector is None or k != current:
                    if detector is not None:
                        yield row()
                    current, detector, n, hits, last = k, Adwin(delta), 0, 0, None
                if detector.update(float(v)):
                    hits, last, detector = hits + 1, n, Adwin(delta)
                n += 1
        if detector is not None:
            yield row()

    ordered = (
        series.filter(F.col(value).isNotNull())
        .select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), *order)
        .repartition("key").sortWithinPartitions("key", *order).select("key", "value")
    )
    return ordered.mapInPandas(run, RESULT)


def slot_means(log: DataFrame, key: str, value: str, slot: str = "hour") -> DataFrame:
    """Mean per key and time slot, merged map-side: length is bounded by the time span."""
    return log.groupBy(key, F.date_trunc(slot, "timestamp").alias("slot")).agg(
        F.avg(value).alias("value"))
