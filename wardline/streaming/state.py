"""Keyed state of the live path: recent events of a user, change detectors."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.functions.scalars import EARTH_RADIUS_KM
from wardline.operators.adwin import DELTA, Adwin
from wardline.operators.context import (FAILURE_WINDOW_S, LOOKBACK_ROWS, MAX_SPEED_KMH, MIN_HOURS,
                                        SPEED_CAP_KMH)
from wardline.session import ROCKSDB_PROVIDER

STATE_TTL_MS = 90 * 86_400_000
#: Groups of users that share a call; the state stays one of each user.
GROUPS = 1 << 10

CONTEXT_FIELDS = [
    T.StructField("session_resource_count", T.IntegerType()),
    T.StructField("rapid_failure_count", T.IntegerType()),
    T.StructField("travel_speed_kmh", T.DoubleType()),
    T.StructField("is_impossible_travel", T.IntegerType()),
    T.StructField("city_changed", T.IntegerType()),
]


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, max(0.0, a))))


class RecentEvents(StatefulProcessor):
    """The look-back features of users' events, across micro-batches.

    State per user: the last events before the newest instant, those at it, and
    the previous event, so it stays below 2 x 30 entries.  A call serves a whole
    group of users, and the state of each is read and written once in it.
    """

    def __init__(self, columns: list[str], expire: bool):
        self.columns, self.expire = columns, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("user", T.StringType())])
        schema = T.StructType([T.StructField("recent", T.StringType()), T.StructField("prev", T.StringType())])
        self.state = (handle.getMapState("users", key, schema, STATE_TTL_MS) if self.expire
                      else handle.getMapState("users", key, schema))

    def _context(self, user: tuple[str], events) -> list[tuple]:
        recent, prev = [], None
        stored = self.state.getValue(user)
        if stored is not None:
            recent, prev = json.loads(stored[0]), json.loads(stored[1])
        found = []
        for us, ip, city, lat, lon, resource, success in events:
            us = int(us)
            before = [r for r in recent if r[0] < us][-LOOKBACK_ROWS:]
            since = us - FAILURE_WINDOW_S * 1_000_000
            speed = 0.0
            if prev is not None:
                hours = max((us - prev[3]) / 3.6e9, MIN_HOURS)
                speed = _km(prev[1], prev[2], lat, lon) / hours
            found.append((
                len({r[1] for r in before}) + 1,
                sum(1 for r in before if r[0] >= since and r[2] == ip and not r[3]),
                min(max(speed, 0.0), SPEED_CAP_KMH), int(speed > MAX_SPEED_KMH),
                int(prev is not None and prev[0] != city)))
            recent.append([us, resource, ip, bool(success)])
            newest = max(r[0] for r in recent)
            recent = ([r for r in recent if r[0] < newest][-LOOKBACK_ROWS:]
                      + [r for r in recent if r[0] == newest][-LOOKBACK_ROWS:])
            prev = [city, lat, lon, us]
        self.state.updateValue(user, (json.dumps(recent), json.dumps(prev)))
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        # A map's key is never null: ids have a mark in front.
        users = ("" if null else f"u{u}" for u, null in zip(events["user_id"], events["user_id"].isna()))
        columns = [events[c].tolist() for c in (
            "at_us", "source_ip", "geo_city", "geo_lat", "geo_lon", "resource_accessed", "success")]
        places = {}
        for i, user in enumerate(users):
            places.setdefault(user, []).append(i)
        found = [None] * len(events)
        for user, at in places.items():
            for i, context in zip(at, self._context((user,), zip(*[[c[i] for i in at] for c in columns]))):
                found[i] = context
        context = pd.DataFrame(found, columns=[f.name for f in CONTEXT_FIELDS], index=events.index)
        yield pd.concat([events, context], axis=1)[self.columns]

    def close(self) -> None:
        pass


def with_live_context(events: DataFrame, expire: bool = True, groups: int = GROUPS) -> DataFrame:
    """Context columns from per-user state, the streaming twin of the windows.

    ``expire`` drops the state of users silent for ``STATE_TTL_MS``.  Expiry
    runs on processing time, which keeps a query going, so a run that is meant
    to end (a replay of given files) goes without.  ``groups`` must stay the
    same for the life of a checkpoint.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    rows = events.withColumns({"at_us": F.unix_micros("timestamp"), "__group": F.pmod(F.xxhash64("user_id"), F.lit(groups))})
    schema = T.StructType([*events.schema.fields, *CONTEXT_FIELDS])
    return rows.groupBy("__group").transformWithStateInPandas(
        RecentEvents(schema.names, expire), schema, "Append", "ProcessingTime" if expire else "None")


class MeanWatch(StatefulProcessor):
    """Adaptive window per key over a live series."""

    def __init__(self, delta: float = DELTA):
        self.delta = delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", T.StructType([T.StructField("window", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values = pd.concat(list(rows)).sort_values(["at_us", "tie"])
        watch, n = Adwin(self.delta), 0
        if self.state.exists():
            kept = json.loads(self.state.get()[0])
            n = kept.pop("n")
            watch.__dict__.update(kept)
            watch.levels = [[tuple(b) for b in level] for level in watch.levels]
        hits = []
        for v in values["value"]:
            if watch.update(float(v)):
                hits.append((key[0], n))
                watch = Adwin(self.delta)
            n += 1
        self.state.update((json.dumps({**watch.__dict__, "n": n}),))
        yield pd.DataFrame(hits, columns=["key", "drift_at_index"])

    def close(self) -> None:
        pass


def drift_events(events: DataFrame, key: str, value: str, tie: str = "event_id") -> DataFrame:
    """One row per detected change of a keyed live series."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    series = events.select(
        F.col(key).cast("string").alias("key"), F.unix_micros("timestamp").alias("at_us"),
        F.col(tie).alias("tie"), F.col(value).cast("double").alias("value"))
    return series.groupBy("key").transformWithStateInPandas(
        MeanWatch(), "key string, drift_at_index bigint", "Append", "None")
