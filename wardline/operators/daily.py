"""Baselines and drift kept up day by day.

A day of the log is reduced to partials that can be merged: moments per user,
counts per user and set value, counts per user and hour.  A refresh reads one
day of the log, the state of the day before and, for drift, the few days whose
part in the windows changes; it never reads the log again.

A repeated or corrected day replaces its partials; the state is then folded
anew from the partials, which are far smaller than the log.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wardline.operators.baselines import MAX_SET, joined_baselines, normal_rows, value_pairs
from wardline.operators.drift import WINDOW_DAYS, ks_of_counts, with_pvalue
from wardline.sources.stores import read_document, write_document

MEASURES = {"hour": "hour(timestamp)", "session_s": "session_duration_s", "bytes": "bytes_transferred"}
DAY_US = 86_400_000_000


# --- baselines --------------------------------------------------------------------

def day_numbers(log: DataFrame) -> DataFrame:
    """Per (day, user): rows, failures, (count, mean, M2) of each measure and the latest role."""
    moments = []
    for m in MEASURES:
        x = F.expr(MEASURES[m]).cast("double")
        moments += [F.count(x).alias(f"n_{m}"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"mean_{m}"),
                    F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias(f"m2_{m}")]
    return normal_rows(log).groupBy(F.to_date("timestamp").alias("day"), "user_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"), *moments,
        F.max(F.struct("timestamp", "event_id", "role")).alias("last"))


def merged_numbers(parts: DataFrame) -> DataFrame:
    """One row per user from any number of partials: squares add up around the common mean."""
    own = W.partitionBy("user_id")
    means = {f"all_{m}": F.coalesce(F.try_divide(F.sum(F.col(f"n_{m}") * F.col(f"mean_{m}")).over(own), F.sum(f"n_{m}").over(own)), F.lit(0.0))
             for m in MEASURES}
    moments = []
    for m in MEASURES:
        away = F.col(f"mean_{m}") - F.col(f"all_{m}")
        moments += [F.sum(f"n_{m}").alias(f"n_{m}"), F.first(f"all_{m}").alias(f"mean_{m}"),
                    F.sum(F.col(f"m2_{m}") + F.col(f"n_{m}") * away * away).alias(f"m2_{m}")]
    return parts.withColumns(means).groupBy("user_id").agg(
        F.sum("event_count").alias("event_count"), F.sum("failures").alias("failures"), *moments, F.max("last").alias("last"))


def merged_pairs(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", "kind", "value").agg(F.sum("n").alias("n"))


def baselines_of(numbers: DataFrame, pairs: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """The baseline rows that ``user_baselines`` computes from the whole log."""
    def mean(m):
        return F.when(F.col(f"n_{m}") > 0, F.col(f"mean_{m}"))

    def spread(m):
        return F.when(F.col(f"n_{m}") > 1, F.sqrt(F.col(f"m2_{m}") / (F.col(f"n_{m}") - 1))).otherwise(1.0)

    wide = numbers.select(
        "user_id", mean("hour").alias("mean_hour"), spread("hour").alias("std_hour"), mean("session_s").alias("mean_session_s"),
        spread("session_s").alias("std_session_s"), mean("bytes").alias("mean_bytes"), spread("bytes").alias("std_bytes"),
        (F.col("failures") / F.col("event_count")).alias("failure_rate"), "event_count", F.col("last.role").alias("role"))
    return joined_baselines(wide, pairs, max_set)


def _write_days(rows: DataFrame, path: str) -> None:
    """Days present in the rows replace their partitions; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


class DailyBaselines:
    """Partials by day and the state up to a day, under one folder.

    ``upto`` in a small document names the state that counts; it is written
    last, so a job that fails half way leaves the state before in force.
    States before the last stay on disk until they are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def upto(self) -> date | None:
        row = read_document(self.spark, f"{self.root}/upto", "upto date", {"upto": None}).first()
        return row["upto"]

    def add_days(self, log: DataFrame) -> None:
        """Partials of all days of the given rows; each day must be whole."""
        _write_days(day_numbers(log), f"{self.root}/days/numbers")
        pairs = value_pairs(normal_rows(log).withColumn("day", F.to_date("timestamp")), "day")
        _write_days(pairs, f"{self.root}/days/pairs")

    def _days(self, name: str, first: date | None, last: date) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/days/{name}").filter(F.col("day") <= F.lit(last))
        return (rows.filter(F.col("day") >= F.lit(first)) if first else rows).drop("day")

    def _state(self, name: str, upto: date) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/state/{name}/upto={upto}")

    def fold(self, last: date, onto: date | None = None) -> None:
        """The state up to a day: from an earlier state and the days after it, or from all days."""
        for name, merge in (("numbers", merged_numbers), ("pairs", merged_pairs)):
            parts = self._days(name, onto + timedelta(days=1) if onto else None, last)
            if onto:
                parts = self._state(name, onto).unionByName(parts)
            merge(parts).write.mode("overwrite").parquet(f"{self.root}/state/{name}/upto={last}")
        write_document(self.spark.range(1).select(F.lit(last).alias("upto")), f"{self.root}/upto")

    def refresh(self, log_of_day: DataFrame, day: date) -> None:
        """Take in one whole day.  A day that is not new changes its partials and folds all of them."""
        before = self.upto()
        self.add_days(log_of_day)
        if before is not None and day > before:
            self.fold(day, before)
        else:
            self.fold(max(day, before or day))

    def load(self, max_set: int = MAX_SET) -> DataFrame:
        upto = self.upto()
        if upto is None:
            raise ValueError("no day was taken in yet")
        return baselines_of(self._state("numbers", upto), self._state("pairs", upto), max_set)


# --- drift ------------------------------------------------------------------------

def hour_histograms(log: DataFrame) -> DataFrame:
    """(day, user_id, hour, n): at most 24 rows per user and day."""
    return log.groupBy(F.to_date("timestamp").alias("day"), "user_id", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def whole_days(end: date, days: int) -> tuple[set[date], set[date]]:
    """Days that lie in the recent and in the baseline window with all their rows."""
    def back(first: int, last: int) -> set[date]:
        return {end - timedelta(days=i) for i in range(first, last + 1)}

    return back(0, days - 1), back(days + 1, 2 * days - 1)


def _in(days: set[date]):
    return F.col("day").isin([d.isoformat() for d in sorted(days)]) if days else F.lit(False)


def window_counts(histograms: DataFrame, end: date, days: int = WINDOW_DAYS) -> DataFrame:
    """(user_id, hour, r, b) over the whole days; users of all earlier days keep rows of zeros."""
    recent, baseline = whole_days(end, days)
    return histograms.filter(F.col("day") <= F.lit(end)).groupBy("user_id", "hour").agg(
        F.sum(F.when(_in(recent), F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(_in(baseline), F.col("n")).otherwise(0)).alias("b"))


def moved_counts(counts: DataFrame, histograms: DataFrame, old: date, new: date, days: int = WINDOW_DAYS) -> DataFrame:
    """The counts of a later end: days that enter a window are added, those that leave it subtracted."""
    (r0, b0), (r1, b1) = whole_days(old, days), whole_days(new, days)

    def change(before: set[date], after: set[date]):
        return F.when(_in(after - before), F.col("n")).when(_in(before - after), -F.col("n")).otherwise(0)

    fresh = (F.col("day") > F.lit(old)) & (F.col("day") <= F.lit(new))
    delta = histograms.filter(_in((r0 ^ r1) | (b0 ^ b1)) | fresh).select(
        "user_id", "hour", change(r0, r1).cast("long").alias("r"), change(b0, b1).cast("long").alias("b"))
    return counts.unionByName(delta).groupBy("user_id", "hour").agg(F.sum("r").alias("r"), F.sum("b").alias("b"))


def edge_counts(log: DataFrame, end_us: int, days: int = WINDOW_DAYS) -> DataFrame:
    """Counts of the two days that the windows' ends cut, from their rows."""
    us, span = F.unix_micros("timestamp"), days * DAY_US

    def rows_of(first: int):
        start = first // DAY_US * DAY_US
        return (F.col("timestamp") >= F.timestamp_micros(F.lit(start))) & (F.col("timestamp") < F.timestamp_micros(F.lit(start + DAY_US)))

    recent = us >= end_us - span
    rows = log.filter(rows_of(end_us - span) | (rows_of(end_us - 2 * span) & (us >= end_us - 2 * span)))
    return rows.groupBy("user_id", F.hour("timestamp").alias("hour")).agg(
        F.count_if(recent).alias("r"), F.count_if(~recent).alias("b"))


def drift_of_counts(counts: DataFrame, edges: DataFrame, method: str = "auto") -> DataFrame:
    """Login-hour drift of every user, as ``user_drift`` finds it from the log."""
    both = counts.unionByName(edges).groupBy("user_id", "hour").agg(F.sum("r").alias("r"), F.sum("b").alias("b"))
    tested = with_pvalue(ks_of_counts(both, "user_id", "hour"), method)
    return tested.fillna({"ks_stat": 0.0, "p_value": 1.0, "drifted": False})


class RollingDrift:
    """Hour histograms by day and the windows' counts up to a day, under one folder."""

    def __init__(self, spark: SparkSession, root: str, days: int = WINDOW_DAYS):
        self.spark, self.root, self.days = spark, root, days

    def upto(self) -> date | None:
        return read_document(self.spark, f"{self.root}/upto", "upto date", {"upto": None}).first()["upto"]

    def add_days(self, log: DataFrame) -> None:
        _write_days(hour_histograms(log), f"{self.root}/days")

    def advance(self, end: date) -> None:
        """Move the windows' whole days to a later end, or count them for the first time."""
        histograms, before = self.spark.read.parquet(f"{self.root}/days"), self.upto()
        if before is not None and end > before:
            counts = moved_counts(self._counts(before), histograms, before, end, self.days)
        else:
            counts = window_counts(histograms, end, self.days)
        counts.write.mode("overwrite").parquet(f"{self.root}/counts/upto={end}")
        write_document(self.spark.range(1).select(F.lit(end).alias("upto")), f"{self.root}/upto")

    def _counts(self, end: date) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/counts/upto={end}")

    def drift(self, log: DataFrame, method: str = "auto") -> DataFrame:
        """Of the log, the last day is read for its last event and two days for the windows' ends."""
        end = self.upto()
        if end is None:
            raise ValueError("no day was taken in yet")
        day = (F.col("timestamp") >= F.lit(end).cast("timestamp")) & (F.col("timestamp") < F.lit(end + timedelta(days=1)).cast("timestamp"))
        last = log.filter(day).agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if last is None:
            raise ValueError(f"the log has no rows of {end}")
        return drift_of_counts(self._counts(end), edge_counts(log, last, self.days), method)
