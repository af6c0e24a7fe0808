"""Column expressions shared by the batch jobs and the streams."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0

# Address prefixes treated as internal.
PRIVATE_PREFIXES = ("10.", "192.168.", "172.")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip(col: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(col), F.lit(low)), F.lit(high))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = F.sin((p2 - p1) / 2.0)
    half_lon = F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2.0)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.asin(F.sqrt(clip(a, 0.0, 1.0))) * (2.0 * EARTH_RADIUS_KM)


def circular_hours(hour, center) -> Column:
    """Distance on the 24-hour clock."""
    gap = F.abs(_c(hour) - _c(center)) % 24.0
    return F.least(gap, F.lit(24.0) - gap)


def hour_deviation(hour, mean_hour, std_hour) -> Column:
    return circular_hours(hour, mean_hour) / F.greatest(_c(std_hour), F.lit(0.5))


def clipped_z(value, mean, std, limit: float = 5.0) -> Column:
    z = (_c(value) - _c(mean)) / F.greatest(_c(std), F.lit(1.0))
    return clip(z, -limit, limit)


def ordinal(col, codes: dict[str, int]) -> Column:
    """Code of a category, 0 for anything unlisted."""
    out = F.lit(0)
    for name, code in codes.items():
        out = F.when(_c(col) == name, F.lit(code)).otherwise(out)
    return out


def is_public_ip(ip) -> Column:
    private = F.lit(False)
    for prefix in PRIVATE_PREFIXES:
        private = private | _c(ip).startswith(prefix)
    return (~private).cast("int")


def micros(ts) -> Column:
    return F.unix_micros(_c(ts))


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def fixed_decimals(col, places: int) -> Column:
    """Half-even text without thousands separators."""
    return F.replace(F.format_number(_c(col), places), F.lit(","), F.lit(""))


def risk_band(risk) -> Column:
    r = _c(risk)
    return (F.when(r >= 90, "CRITICAL").when(r >= 70, "HIGH")
            .when(r >= 40, "ELEVATED").otherwise("MINIMAL"))


def quality_rating(metric) -> Column:
    m = _c(metric)
    return (F.when(m >= 0.9, "Excellent").when(m >= 0.8, "Good")
            .when(m >= 0.7, "Fair").otherwise("Poor"))


def percent_text(col) -> Column:
    return F.concat(fixed_decimals(_c(col) * 100.0, 1), F.lit("%"))


def kilobytes(col) -> Column:
    return F.round(_c(col) / F.lit(1024.0), 1)


def first_sentence(text) -> Column:
    return F.trim(F.substring_index(_c(text), ".", 1))


def class_title(name) -> Column:
    return F.upper(F.replace(_c(name), F.lit("_"), F.lit(" ")))


# Token patterns highlighted in a reason text.
TOKEN_PATTERNS = {
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "quoted": r"'[a-zA-Z0-9_-]+'",
    "quantity": r"\b\d+(?:\.\d+)?\s*(?:SDs?|km/h|failed login|distinct resources|minutes|window)\b",
}


def reason_tokens(text) -> Column:
    """All highlighted tokens of a reason, left to right."""
    return F.regexp_extract_all(_c(text), F.lit("|".join(TOKEN_PATTERNS.values())), F.lit(0))


def token_kind(token) -> Column:
    t = _c(token)
    return (F.when(t.startswith("'"), "quoted")
            .when(t.rlike("^" + TOKEN_PATTERNS["ip"] + "$"), "ip").otherwise("quantity"))


def kolmogorov_sf(stat, n, m) -> Column:
    """Large-sample two-sided p-value of the two-sample KS statistic.

    Uses the alternating exponential series with the first-order finite-sample
    correction of its argument (Vrbik 2018).
    """
    size = F.round((_c(n) * _c(m)) / (_c(n) + _c(m)))
    root = F.sqrt(size)
    raw = root * _c(stat)
    lam = raw + F.lit(1.0) / (root * 6.0) + (raw - 1.0) / (size * 4.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(clip(series * 2.0, 0.0, 1.0))


def path_constant(size) -> Column:
    """Mean unsuccessful search length c(n) of a binary tree on n points."""
    n = _c(size).cast("double")
    long_form = (F.ln(n - 1.0) + 0.5772156649) * 2.0 - (n - 1.0) * 2.0 / n
    return F.when(n > 2, long_form).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))


def path_constant_value(n: int) -> float:
    if n > 2:
        return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n
    return 1.0 if n == 2 else 0.0
