"""Row-wise column functions over activities and texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import APP_CATEGORIES, CATEGORY_WEIGHTS, DOMAIN_CATEGORIES, contains_any

MAX_SECONDS = 7200


def capped(duration: Column, most: int = MAX_SECONDS) -> Column:
    """B2: seconds of an activity; missing is 0, more than ``most`` is cut."""
    return F.least(F.coalesce(duration, F.lit(0)), F.lit(most))


def activity_key(app: Column, domain: Column, kind: Column) -> Column:
    """The application, else the domain, else the type; empty strings count as missing."""
    return F.coalesce(F.nullif(app, F.lit("")), F.nullif(domain, F.lit("")), kind)


def categorize_app(name: Column) -> Column:
    """The first category with a term that the name contains, else "unknown"; a null name is "unknown"."""
    low, out = F.lower(F.trim(name)), None
    for category, words in APP_CATEGORIES.items():
        hit = low.rlike(contains_any(words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("unknown")


def categorize_domain(name: Column) -> Column:
    """D1 for web domains: productive, distractive or, by default, neutral."""
    low, out = F.lower(F.trim(name)), None
    for category, words in DOMAIN_CATEGORIES.items():
        hit = low.rlike(contains_any(words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("neutral")


def category_weight(category: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in CATEGORY_WEIGHTS.items():
        out = F.when(category == name, weight).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """H1: ``Xs``, ``Xm`` or ``Xh Ym``."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    minutes = F.floor(s / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))


def duration_bucket(seconds: Column) -> Column:
    """H2: very_short, short, medium, long, very_long at 5, 30, 120 and 600 seconds."""
    s = F.coalesce(seconds, F.lit(0))
    return F.when(s < 5, "very_short").when(s < 30, "short").when(s < 120, "medium").when(s < 600, "long").otherwise("very_long")


def dedup_hash(user: Column, kind: Column, at: Column, domain: Column, seconds: Column) -> Column:
    """H3: 16 hex digits over user, type, time to 10 seconds, domain and duration bucket."""
    tick = F.floor(F.unix_timestamp(at) / 10) * 10
    return F.substring(F.sha2(F.concat_ws(":", user.cast("string"), kind, tick.cast("string"), F.coalesce(domain, F.lit("")), duration_bucket(seconds)), 256), 1, 16)


def temporal_context(at: Column, seconds: Column, offset_hours: int = 0) -> dict[str, Column]:
    """H4: local hour, time of day, working and core hours, weekend, weekday and duration category."""
    local = at + F.expr(f"INTERVAL '{offset_hours}' HOUR")
    hour, weekday, s = F.hour(local), F.weekday(local), F.coalesce(seconds, F.lit(0))
    return {
        "local_hour": hour.cast("long"),
        "time_of_day": F.when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 17), "afternoon").when((hour >= 17) & (hour < 21), "evening").otherwise("night"),
        "is_work_hours": (hour >= 9) & (hour <= 17) & (weekday < 5),
        "is_core_hours": (hour >= 10) & (hour <= 16) & (weekday < 5),
        "is_weekend": weekday >= 5,
        "weekday": weekday.cast("long"),
        "duration_category": F.when(s < 30, "glance").when(s < 120, "brief").when(s < 300, "short").when(s < 900, "medium").when(s < 1800, "focused").when(s < 3600, "extended").otherwise("deep"),
    }


def matches_filters(filters: Mapping[str, object]) -> Column:
    """A predicate from a mapping of column to value, list of values, or ``{"gte"|"lte"|"gt"|"lt": bound}``.

    Nulls fail every condition. An empty mapping holds for every row.
    """
    out = F.lit(True)
    for name, want in filters.items():
        col = F.col(name)
        if isinstance(want, Mapping):
            for op, bound in want.items():
                test = {"gte": col >= bound, "lte": col <= bound, "gt": col > bound, "lt": col < bound}[op]
                out = out & F.coalesce(test, F.lit(False))
        elif isinstance(want, (list, tuple, set)):
            out = out & F.coalesce(col.isin(list(want)), F.lit(False))
        else:
            out = out & F.coalesce(col == want, F.lit(False))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def trend(value: Column, band: float) -> Column:
    return F.when(value > band, "increasing").when(value < -band, "decreasing").otherwise("stable")
