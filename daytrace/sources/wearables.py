"""Answers of wearable services, as landed JSON, to rows of metrics by a table of paths."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """One metric of an answer: where its value is (several paths are added), its unit, what it's multiplied with, and whether a
    row is made if the value is missing (0), only if it's there, or only if it's there and not 0."""

    metric: str
    paths: tuple[str, ...]
    unit: str
    scale: float = 1.0
    when: str = "always"


# What each answer holds. Items: the list whose elements are read one by one, with their day; else the answer.
ANSWERS: dict[tuple[str, str], tuple[str | None, list[Rule]]] = {
    ("fitbit", "activities"): (None, [
        Rule("steps", ("$.summary.steps",), "steps"), Rule("calories", ("$.summary.caloriesOut",), "kcal"),
        Rule("active_minutes", ("$.summary.fairlyActiveMinutes", "$.summary.veryActiveMinutes"), "minutes"),
    ]),
    ("fitbit", "heart"): (None, [Rule("heart_rate_resting", ('$["activities-heart"][0].value.restingHeartRate',), "bpm", when="not zero")]),
    ("fitbit", "sleep"): (None, [
        Rule("sleep_duration", ("$.sleep[0].minutesAsleep",), "minutes", when="$.sleep[0]"), Rule("sleep_efficiency", ("$.sleep[0].efficiency",), "percent", when="$.sleep[0]"),
        Rule("sleep_deep", ("$.sleep[0].levels.summary.deep.minutes",), "minutes", when="$.sleep[0].levels.summary.deep"), Rule("sleep_rem", ("$.sleep[0].levels.summary.rem.minutes",), "minutes", when="$.sleep[0].levels.summary.rem"),
        Rule("sleep_light", ("$.sleep[0].levels.summary.light.minutes",), "minutes", when="$.sleep[0].levels.summary.light"),
    ]),
    ("fitbit", "spo2"): (None, [Rule("spo2", ("$.value.avg",), "percent", when="not zero")]),
    ("oura", "daily_readiness"): ("$.data", [Rule("readiness_score", ("$.score",), "score")]),
    ("oura", "daily_sleep"): ("$.data", [Rule("sleep_efficiency", ("$.contributors.efficiency",), "percent")]),
    ("oura", "sleep"): ("$.data", [
        Rule("sleep_duration", ("$.total_sleep_duration",), "minutes", 1 / 60), Rule("sleep_deep", ("$.deep_sleep_duration",), "minutes", 1 / 60), Rule("sleep_rem", ("$.rem_sleep_duration",), "minutes", 1 / 60),
        Rule("heart_rate_resting", ("$.average_heart_rate",), "bpm", when="not zero"), Rule("hrv", ("$.average_hrv",), "ms", when="not zero"),
    ]),
    ("oura", "daily_spo2"): ("$.data", [Rule("spo2", ("$.spo2_percentage.average",), "percent", when="not zero")]),
}
DAY = "$.day"


def _point(rule: Rule) -> Column:
    """The metric's row, null where there is none; ``bad`` if a value is there that is no number."""

    def there(path: str) -> Column:
        value = F.try_variant_get("item", path, "variant")
        return value.isNotNull() & ~F.is_variant_null(value)

    found = [F.try_variant_get("item", p, "double") for p in rule.paths]
    bad = F.lit(False)
    for path, value in zip(rule.paths, found):
        bad = bad | (there(path) & value.isNull())
    total = sum((F.coalesce(v, F.lit(0.0)) for v in found), F.lit(0.0)) * rule.scale
    if rule.when == "always":
        made = F.lit(True)
    elif rule.when == "not zero":
        made = total != 0
    else:
        made = there(rule.when)
    return F.when(made | bad, F.struct(F.lit(rule.metric).alias("metric_type"), F.when(~bad, total).alias("metric_value"), F.lit(rule.unit).alias("metric_unit"), bad.alias("bad")))


def metric_rows(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: ``id, user_id, provider, metric_type, metric_value, metric_unit, recorded_at`` of the answers ``id, user_id, provider,
    endpoint, day, body``, and what was set aside: ``id, reason``.

    The body is read as a variant, and each provider's and endpoint's rules take their values by paths. An item's own day goes
    before the answer's. Set aside are bodies that are no JSON, unknown endpoints, and values that are no numbers; the
    other metrics of such an answer are kept. Everything is by row: nothing is shuffled.
    """
    x = answers.withColumn("parsed", F.try_parse_json("body")).withColumn("what", F.concat_ws("/", "provider", "endpoint"))
    listed = {"/".join(k): v for k, v in ANSWERS.items()}
    reason = F.when(F.col("parsed").isNull(), "not JSON").when(~F.col("what").isin(*listed), "unknown endpoint")
    x = x.withColumn("reason", reason)
    items = F.array("parsed")
    for what, (path, _) in listed.items():
        if path:
            items = F.when(F.col("what") == what, F.coalesce(F.try_variant_get("parsed", path, "array<variant>"), F.array().cast("array<variant>"))).otherwise(items)
    x = x.withColumn("item", F.explode(F.when(F.col("reason").isNull(), items).otherwise(F.array("parsed"))))
    points = F.array().cast("array<struct<metric_type:string,metric_value:double,metric_unit:string,bad:boolean>>")
    for what, (_, rules) in listed.items():
        points = F.when(F.col("what") == what, F.array(*[_point(r) for r in rules])).otherwise(points)
    per_item = F.lit(None).cast("string")
    for what, (path, _) in listed.items():
        if path:
            per_item = F.when(F.col("what") == what, F.try_variant_get("item", DAY, "string")).otherwise(per_item)
    found = x.filter("reason is null").select("id", "user_id", "provider", F.coalesce(per_item, F.col("day")).alias("recorded_at"), F.explode(F.filter(points, lambda p: p.isNotNull())).alias("p"))
    good = found.filter("not p.bad").select("id", "user_id", "provider", "p.metric_type", "p.metric_value", "p.metric_unit", "recorded_at")
    aside = x.filter("reason is not null").select("id", "reason").union(found.filter("p.bad").select("id", F.concat(F.lit("no number: "), "p.metric_type")))
    return good, aside
