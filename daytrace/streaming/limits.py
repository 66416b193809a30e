"""Request limits as keyed state over event time: a token bucket, and windows over what was let through."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000  # microseconds


@dataclass(frozen=True)
class Tier:
    """Limits of a kind of account: requests a minute, hour and day, size of the bucket and tokens a second, and requests a
    minute to single endpoints."""

    minute: int
    hour: int
    day: int
    burst: int
    refill: float
    endpoints: dict[str, int] = field(default_factory=dict)


# Limits by kind of account.
TIERS = {
    "free": Tier(30, 500, 5_000, 10, 0.5, {"/api/ai/chat": 5, "/api/ai/chat/stream": 5, "/api/v1/graph": 20}),
    "personal": Tier(60, 2_000, 20_000, 20, 1.0, {"/api/ai/chat": 15, "/api/ai/chat/stream": 15, "/api/v1/graph": 40}),
    "pro": Tier(120, 5_000, 50_000, 40, 2.0, {"/api/ai/chat": 30, "/api/ai/chat/stream": 30}),
    "enterprise": Tier(300, 20_000, 200_000, 100, 5.0),
}
DECISION = "id long, user_id long, endpoint string, allowed boolean, reason string, remaining long"


class RateLimiter(StatefulProcessor):
    """What happens to each request of a user, in order of time.

    State is the bucket (tokens and when they were counted) and the requests let through in the last day, which the day's
    limit bounds. A timer a day after the last request clears it.
    """

    def __init__(self, tier: Tier) -> None:
        self.tier = tier

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, counted long")
        self.passed = handle.getListState("passed", "t long, endpoint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        tier, last = self.tier, None
        tokens, counted = self.bucket.get() if self.bucket.exists() else (float(tier.burst), None)
        passed = list(self.passed.get()) if self.passed.exists() else []
        times = [t for t, _ in passed]
        out = []
        for row in pd.concat(list(rows)).sort_values(["t", "id"]).itertuples():
            now = last = int(row.t)
            if counted is not None:
                tokens = min(float(tier.burst), tokens + max(0, now - counted) / 1e6 * tier.refill)
            counted = max(now, counted or now)
            within = lambda width: len(times) - bisect_right(times, now - width)  # noqa: B023, E731
            minute, limit = within(MINUTE), tier.endpoints.get(row.endpoint)
            mine = sum(e == row.endpoint for _, e in passed[len(passed) - minute :]) if limit is not None and minute else 0
            if tokens < 1:
                reason = "burst_limit_exceeded"
            elif minute >= tier.minute:
                reason = "minute_limit_exceeded"
            elif limit is not None and mine >= limit:
                reason = "endpoint_limit_exceeded"
            elif within(HOUR) >= tier.hour:
                reason = "hour_limit_exceeded"
            elif within(DAY) >= tier.day:
                reason = "day_limit_exceeded"
            else:
                reason = None
                tokens -= 1
                times.append(now)
                passed.append((now, row.endpoint))
            out.append((row.id, key[0], row.endpoint, reason is None, reason, tier.minute - minute - 1 if reason is None else 0))
        self.bucket.update((tokens, counted))
        kept = [p for p in passed if p[0] > last - DAY]
        if kept:
            self.passed.put(kept)
        else:
            self.passed.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((counted + DAY) // 1000 + 1)
        yield pd.DataFrame(out, columns=["id", "user_id", "endpoint", "allowed", "reason", "remaining"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        self.passed.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, tier: str | Tier = "free", delay: str = "1 hour") -> DataFrame:
    """Each request of the stream ``id, user_id, endpoint, ts`` with the decision on it.

    Checks go in the order bucket, minute, endpoint, hour, day, and only what is let through counts. Needs the RocksDB state
    store; a batch's requests of one user are put in order in memory, and earlier ones are in the state in short.
    """
    tier = TIERS[tier] if isinstance(tier, str) else tier
    rows = requests.withWatermark("ts", delay).selectExpr("id", "user_id", "endpoint", "ts", "unix_micros(ts) AS t")
    return rows.groupBy("user_id").transformWithStateInPandas(RateLimiter(tier), outputStructType=DECISION, outputMode="append", timeMode="EventTime")
