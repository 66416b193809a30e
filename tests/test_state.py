"""State that goes on from batch to batch, against loops over the whole log."""

import json
import random
from datetime import datetime, timedelta

import pytest

from daytrace.operators import event_store as E
from daytrace.operators import wellbeing as W
from daytrace.session import new_folder
from daytrace.streaming import activities as A
from daytrace.streaming import limits as L
from daytrace.streaming import merging as M

T0 = datetime(2026, 2, 9, 9)


def slow_limits(rows, tier):
    """One request after another, by the rules of the bucket and the windows."""
    tokens, counted, passed, out = {}, {}, {}, {}
    for i, user, endpoint, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        t = (ts - T0).total_seconds()
        have = min(tier.burst, tokens.get(user, tier.burst) + (t - counted.get(user, t)) * tier.refill)
        counted[user] = t
        mine = passed.setdefault(user, [])
        within = lambda w, e=None: sum(p > t - w and e in (None, x) for p, x in mine)  # noqa: B023, E731
        minute = within(60)
        if have < 1:
            reason = "burst_limit_exceeded"
        elif minute >= tier.minute:
            reason = "minute_limit_exceeded"
        elif endpoint in tier.endpoints and within(60, endpoint) >= tier.endpoints[endpoint]:
            reason = "endpoint_limit_exceeded"
        elif within(3600) >= tier.hour:
            reason = "hour_limit_exceeded"
        elif within(86400) >= tier.day:
            reason = "day_limit_exceeded"
        else:
            reason, have = None, have - 1
            mine.append((t, endpoint))
        tokens[user] = have
        out[i] = (reason is None, reason, tier.minute - minute - 1 if reason is None else 0)
    return out


@pytest.mark.parametrize("step,tier", [(1, L.Tier(6, 30, 60, 4, 0.25, {"chat": 2})), (700, L.Tier(6, 5, 9, 4, 0.25)), (9000, L.Tier(6, 5, 9, 4, 0.001))])
def test_limits_over_batches(spark, step, tier):
    draw, folder = random.Random(step), new_folder(spark, "requests")
    rows, t = [], T0
    for k in range(240):
        t += timedelta(seconds=draw.random() * step)
        rows.append((k, draw.randrange(3), draw.choice(["chat", "graph"]), t))
    schema = "id long, user_id long, endpoint string, ts timestamp"
    for k in range(4):
        spark.createDataFrame(rows[60 * k : 60 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = A.drain(L.limited(stream, tier), "append", "limits").collect()
    want = slow_limits(rows, tier)
    assert {r.id: (r.allowed, r.reason, r.remaining) for r in got} == want and len(got) == 240
    assert {x for _, x, _ in want.values()} > {None}


def log(n, seed):
    draw, rows = random.Random(seed), []
    for k in range(n):
        kind = draw.choice(["activity_recorded"] * 3 + ["activity_tagged", "activity_deleted", "other"])
        i = str(draw.randrange(6))
        data = {"activity_recorded": {"id": i, "duration": k + 0.5, "timestamp": f"t{k}"}, "activity_tagged": {"tag": draw.choice(["", "x", "y", "z"])}, "activity_deleted": {"activity_id": i}, "other": {}}[kind]
        rows.append((k, draw.choice("ab"), kind, json.dumps(data), T0 + timedelta(seconds=k), None))
    return rows


EVENTS = "event_id long, aggregate_id string, event_type string, data string, ts timestamp, expected_version long"


def replayed(rows):
    out = {}
    for _, agg, kind, data, *_ in rows:
        d = json.loads(data)
        s = out.setdefault(agg, [0, 0.0, None, [], []])
        s[0] += 1
        if kind == "activity_recorded":
            s[4].append(d["id"])
            s[1], s[2] = s[1] + d["duration"], d["timestamp"]
        elif kind == "activity_tagged" and d["tag"] and d["tag"] not in s[3]:
            s[3].append(d["tag"])
        elif kind == "activity_deleted":
            s[4] = [i for i in s[4] if i != d["activity_id"]]
    return {a: (v, t, last, tags, len(alive)) for a, (v, t, last, tags, alive) in out.items()}


def test_replay_from_snapshots(spark):
    """Batches appended one after another; the state from each snapshot on is the state of the whole log."""
    rows, store, snapshot, living = log(120, 5), None, None, None
    none = spark.createDataFrame([], "aggregate_id string, version long")
    for k in range(0, 120, 30):
        new = spark.createDataFrame(rows[k : k + 30], EVENTS)
        added, refused = E.appended(none if store is None else E.heads(store), new)
        assert refused.isEmpty()
        store = (added if store is None else store.unionByName(added)).checkpoint()
        state, _ = E.activity_state(store, snapshot, living)
        assert {r.aggregate_id: (r.version, r.total_duration, r.last_activity_time, r.tags, r.activity_count) for r in state.collect()} == replayed(rows[: k + 30])
        snapshot, living = (x.checkpoint() for x in E.activity_state(E.up_to_snapshot(store), snapshot, living))
        assert all(r.version % 10 == 0 for r in snapshot.collect())


def test_version_conflicts(spark):
    heads = spark.createDataFrame([("a", 3), ("b", 5)], "aggregate_id string, version long")
    rows = [(1, "a", "other", "{}", T0, 3), (2, "a", "other", "{}", T0, None), (3, "b", "other", "{}", T0, 4), (4, "b", "other", "{}", T0, 5), (5, "c", "other", "{}", T0, 0), (6, "d", "other", "{}", T0, None)]
    added, refused = E.appended(heads, spark.createDataFrame(rows, EVENTS))
    assert {(r.event_id, r.version) for r in added.collect()} == {(1, 4), (2, 5), (5, 1), (6, 1)}
    assert {(r.event_id, r.expected_version, r.version) for r in refused.collect()} == {(3, 4, 5), (4, 4, 5)}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_counts_with_a_floor(spark, block):
    rows = log(200, block)
    added, _ = E.appended(spark.createDataFrame([], "aggregate_id string, version long"), spark.createDataFrame([r[:2] + (("activity_deleted",) if i % 3 else (r[2],)) + r[3:] for i, r in enumerate(rows)], EVENTS))
    want = {}
    for r in added.orderBy("aggregate_id", "version").collect():
        step = {"activity_recorded": 1, "activity_deleted": -1}.get(r.event_type, 0)
        want[r.aggregate_id] = max(0, want.get(r.aggregate_id, 0) + step)
    assert {r.aggregate_id: r.n for r in E.activity_counts(added, block).collect()} == want


def test_settings_and_their_history(spark):
    put = lambda k, v: ("setting_changed", json.dumps({"key": k, "value": v}))
    steps = [put("a", "1"), put("b", "2"), put("a", "3"), ("settings_reset", json.dumps({"defaults": {"a": "0", "c": "9"}})), put("a", "4"), put("b", "5"), put("a", "6")]
    added, _ = E.appended(spark.createDataFrame([], "aggregate_id string, version long"), spark.createDataFrame([(i, "u", k, d, T0, None) for i, (k, d) in enumerate(steps)], EVENTS))
    assert [tuple(r)[1:] for r in E.setting_history(added).orderBy("version").collect()] == [(1, "a", None, "1"), (2, "b", None, "2"), (3, "a", "1", "3"), (4, None, None, None), (5, "a", "0", "4"), (6, "b", None, "5"), (7, "a", "4", "6")]
    assert {(r.key, r.value) for r in E.settings(added).collect()} == {("a", "6"), ("b", "5"), ("c", "9")}


def slow_edges(rows):
    by_activity, out = {}, {}
    for a, e, r in rows:
        by_activity.setdefault(a, {})[e] = max(by_activity.get(a, {}).get(e, 0), 1.0 if r is None else r)
    for a in sorted(by_activity):
        ids = sorted(by_activity[a])
        for i, x in enumerate(ids):
            for y in ids[i + 1 :]:
                mean = (by_activity[a][x] + by_activity[a][y]) / 2
                s = 0.9 if mean > 0.9 else 0.7 if mean > 0.8 else 0.5
                old = out.get((x, y))
                out[x, y] = [(old[0] + s) / 2 if old else s, old[1] + 1 if old else 1, old[2] if old else a, a]
    return {k: (round(v[0], 9), *v[1:]) for k, v in out.items()}


def test_merged_edges_with_a_batch_run_again(spark):
    draw = random.Random(8)
    rows = [(a, draw.randrange(6), draw.choice([None, 0.7, 0.85, 0.95, 1.0])) for a in range(40) for _ in range(3)]
    schema = "activity_id long, entity_id long, relevance_score double"
    folder, merge = new_folder(spark, "edges"), None
    merge = M.merge_into(folder)
    for number, (lo, hi) in enumerate([(0, 13), (13, 30), (30, 40)]):
        batch = spark.createDataFrame([r for r in rows if lo <= r[0] < hi], schema)
        for _ in range(2 if number == 1 else 1):
            merge(batch, number)
    got = {(r.a, r.b): (round(r.strength, 9), r.n, r.first_seen, r.last_seen) for r in M.edges_at(spark, folder, 2).collect()}
    assert got == slow_edges(rows)


def test_stream_of_links_goes_on_after_a_stop(spark):
    schema, source = "activity_id long, entity_id long, relevance_score double", new_folder(spark, "links")
    store, progress = new_folder(spark, "edges"), new_folder(spark, "progress")
    rows = [(a, e, 0.9 + 0.02 * (a % 4)) for a in range(12) for e in (a % 3, 3, 4)]
    for lo in (0, 6):
        spark.createDataFrame([r for r in rows if lo <= r[0] < lo + 6], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = M.streamed_edges(stream, store, progress)
        assert {(r.a, r.b): (round(r.strength, 9), r.n, r.first_seen, r.last_seen) for r in found.collect()} == slow_edges([r for r in rows if r[0] < lo + 6])


def test_send_decisions_against_a_loop(spark):
    draw = random.Random(2)
    kinds, channels = list(W.PRIORITY) + ["unheard"], ["in_app", "email"]
    rows = [(k, k % 3, draw.choice(kinds), draw.choice(channels), draw.choice([None, "critical", "low"]), T0 + timedelta(minutes=7 * k)) for k in range(300)]
    users = [(0, ["email"], [], True, 22, 8, True, 2, 9, False), (1, [], ["system"], True, 9, 12, False, 1, 5, True), (2, [], [], False, 22, 8, True, 3, 4, False)]
    got = {r.id: (r.send, r.reason) for r in W.send_decisions(
        spark.createDataFrame(rows, "id long, user_id long, kind string, channel string, priority string, at timestamp"),
        spark.createDataFrame(users, "user_id long, channels_off array<string>, kinds_off array<string>, dnd boolean, start_hour int, end_hour int, override_critical boolean, max_per_hour int, max_per_day int, digest boolean"),
    ).collect()}
    sent, want = {}, {}
    for i, u, kind, channel, priority, at in rows:
        _, off, kinds_off, dnd, start, end, override, per_hour, per_day, digest = users[u]
        rank = priority or W.PRIORITY.get(kind, "medium")
        quiet = dnd and ((at.hour >= start or at.hour < end) if start > end else start <= at.hour < end)
        hour, day = (u, at.date(), at.hour), (u, at.date())
        if channel in off:
            reason = f"channel_{channel}_disabled"
        elif kind in kinds_off:
            reason = f"type_{kind}_disabled"
        elif quiet and not (rank == "critical" and override):
            reason = "dnd_active"
        elif digest and rank in ("low", "medium"):
            reason = "digest_mode_active"
        elif sent.get(hour, 0) >= per_hour:
            reason = "hourly_cap_reached"
        elif sent.get(day, 0) >= per_day:
            reason = "daily_cap_reached"
        else:
            reason = "approved"
            sent[hour], sent[day] = sent.get(hour, 0) + 1, sent.get(day, 0) + 1
        want[i] = (reason == "approved", reason)
    assert got == want and {r for _, r in want.values()} >= {"approved", "dnd_active", "hourly_cap_reached", "daily_cap_reached"}
