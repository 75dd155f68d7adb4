"""Leases, resolvers, cleared logs, cursors, sketches, trees with cycles and colliding routes."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, resolver, sketches, states
from tessera.sources import cursors
from tessera.sources import logs as log_days
from tessera.sources import registry as sources
from tessera.streaming import leases


def lease_rows(seed, jobs=6, n=240):
    r = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    at, rows = 0, []
    for i in range(n):
        at += r.choice([0, 500, 2000, 8000, 20_000])
        event = r.choice(["claim", "claim", "heartbeat", "heartbeat", "heartbeat", "checkpoint", "cancel", "finish"] if r.random() < 0.5 else ["claim", "heartbeat", "checkpoint"])
        rows.append((r.randrange(jobs), i, base + dt.timedelta(milliseconds=at), event, r.choice(["a", "a", "a", "b"])))
    return rows


def plain_leases(rows, lease_ms, watermark):
    """The rules of leases as one loop over all jobs, without the stream's classes."""
    out = []
    jobs = {}
    last = {}
    for job, seq, ts, event, owner in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        at = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        j = jobs.setdefault(job, dict(state="queued", epoch=0, owner=None, until=None, beat=None, saved=False, n=0))

        def end(j, job=job):
            j["state"] = {"cancelling": "cancelled"}.get(j["state"], "queued" if j["saved"] else "interrupted")
            j["owner"], j["n"] = None, j["n"] + 1
            out.append((job, j["until"], "expire", "ok", j["state"], j["epoch"], j["n"]))

        last[job] = end
        live = j["state"] in ("running", "cancelling")
        if live and at >= j["until"]:
            end(j)
            live = False
        verdict = "ok"
        if event == "claim":
            if j["state"] in ("queued", "interrupted"):
                j.update(state="running", owner=owner, epoch=j["epoch"] + 1, beat=at, until=at + lease_ms)
            else:
                verdict = "invalid-transition"
        elif event == "cancel":
            if live or j["state"] in ("queued", "interrupted"):
                j["state"] = "cancelling" if live else "cancelled"
            else:
                verdict = "invalid-transition"
        elif not live:
            verdict = "invalid-transition"
        elif owner != j["owner"]:
            verdict = "lease-mismatch"
        elif event == "heartbeat":
            if at + lease_ms <= j["until"]:
                verdict = "invalid-lease"
            else:
                j.update(beat=at, until=at + lease_ms)
        elif event == "checkpoint":
            j["saved"] = True
        else:
            j["state"] = "cancelled" if j["state"] == "cancelling" else "succeeded"
        out.append((job, at, event, verdict, j["state"], j["epoch"], j["n"]))
    for job, j in jobs.items():
        if j["state"] in ("running", "cancelling") and j["until"] <= watermark:
            last[job](j)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_leases_of_a_stream_that_is_stopped_and_goes_on(spark, tmp_path, parts):
    rows = lease_rows(parts)
    schema = "job_id long, seq long, ts timestamp, event string, owner string"
    source = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for k in range(parts):  # each run ends the stream; the next one finds its state and offsets again
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = leases.lease_events(spark.readStream.schema(schema).parquet(source), lease_ms=30_000, late="1 second")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("job_id", "at_ms", "event", "verdict", "state", "epoch", "recoveries").collect()))
    newest = max(int((r[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1000) for r in rows)
    want = plain_leases(rows, 30_000, newest - 1000)
    assert got == want
    assert {"expire", "claim"} <= {r[2] for r in got} and {"queued", "interrupted"} <= {r[4] for r in got if r[2] == "expire"}


def plain_requests(rows, deadline):
    dedup, opened, out = {}, set(), {}
    for seq, at, service, site, key, answer in rows:
        if at > deadline:
            out[seq] = ("deadline", "deadline")
        elif (service, site) in opened:
            out[seq] = ("open", "rate-limited")
        elif (service, site, key) in dedup:
            out[seq] = ("cached", dedup[service, site, key])
        else:
            dedup[service, site, key] = answer
            if answer == "rate-limited":
                opened.add((service, site))
            out[seq] = ("called", answer)
    return out


def test_requests_against_a_loop(spark):
    r = random.Random(9)
    rows = [(i, i + r.randrange(3), r.choice("ab"), r.randrange(3), r.randrange(12), r.choice(["blocks"] * 12 + ["skip", "not-found", "rate-limited"])) for i in range(300)]
    met = resolver.answered(spark.createDataFrame(rows, "seq long, at long, service string, site int, key int, answer string"), deadline=270)
    assert {x["seq"]: (x["status"], x["given"]) for x in met.collect()} == plain_requests(rows, 270)


def test_stages_of_blocks(spark):
    rows = [
        (1, 0, "skip", False), (1, 1, "network", False), (1, 2, "blocks", False), (1, 3, "blocks", False), (2, 0, "skip", False), (3, 0, "deadline", False), (3, 1, "blocks", False),
        (4, 0, "blocks", True), (5, 0, "blocks", True), (5, 1, "blocks", False), (6, 0, "blocks", False), (6, 1, "deadline", False),
    ]
    df = spark.createDataFrame(rows, "block int, stage int, given string, needs_live boolean")
    got = {r["block"]: (r["outcome"], r["stage"], r["code"], r["failures"]) for r in resolver.resolved(df, live=False).collect()}
    assert got == {
        1: ("rendered", 2, resolver.RENDERED, 1), 2: ("kept", None, resolver.DEGRADED, 0), 3: ("kept", None, resolver.SKIPPED, 0), 4: ("kept", None, resolver.SKIPPED, 0),
        5: ("rendered", 1, resolver.RENDERED, 0), 6: ("rendered", 0, resolver.RENDERED, 0),
    }
    assert {r["block"]: r["stage"] for r in resolver.resolved(df).collect()}[4] == 0


def hashes(folder):
    return {os.path.relpath(os.path.join(d, f), folder): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(folder) for f in fs if not f.startswith((".", "_"))}


def test_cleared_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [(i, dt.datetime(2024, 1, 1 + i % 9), "info") for i in range(90)]
    sources.append_logs(spark.createDataFrame(rows, "event_id long, timestamp timestamp, level string"), path)
    os.makedirs(f"{path}/day=other")
    before = hashes(path)
    with pytest.raises(ValueError):
        log_days.clear_days(spark, path, "2024-01-05")
    with pytest.raises(ValueError):
        log_days.clear_days(spark, path, "soon", confirm=True)
    assert hashes(path) == before and log_days.clearing_plan(spark, path, "2024-01-05").count() == 4
    report = log_days.clear_days(spark, path, "2024-01-05", confirm=True).collect()
    assert [(r["day"].day, r["state"]) for r in report] == [(k, "deleted") for k in (1, 2, 3, 4)]
    assert hashes(path) == {k: h for k, h in before.items() if int(k[12:14]) >= 5} and os.path.isdir(f"{path}/day=other")
    assert log_days.clear_days(spark, path, "2024-01-05", confirm=True).isEmpty() and log_days.clear_days(spark, f"{path}/none", confirm=True).isEmpty()


def test_cursors(spark):
    def run(edges, start):
        return sorted((r["place"], r["token"], r["state"]) for r in cursors.drained(spark.createDataFrame(edges, "token string, next_token string"), start).collect())

    assert run([(str(i), str(i + 1)) for i in range(40)] + [("40", None)], "3") == [(i, str(i + 3), "more") for i in range(37)] + [(37, "40", "last")]
    assert run([("a", "b"), ("b", "c"), ("c", "b"), ("x", "a")], "a") == [(0, "a", "more"), (1, "b", "more"), (2, "c", "loop")]
    assert run([("a", "a")], "a") == [(0, "a", "loop")] and run([("a", "zz"), ("a", None)], "a") == [(0, "a", "missing")] and run([("a", None)], "q") == []
    assert cursors.repeats(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", None)], "token string, next_token string")).collect()[0][1] == 2


def test_sketches_merge_as_of_all_rows(spark):
    rows = spark.range(0, 40_000).select(F.expr("timestamp_seconds(1704067200 + id * 60)").alias("ts"), (F.col("id") * 7919 % 9001).alias("item"), (F.col("id") * 31 % 1000).alias("value"))
    ranges = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 20)), (dt.date(2024, 1, 5), dt.date(2024, 1, 5))], "first_day date, last_day date")
    for q in (0.1, 0.5, 0.95):
        for r in sketches.over_ranges(sketches.daily(rows, "ts", "item", "value"), ranges, q).collect():
            own = rows.filter(F.to_date("ts").between(r["first_day"], r["last_day"]))
            users, n, below = own.agg(F.count_distinct("item"), F.count(F.lit(1)), F.count_if(F.col("value") <= r["quantile_about"])).first()
            assert r["n"] == n and abs(r["distinct_about"] - users) <= sketches.DISTINCT_ERROR * users and abs(below / n - q) <= sketches.RANK_ERROR + 0.001


def forest(spark, rows):
    return {r["id"]: (r["root"], r["depth"], r["path"]) for r in graph.expand_levels(spark.createDataFrame(rows, "id long, parent_id long")).collect()}


def test_chains_and_cycles_keep_every_page(spark):
    chain = forest(spark, [(i, i - 1 if i else None) for i in range(300)])
    assert chain[299] == (0, 299, list(range(300))) and len(chain) == 300
    got = forest(spark, [(1, None), (2, 1), (10, 11), (11, 10), (12, 11), (20, 22), (21, 20), (22, 21), (23, 22), (30, 30), (31, 30), (40, 99)])
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 22: 20, 23: 20, 30: 30, 31: 30, 40: 40}
    assert got[12][2] == [10, 11, 12] and got[23][2] == [20, 21, 22, 23] and got[31][1] == 1
    assert forest(spark, []) == {}


def test_random_forests_against_a_walk(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, r.randrange(120), r.randrange(120), 500])) for i in range(120)]
    parent = dict(rows)
    got = forest(spark, rows)
    for i in parent:
        walk, at = [i], i
        while parent.get(at) in parent and parent[at] not in walk:
            at = parent[at]
            walk.append(at)
        if parent.get(at) in parent:  # came to a cycle: it begins at its least node
            cycle = walk[walk.index(parent[at]) :]
            head = min(cycle)
            walk = walk[: walk.index(head) + 1] if i not in cycle or head in walk else walk
        assert got[i] == (walk[-1], len(walk) - 1, walk[::-1])


def test_no_route_has_two_owners(spark):
    previous = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "source_id long, route string")
    wanted = spark.createDataFrame([(i, f"/n{i}") for i in (1, 2, 3, 4, 5)], "source_id long, base string")
    overrides = spark.createDataFrame([(2, "/A"), (3, "/free"), (4, "/both"), (5, "/BOTH")], "source_id long, route string")
    got = sorted((r["source_id"], r["route"], r["change"]) for r in states.stable_routes(previous, wanted, overrides).collect())
    assert got == [
        (1, "/a", "kept"), (2, "/A", "collision"), (2, "/b", "kept"), (3, "/free", "changed"), (4, "/both", "collision"), (4, "/n4", "assigned"), (5, "/BOTH", "collision"), (5, "/n5", "assigned"),
    ]
