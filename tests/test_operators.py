"""Hand-built cases of operators: orphans, activity, staleness, bursts, queues, retention, eviction, snapshots."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import agile, audit, charts, graph, jobs, reports, search, states, store


def test_orphans(spark):
    pages = spark.createDataFrame([(1, None, False), (2, None, False), (3, 1, False), (4, None, True), (5, None, False), (6, None, False)], "page_id long, parent_id long, inaccessible boolean")
    links = spark.createDataFrame([(3, 2, "internal"), (5, 5, "internal"), (1, None, "internal"), (1, 6, "external")], "source_page_id long, target_page_id long, link_type string")
    assert {r[0] for r in store.orphans(pages, links).select("page_id").collect()} == {1, 6}


def test_tri_state_activity(spark):
    pages = spark.createDataFrame([(i,) for i in range(1, 6)], "page_id long")
    users = spark.createDataFrame([("a", False), ("b", False), ("c", None), ("d", True)], "user_id string, is_active boolean")
    contributors = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (4, "a"), (4, "d")], "page_id long, user_id string")
    got = {r["page_id"]: r["risk"] for r in audit.contributor_risks(pages, contributors, users).collect()}
    assert got == {1: "no-maintainer", 3: "bus-factor"}


def test_stale_levels(spark):
    rows = [(1, dt.datetime(2000, 3, 31)), (2, dt.datetime(2001, 1, 1)), (3, dt.datetime(2001, 3, 2)), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, last_modified timestamp")
    got = {r["page_id"]: r["severity"] for r in audit.stale_pages(pages, "2001-03-31", high=12, medium=6, low=1).collect()}
    assert got == {1: "high", 2: "low"}


def test_sync_states(spark):
    rows = [("a", "a", "a"), ("b", "a", "a"), ("a", "b", "a"), ("b", "b", "a"), ("b", "c", "a")]
    df = spark.createDataFrame(rows, "l string, r string, b string").select(audit.sync_state(F.col("l"), F.col("r"), F.col("b")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["synced", "local-modified", "remote-modified", "synced", "conflict"]


def test_snapshots(spark):
    a, b = (spark.createDataFrame(x, "id long, version long") for x in ([(1, 1), (2, 2), (3, 3)], [(1, 2), (2, 1), (4, 1)]))
    assert {tuple(r) for r in audit.snapshot_events(a, b).collect()} == {(1, "changed"), (3, "deleted"), (4, "created")}
    assert {tuple(r) for r in audit.snapshot_events(a, b, deletions=False).collect()} == {(1, "changed"), (4, "created")}


def test_refresh_needs_a_complete_scan(spark):
    kind = "source_id long, title string, parent_id long, position int, content_digest string, metadata_digest string"
    old = spark.createDataFrame([(1, "a", None, 1, "x", "m"), (2, "b", 1, 1, "x", "m")], kind)
    new = spark.createDataFrame([(1, "A", 2, 1, "y", "n")], kind)
    changes = lambda **k: {tuple(r) for r in audit.refresh_plan(old, new, **k).collect()}
    assert changes(complete=True) == {(1, "content"), (1, "metadata"), (1, "moved"), (1, "renamed"), (2, "deleted")}
    assert (2, "missing") in changes(complete=False)


def test_fair_queue(spark):
    t = dt.datetime(2001, 1, 1)
    rows = [(1, "retry", 1, t), (2, "retry", 1, t), (3, "retry", 2, t), (4, "interactive", 3, t + dt.timedelta(1))]
    order = jobs.fair_order(spark.createDataFrame(rows, "job_id long, priority string, group_key long, enqueued_at timestamp")).orderBy("place")
    assert [r["job_id"] for r in order.collect()] == [4, 1, 3, 2]


def test_eviction(spark):
    items = spark.createDataFrame([("a", 0, 1, 5), ("b", 0, 2, 0), ("c", 0, 3, 5), ("d", 1, 0, 5)], "ref string, rank int, eligible_at int, bytes long")
    assert [r["ref"] for r in jobs.evict(items, 6).orderBy("freed").collect()] == ["a", "c"]
    assert [r["ref"] for r in jobs.evict(items, 99).orderBy("freed").collect()] == ["a", "c", "d"]


def test_retention_at_the_boundaries(spark):
    now = dt.datetime(2001, 8, 2)
    h = lambda n: now - dt.timedelta(hours=n)
    rows = [(1, "succeeded", h(24 * 40), h(24 * 8), h(24), None), (2, "succeeded", h(24 * 40), h(24 * 8), h(23), None), (3, "failed", h(24 * 29), h(24 * 7), None, None), (4, "succeeded", h(24 * 40), h(24 * 8), None, None)]
    df = spark.createDataFrame(rows, "job_id long, state string, created_at timestamp, finished_at timestamp, delivered_at timestamp, dismissed_at timestamp")
    got = {r["job_id"]: (r["release_artifact"], r["release_report"], r["delete_row"]) for r in jobs.retention(df, "2001-08-02").collect()}
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (True, True, False), 4: (False, True, False)}


def test_velocity_trend(spark):
    def trend(*points):
        rows = spark.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "sprint_id long, completed double")
        r = agile.velocity(rows).first()
        return r["average_velocity"], r["trend"]

    assert trend(10, 20, 30) == (20, None) and trend(10, 10, 20, 20) == (15, 100) and trend(0, 0, 5, 5) == (3, None) and trend(10, 10, 10, 10, 40) == (16, 100)


def test_scope_change(spark):
    t = dt.datetime(2024, 1, 1)
    changes = spark.createDataFrame([(1, t, "Sprint", "", "x[id=5]"), (1, t + dt.timedelta(9), "Sprint", "id=5", "id=6"), (2, t, "Sprint", None, "Sprint 5")], "issue_id long, created timestamp, field string, from_text string, to_text string")
    issues = spark.createDataFrame([(1, 3.0), (2, 5.0)], "issue_id long, points double")
    sprints = spark.createDataFrame([(5, t, t + dt.timedelta(9)), (6, t, t + dt.timedelta(8))], "sprint_id long, start_at timestamp, end_at timestamp")
    assert [tuple(r) for r in agile.scope_changes(changes, issues, sprints).collect()] == [(5, 3.0, 3.0)]


def test_burndown_of_no_length(spark):
    empty = spark.createDataFrame([], "day date, points double")
    assert [(r["remaining"], r["ideal"]) for r in agile.burndown(empty, 5.0, "2001-01-01", "2001-01-01").collect()] == [(5.0, None)]


def test_cycles_begin_at_their_least_node_or_are_left_out(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id long, parent_id long")
    assert {(r["id"], r["depth"]) for r in graph.expand_levels(nodes).collect()} == {(1, 0), (2, 1), (3, 2), (4, 0), (5, 1)}
    assert {(r["id"], r["depth"]) for r in graph.expand_levels(nodes, cycles=False).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_label_prune_spares_the_root(spark):
    pages = spark.createDataFrame([(1, []), (2, [1]), (3, [2, 1])], "page_id long, ancestors array<long>")
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "page_id long, label string")
    ids = lambda **k: {r[0] for r in graph.prune_by_label(pages, labels, "x", **k).select("page_id").collect()}
    assert ids() == set() and ids(root=1) == {1}


def test_stacks_and_shares(spark):
    v = spark.createDataFrame([("a", "s1", 2.0), ("a", "s2", -1.0), ("a", "s3", 3.0)], "label string, series string, value double")
    assert {(r["series"], r["start"], r["end"]) for r in charts.stacked(v).collect()} == {("s1", 0.0, 2.0), ("s2", 0.0, -1.0), ("s3", 2.0, 5.0)}
    assert {r["series"]: r["share"] for r in charts.shares(v).collect()} == {"s1": 0.4, "s2": 0.0, "s3": 0.6}


def test_searches_refuse_what_they_would_lose():
    import pytest

    for bad in ({}, {"searchString": ""}, {"unknown": "x"}, {"contributorIds": ["a", "b"]}):
        with pytest.raises(search.Refused):
            search.search_from_source(bad)
    q = search.ContentSearch(text='a"b', spaces=("X", "Y"), labels=("l",), creator="me", ancestor=7)
    assert q.query_text() == 'text ~ "a\\"b" AND space IN ("X", "Y") AND type = "page" AND label = "l" AND creator = currentUser() AND ancestor = 7'


def test_routes(spark):
    old = spark.createDataFrame([(1, "/a"), (2, "/b")], "source_id long, route string")
    new = spark.createDataFrame([(1, "/x"), (3, "/A"), (4, "/c"), (5, "/c")], "source_id long, base string")
    assert {tuple(r) for r in states.stable_routes(old, new).collect()} == {(1, "/a", "kept"), (2, "/b", "tombstoned"), (3, "/A-3", "assigned"), (4, "/c", "assigned"), (5, "/c-5", "assigned")}


def routes_in_turn(previous, wanted, overrides):
    """The same by one page after the other."""
    was, custom = {s: (r, t) for s, r, t in previous}, dict(overrides)
    taken, out = {r.lower() for _, r, _ in previous} | {r.lower() for r in custom.values()}, set()
    for base, page in sorted((b, p) for p, b in wanted):
        if page in custom or page in was:
            before, state = was.get(page, (None, ""))
            route = custom.get(page, before)
            out.add((page, route, "assigned" if before is None else "changed" if route != before else "reactivated" if state == "tombstone" else "kept"))
            continue
        n, route = 0, base
        while route.lower() in taken:
            n += 1
            route = f"{base}-{page}" + (f"-{n}" if n > 1 else "")
        taken.add(route.lower())
        out.add((page, route, "assigned"))
    ids = {p for p, _ in wanted}
    return out | {(s, r, "tombstoned") for s, r, t in previous if s not in ids and t != "tombstone"}


def test_routes_are_those_of_pages_in_turn(spark):
    previous = [(1, "/r", "active"), (2, "/r-20", "active"), (3, "/x", "tombstone"), (4, "/y", "active"), (5, "/z", "tombstone"), (6, "/w", "active")]
    wanted = [(1, "/q"), (3, "/q"), (6, "/w"), (7, "/q")] + [(n, "/R" if n % 2 else "/r") for n in range(18, 24)] + [(30, "/s"), (31, "/s"), (29, "/s-31"), (32, "/s-31-2")]
    overrides = [(6, "/new"), (7, "/r-22"), (99, "/nobody")]
    got = states.stable_routes(
        spark.createDataFrame(previous, "source_id long, route string, state string"), spark.createDataFrame(wanted, "source_id long, base string"),
        spark.createDataFrame(overrides, "source_id long, route string"),
    )
    rows = [tuple(r) for r in got.collect()]
    assert len({r[1].lower() for r in rows}) == len(rows) and set(rows) == routes_in_turn(previous, wanted, overrides[:2])


def test_related_pages_of_two_roots_and_many_labels(spark):
    pages = [(1, "B", None, []), (2, "A", None, []), (3, "C", 1, [1]), (4, "D", 1, [1]), (5, "E", 4, [4, 1]), *((100 + n, f"P{n:03}", 2, [2]) for n in range(40))]
    labels = [(1, "x"), (2, "x"), (1, "y"), (2, "y"), (3, "y"), (5, "x"), *((100 + n, "x") for n in range(0, 40, 2)), *((100 + n, f"l{n % 7}") for n in range(40))]
    links = [(3, 5), (5, 2), (1, 1), (139, 100)]
    of = lambda p: {x for i, x in labels if i == p}
    root = {p: (a[-1] if a else p) for p, _, _, a in pages}
    want = set()
    for a, _, pa, _ in pages:
        scored = []
        for b, title, pb, _ in pages:
            score = 100 * ((a, b) in links) + 75 * ((b, a) in links) + 20 * bool(of(a) & of(b)) + 10 * (pa == pb) + 5 * (root[a] == root[b])
            if a != b and score:
                scored.append((-score, title, b))
        want |= {(a, b, -s, n) for n, (s, _, b) in enumerate(sorted(scored)[:5], 1)}
    got = graph.related_pages(
        spark.createDataFrame(pages, "page_id long, title string, parent_id long, ancestors array<long>"),
        spark.createDataFrame(links, "source_page_id long, target_page_id long"), spark.createDataFrame(labels, "page_id long, label string"),
    )
    assert {tuple(r) for r in got.collect()} == want and (1, 2, 30, 1) in want


def test_deep_chains_and_missing_parents(spark):
    nodes = spark.createDataFrame([(n, n - 1 if n else None) for n in range(100)] + [(500, 499), (501, 500)], "id long, parent_id long")
    found = {r["id"]: (r["root"], r["depth"]) for r in graph.expand_levels(nodes).select("id", "root", "depth").collect()}
    assert found == {n: (0, n) for n in range(100)} | {500: (500, 0), 501: (500, 1)}


def test_upsert_keeps_creation(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, t string, made int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 9)], "id long, t string, made int")
    assert {tuple(r) for r in store.upsert(old, new, ["id"], keep=["made"]).collect()} == {(1, "a", 1), (2, "B", 1), (3, "c", 9)}


def test_places_and_sums_over_partitions(spark):
    from tessera.operators import ranks

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    assert all(r["place"] == r["k"] + 1 for r in ranks.placed(rows, "k").collect())
    total = 0
    for r in sorted(ranks.running_sum(rows, "v", F.desc("k")).collect(), key=lambda r: -r["k"]):
        total += r["v"]
        assert r["total"] == total
    empty = rows.limit(0)
    assert ranks.placed(empty, "k").count() == 0 and ranks.running_sum(empty, "v", "k").count() == 0
    near = {r["k"]: (r["previous"], r["next"]) for r in ranks.beside(ranks.placed(rows, "k"), "place", "k").collect()}
    assert near[0] == (None, 1) and near[999] == (998, None) and near[5] == (4, 6)


def test_extensions(spark):
    from tessera.functions.extensions import Extensions, register_helpers

    x, seen = Extensions(), []
    x.before.append(lambda name, df: seen.append(name))

    @x.renderer("List")
    def passes(df):
        return None

    @x.renderer("list")
    def fails(df):
        raise ValueError("no")

    @x.renderer("list")
    def answers(df):
        return df.filter("id > 1")

    @x.renderer("list")
    def late(df):
        return df.limit(0)

    assert x.render("LIST", spark.range(4)).count() == 2 and x.render("other", spark.range(4)).count() == 4
    assert seen == ["LIST", "other"] and len(x.notes) == 1
    assert "fnv1a" in register_helpers(spark) and spark.sql("select fnv1a('a') as h").first()["h"] == "e40c292c"


def test_label_grid_keeps_every_series(spark):
    values = spark.createDataFrame([(i % 3, f"s{i:03}", float(i)) for i in range(1, 101)], "label int, series string, value double")
    got = {(r["label"], r["series"]): (r["value"], r["missing"]) for r in charts.label_grid(values).collect()}
    assert got == {(k, f"s{i:03}"): (float(i), False) if i % 3 == k else (0.0, True) for i in range(1, 101) for k in range(3)}


def test_comment_threads(spark):
    rows = [(1, 7, "footer", None), (2, 7, "inline", 1), (3, 7, "footer", 2), (4, 7, "inline", None), (5, 8, "inline", 99), (6, 8, "footer", 5), (7, 9, "footer", 8), (8, 9, "footer", 7)]
    got = reports.comment_counts(spark.createDataFrame(rows, "id long, page_id long, kind string, parent_id long"))
    assert sorted(map(tuple, got.collect())) == [(7, 3, 1, 4), (8, 0, 2, 2)]


def test_export_reports(spark):
    rows = [(1, "warning", "a"), (1, "info", "b"), (1, "info", "b"), (2, "info", "a"), (3, "error", "c"), (4, "error", None)]
    issues = spark.createDataFrame(rows, "report long, severity string, code string")
    got = {r["report"]: tuple(r)[1:5] for r in reports.export_reports(issues, F.col("report") != 3, 1).collect()}
    assert got == {1: (2, 1, 0, 2), 2: (1, 0, 0, 0), 3: (0, 0, 1, 0), 4: (0, 0, 1, 2)}
    top = {r["report"]: [tuple(x) for x in r["top_codes"]] for r in reports.export_reports(issues, F.lit(False), 1, F.lit(9)).collect()}
    assert top[1] == [("b", 2)] and top[4] == [(None, 1)]
    files = spark.createDataFrame([("x", "g"), ("y", "g"), ("z", "h")], "file string, g string")
    found = spark.createDataFrame([("x", "error"), ("x", "warning"), ("z", "warning")], "file string, severity string")
    assert sorted(map(tuple, reports.validation_totals(files, found, "g").collect())) == [("g", 2, 1, 1, False), ("h", 1, 0, 1, True)]


def test_gantt_rows(spark):
    rows = [(1, 1, ["Plan", "Start", "End", "Progress"], ["a", "2024-01-01", "2024-01-02", "50"]), (1, 2, ["Plan", "Start", "End", "Progress"], ["b", "2024-01-01"]), (1, 3, ["x", "Start", "End"], [None, "2024-01-01", "2024-01-02"]),
            (2, 1, ["Plan", "Start"], ["a", "2024-01-01"]), (3, 1, ["Task", "Begin", "Due", None], ["", "2024-01-01", "2024-01-01", "1"]), (4, 1, None, None)]
    df = spark.createDataFrame(rows, "table_id long, row_no long, header array<string>, cells array<string>")
    got = [(r["table_id"], r["row_no"], r["label"], r["progress"], r["dependencies"]) for r in charts.gantt_tasks(df).collect()]
    assert sorted(got) == [(1, 1, "a", 0.5, []), (1, 3, "Task 3", None, [])]
    assert charts.gantt_tasks(df, selected=[0, 1]).count() == 0


def test_sweep_gates(spark):
    now = 1_700_000_000
    rows = [("run-%d-x" % (now - 100), "ci", "r"), ("run-%d-x" % (now - 101), "ci", "r"), ("run-1-x", None, "r"), ("mine", "ci", "r"), ("run-1-x", "ci", " "), (None, "ci", "r")]
    df = spark.createDataFrame(rows, "name string, scope string, run_id string")
    got = jobs.sweep_verdicts(df, scope="ci", now="2023-11-14 22:13:20", ttl_seconds=100, title="^run-([0-9]+)-")
    assert [r["verdict"] for r in got.collect()] == ["within-ttl", "sweep", "wrong-scope", "name-mismatch", "no-marker", "name-mismatch"]
    assert [tuple(jobs.sweep_summary(got, n).first()) for n in (0, 1)] == [(1, 5, True), (1, 5, False)]
