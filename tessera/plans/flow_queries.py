"""Queries of leases, resolvers, sketches, cleared logs, cursors, and titles and dates of markdown and worklogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.times import worklog_date
from tessera.operators import graph, resolver, sketches, states
from tessera.plans import views as v
from tessera.plans.document_queries import _scratch
from tessera.plans.register import query
from tessera.plans.stream_queries import _drained, _events
from tessera.sources import cursors
from tessera.sources import logs as log_days
from tessera.sources import registry as sources
from tessera.streaming import leases


def _logged(s, d):
    path = _scratch(s)
    sources.append_logs(v.logs(s, d).select("event_id", "timestamp", "level", "type"), path)
    return path


@query("SELECT event_id, level FROM v_logs WHERE timestamp >= TIMESTAMP '2024-01-15'")
def snk11_days_kept(s, d):
    """What is left of logged days after those before the 15th are deleted."""
    path = _logged(s, d)
    log_days.clear_days(s, path, "2024-01-15", confirm=True)
    return sources.logs_from(s, path).select("event_id", "level")


@query("SELECT DISTINCT CAST(timestamp AS DATE) AS day, 'deleted' AS state FROM v_logs WHERE timestamp < TIMESTAMP '2024-01-15'")
def snk11_days_cleared(s, d):
    return log_days.clear_days(s, _logged(s, d), "2024-01-15", confirm=True).select("day", "state")


def _lease_stream(s, d):
    """Events of users as those of jobs: each user's events belong to one of two runners."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'checkpoint' WHEN 'signup' THEN 'finish' ELSE 'cancel' END")
    return _events(s, d).select((F.col("user_id") % 40).alias("job_id"), F.col("event_id").alias("seq"), "ts", kind.alias("event"), F.concat(F.lit("r"), F.col("event_id") % 2).alias("owner"))


@query()
def stm06_lease_events(s, d):
    return _drained(leases.lease_events(_lease_stream(s, d), lease_ms=3_600_000, late="1 hour"))


@query("SELECT user_id % 40 AS job_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS claims, true AS fenced FROM events GROUP BY 1")
def stm06_events_by_job(s, d):
    """Each job's events and claims, none lost, and whether its epochs never outran its claims."""
    out = _drained(leases.lease_events(_lease_stream(s, d), lease_ms=3_600_000, late="1 hour"))
    asked = F.col("event") != "expire"
    return out.groupBy("job_id").agg(F.count_if(asked).alias("events"), F.count_if(F.col("event") == "claim").alias("claims"), (F.max("epoch") == F.count_if((F.col("event") == "claim") & (F.col("verdict") == "ok"))).alias("fenced"))


#: Requests by event: every 97th call is turned away, every seventh finds nothing.
_ASKED = "SELECT event_id AS seq, event_id * 10 AS asked_at, event_type AS service, user_id % 5 AS site, (event_id * 7) % 60 AS key, CASE WHEN event_id % 97 = 50 THEN 'rate-limited' WHEN event_id % 7 = 0 THEN 'not-found' ELSE 'blocks' END AS answer FROM events"
_MET = f"""WITH q AS ({_ASKED}), f AS (SELECT *, asked_at <= 8000 AS in_time, row_number() OVER (PARTITION BY service, site, key ORDER BY seq) = 1 AS call, first_value(answer) OVER (PARTITION BY service, site, key ORDER BY seq) AS shared FROM q),
  o AS (SELECT *, min(CASE WHEN in_time AND call AND answer = 'rate-limited' THEN seq END) OVER (PARTITION BY service, site) AS opened FROM f),
  m AS (SELECT *, CASE WHEN NOT in_time THEN 'deadline' WHEN seq > opened THEN 'open' WHEN call THEN 'called' ELSE 'cached' END AS status FROM o)"""


def _asked(s, d):
    return v.table(s, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") * 10).alias("at"), F.col("event_type").alias("service"), (F.col("user_id") % 5).alias("site"), ((F.col("event_id") * 7) % 60).alias("key"),
        F.expr("CASE WHEN event_id % 97 = 50 THEN 'rate-limited' WHEN event_id % 7 = 0 THEN 'not-found' ELSE 'blocks' END").alias("answer"),
    )


@query(_MET + " SELECT seq, status, CASE status WHEN 'deadline' THEN 'deadline' WHEN 'open' THEN 'rate-limited' ELSE shared END AS given FROM m")
def udf03_request_status(s, d):
    return resolver.answered(_asked(s, d), deadline=8000).select("seq", "status", "given")


@query(_MET + """ SELECT service, site, count(*) FILTER (WHERE status = 'called') AS calls, count(*) FILTER (WHERE status = 'cached') AS cached, count(*) FILTER (WHERE status = 'open') AS turned_away,
  count(*) FILTER (WHERE status = 'deadline') AS late, bool_or(status = 'called' AND answer = 'rate-limited') AS open FROM m GROUP BY 1, 2""")
def udf03_service_states(s, d):
    return resolver.service_states(_asked(s, d), deadline=8000)


@query(_MET + """, t AS (SELECT seq // 3 AS block, seq % 3 AS stage, CASE status WHEN 'deadline' THEN 'deadline' WHEN 'open' THEN 'rate-limited' ELSE shared END AS given, seq % 3 = 1 AS needs_live FROM m),
  g AS (SELECT block, min(stage) FILTER (WHERE given = 'blocks' AND NOT needs_live) AS won, min(stage) FILTER (WHERE given = 'deadline' AND NOT needs_live) AS late, bool_or(needs_live) AS passed FROM t GROUP BY block)
  SELECT block, CASE WHEN won < coalesce(late, 9) THEN 'rendered' ELSE 'kept' END AS outcome, CASE WHEN won < coalesce(late, 9) THEN won END AS stage,
    CASE WHEN won < coalesce(late, 9) THEN 'macro-rendered-via' WHEN late IS NOT NULL OR passed THEN 'macro-skipped-by-config' ELSE 'macro-degraded' END AS code FROM g""")
def udf03_resolved_blocks(s, d):
    """Blocks of three stages each, the middle one of which needs live calls that are switched off."""
    met = resolver.answered(_asked(s, d), deadline=8000)
    stages = met.select(F.expr("seq div 3").alias("block"), (F.col("seq") % 3).alias("stage"), "given", (F.col("seq") % 3 == 1).alias("needs_live"))
    return resolver.resolved(stages, live=False).drop("failures")


_RANGES = "SELECT DATE '2024-01-01' + CAST(k AS INTEGER) AS first_day, DATE '2024-01-01' + CAST(k + 9 AS INTEGER) AS last_day FROM range(0, 20, 5) AS r(k)"


@query(f"SELECT r.first_day, r.last_day, count(*) AS n, true AS distinct_within, true AS rank_within FROM ({_RANGES}) AS r JOIN events ON CAST(ts AS DATE) BETWEEN r.first_day AND r.last_day GROUP BY 1, 2")
def ext03_sketches_of_ranges(s, d):
    """Distinct users and median values of ranges of days from stored sketches of days, held against the exact ones."""
    events, path = v.table(s, d, "events"), _scratch(s)
    sketches.daily(events, "ts", "user_id", "value").write.parquet(path)
    ranges = s.range(0, 20, 5).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("first_day"), F.expr("date_add(date'2024-01-01', cast(id + 9 as int))").alias("last_day"))
    about = sketches.over_ranges(s.read.parquet(path), ranges)
    days = ranges.select("*", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    rows = events.withColumn("day", F.to_date("ts")).join(days, "day").join(about.select("first_day", "quantile_about"), "first_day")
    exact = rows.groupBy("first_day").agg(F.count_distinct("user_id").alias("users"), F.avg((F.col("value") < F.col("quantile_about")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("quantile_about")).cast("double")).alias("upto"))
    within = F.abs(F.col("distinct_about") - F.col("users")) <= F.lit(sketches.DISTINCT_ERROR) * F.col("users") + 1
    rank = (F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)
    return about.join(exact, "first_day").select("first_day", "last_day", "n", within.alias("distinct_within"), rank.alias("rank_within"))


@query("""WITH p AS (SELECT event_id AS token, CASE WHEN event_id < (SELECT max(event_id) FROM events) THEN event_id + 1 END AS next_token FROM events)
  SELECT concat('t', token) AS token, CAST(token - 5 AS BIGINT) AS place, CASE WHEN next_token IS NULL THEN 'last' ELSE 'more' END AS state FROM p WHERE token >= 5""")
def src12_cursor_drain(s, d):
    """Answers that each name the next, read from the fifth on."""
    last = v.table(s, d, "events").agg(F.max("event_id").alias("last"))
    pages = v.table(s, d, "events").join(F.broadcast(last)).select(F.concat(F.lit("t"), "event_id").alias("token"), F.when(F.col("event_id") < F.col("last"), F.concat(F.lit("t"), F.col("event_id") + 1)).alias("next_token"))
    return cursors.drained(pages, "t5")


@query("""SELECT doc_id AS page_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE concat('Title ', doc_id) END AS title FROM documents""")
def str13_markdown_titles(s, d):
    """The first heading of the first level of each document's markdown, after frontmatter and lesser headings."""
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('# Title ', doc_id, '\\n# Other') WHEN 1 THEN concat('---\\na: b\\n---\\n\\n## Part\\n#   Title ', doc_id, '  \\ntext') WHEN 2 THEN concat('text\\n\\n# Title ', doc_id) ELSE concat('#Title ', doc_id, '\\n## Part') END")
    return v.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), sources.heading(text).alias("title"))


@query("SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), '+0000') AS started FROM events")
def dat11_worklog_dates(s, d):
    return v.table(s, d, "events").select("event_id", worklog_date(F.col("ts").cast("timestamp")).alias("started"))


@query("""WITH b AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN doc_id + 2 WHEN doc_id % 10 IN (1, 2) THEN doc_id - 1 ELSE doc_id - doc_id % 10 + 1 END AS parent_id FROM documents WHERE doc_id % 10 < 5), k AS (SELECT b.*, p.id IS NOT NULL AS known FROM b LEFT JOIN b AS p ON b.parent_id = p.id),
  c AS (SELECT id - id % 10 AS base, count(*) FILTER (WHERE id % 10 < 3) = 3 AS round FROM b GROUP BY 1), r AS (SELECT k.*, NOT known OR (c.round AND k.id % 10 = 0) AS root FROM k JOIN c ON c.base = k.id - k.id % 10)
  SELECT r.id, CASE WHEN r.root THEN r.id WHEN p.root THEN p.id WHEN g.root THEN g.id ELSE g.parent_id END AS root, CASE WHEN r.root THEN 0 WHEN p.root THEN 1 WHEN g.root THEN 2 ELSE 3 END AS depth
  FROM r LEFT JOIN r AS p ON r.parent_id = p.id LEFT JOIN r AS g ON p.parent_id = g.id""")
def hie05_forest_with_cycles(s, d):
    """A forest of cycles of three pages (0 below 2 below 1 below 0, of each ten) with pages below them: each cycle begins at its least page."""
    nodes = v.table(s, d, "documents").filter("doc_id % 10 < 5").select(
        F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 10 = 0 THEN doc_id + 2 WHEN doc_id % 10 IN (1, 2) THEN doc_id - 1 ELSE doc_id - doc_id % 10 + 1 END").alias("parent_id")
    )
    return graph.expand_levels(nodes).select("id", "root", "depth")


@query("""WITH p AS (SELECT page_id AS source_id, concat('/p', page_id) AS route FROM v_pages WHERE page_id % 2 = 0), o AS (SELECT page_id AS source_id, CASE WHEN page_id % 6 = 0 THEN concat('/P', page_id + 4) ELSE concat('/o', page_id) END AS custom FROM v_pages WHERE page_id % 3 = 0),
  c AS (SELECT o.source_id, o.custom FROM o JOIN p ON lower(o.custom) = lower(p.route) AND o.source_id <> p.source_id), w AS (SELECT page_id AS source_id, concat('/n', page_id) AS base FROM v_pages), k AS (SELECT * FROM o WHERE source_id NOT IN (SELECT source_id FROM c))
  SELECT w.source_id, coalesce(k.custom, p.route, w.base) AS route, CASE WHEN p.route IS NULL THEN 'assigned' WHEN k.custom IS NOT NULL THEN 'changed' ELSE 'kept' END AS change FROM w LEFT JOIN p USING (source_id) LEFT JOIN k USING (source_id)
  UNION ALL SELECT source_id, custom, 'collision' FROM c""")
def hie06_route_collisions(s, d):
    """Overrides of every third page; those of every sixth ask for the route of another page."""
    pages = v.pages(s, d).select(F.col("page_id").alias("source_id"))
    previous = pages.filter("source_id % 2 = 0").withColumn("route", F.concat(F.lit("/p"), "source_id"))
    overrides = pages.filter("source_id % 3 = 0").withColumn("route", F.expr("CASE WHEN source_id % 6 = 0 THEN concat('/P', source_id + 4) ELSE concat('/o', source_id) END"))
    return states.stable_routes(previous, pages.withColumn("base", F.concat(F.lit("/n"), "source_id")), overrides)
