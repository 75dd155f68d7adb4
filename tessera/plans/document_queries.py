"""Queries of document texts, states, files and streams; SQL stands beside those that it can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import documents as doc
from tessera.operators import jobs, states
from tessera.plans import views as v
from tessera.plans.register import query
from tessera.sources import registry as sources


def _col(name: str):
    function, returns = doc.COLUMNS[name]
    return doc.column(function, returns)


def _html(s, d):
    return v.table(s, d, "pages")


@query()
def src19_html_blocks(s, d):
    return _html(s, d).select("page_id", F.explode(_col("html_blocks")("html")).alias("b")).select("page_id", "b.path", "b.type", "b.text")


@query("SELECT page_id, concat('h', page_id) AS heading, 'two' AS para FROM pages")
def src20_adf_blocks(s, d):
    adf = F.concat(F.lit('{"type":"doc","content":[{"type":"heading","content":[{"type":"text","text":"h'), "page_id", F.lit('"}]},{"type":"paragraph","content":[{"type":"text","text":"two"}]}]}'))
    return _html(s, d).select("page_id", _col("adf_blocks")(adf).alias("b")).select("page_id", F.element_at("b.text", 1).alias("heading"), F.element_at("b.text", 2).alias("para"))


_MD = "concat('# T', page_id, '\\n`[no](x)` ![i](y.png)\\n[a](p', page_id % 7, '.md) and [b](https://e.example/', page_id, ' \"t\")')"


@query("SELECT page_id, unnest(['p' || (page_id % 7) || '.md', 'https://e.example/' || page_id]) AS target, 3 AS line FROM pages")
def str09_markdown_links(s, d):
    return _html(s, d).select("page_id", F.explode(_col("markdown_links")(F.expr(_MD))).alias("l")).select("page_id", "l.target", "l.line")


@query("SELECT page_id, concat('ecole-strasse-', page_id) AS slug FROM pages")
def str03_heading_slugs(s, d):
    return _html(s, d).select("page_id", _col("heading_slug")(F.concat(F.lit("École Straße! "), "page_id")).alias("slug"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'index-page' ELSE concat('plan-é-', page_id) END AS slug FROM pages")
def str04_path_slugs(s, d):
    return _html(s, d).select("page_id", _col("path_slug")(F.expr("CASE WHEN page_id % 2 = 0 THEN 'Index' ELSE concat('Plan_É/', page_id) END")).alias("slug"))


@query("SELECT page_id, [0, 1, 1] AS depths, ['one', 'two', 'two-2'] AS anchors FROM pages")
def hie07_heading_toc(s, d):
    toc = _col("headings_toc")(F.concat(F.lit("# One\n## Two\n```\n# no\n```\n## Two\n"), F.col("page_id").cast("string")))
    return _html(s, d).select("page_id", toc.alias("t")).select("page_id", F.col("t.depth").alias("depths"), F.col("t.anchor").alias("anchors"))


@query("SELECT event_id, concat('{\"a\":', event_id, ',\"b\":1}') AS canonical FROM events")
def jsn02_canonical_json(s, d):
    return v.table(s, d, "events").select("event_id", _col("canonical_json")(F.concat(F.lit('{"b": 1, "a": '), "event_id", F.lit("}"))).alias("canonical"))


@query("SELECT event_id, sha256(concat('{\"a\":', event_id, ',\"b\":1}')) AS digest FROM events")
def hie10_canonical_digests(s, d):
    return v.table(s, d, "events").select("event_id", F.sha2(_col("canonical_json")(F.concat(F.lit('{"b": 1, "a": '), "event_id", F.lit("}"))), 256).alias("digest"))


@query()
def mth05_fnv_digests(s, d):
    return v.table(s, d, "supplier").select("s_suppkey", _col("fnv1a")("s_name").alias("digest"))


@query("SELECT s_suppkey, concat('a', chr(10), 'L', chr(10), 'c', chr(10), CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'd' END) AS merged, 0 AS conflicts FROM supplier")
def chg05_three_way_merge(s, d):
    remote = F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'a\\nb\\nc\\nR' ELSE 'a\\nb\\nc\\nd' END")
    m = v.table(s, d, "supplier").select("s_suppkey", _col("merge_three")(F.lit("a\nb\nc\nd"), F.lit("a\nL\nc\nd"), remote).alias("m"))
    return m.select("s_suppkey", F.col("m.text").alias("merged"), F.col("m.conflicts").alias("conflicts"))


@query("SELECT s_suppkey, concat('a', chr(10), 'theirs ', s_suppkey, chr(10), 'c') AS resolved FROM supplier")
def chg06_resolved_conflicts(s, d):
    m = _col("merge_three")(F.lit("a\nb\nc"), F.concat(F.lit("a\nmine\nc")), F.concat(F.lit("a\ntheirs "), "s_suppkey", F.lit("\nc")))
    pick = doc.column(lambda t: doc.resolve_conflicts(t, "remote"), "string")
    return v.table(s, d, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", pick("m.text").alias("resolved"))


@query("SELECT s_suppkey, 1 AS hunks, 1 AS additions, 1 AS deletions FROM supplier")
def chg07_diffs(s, d):
    diff = _col("unified_diff")(F.lit("a\nb\nc"), F.concat(F.lit("a\nx"), "s_suppkey", F.lit("\nc")))
    return v.table(s, d, "supplier").select("s_suppkey", diff.alias("f")).select("s_suppkey", "f.hunks", "f.additions", "f.deletions")


@query("SELECT s_suppkey, s_suppkey % 5 IN (0, 1, 2) AS private FROM supplier")
def prd20_private_hosts(s, d):
    host = F.expr("element_at(array('localhost', '10.1.2.3', '[::1]', '8.8.8.8', 'www.example.com'), cast(s_suppkey % 5 as int) + 1)")
    return v.table(s, d, "supplier").select("s_suppkey", _col("private_host")(host).alias("private"))


@query("SELECT s_suppkey, s_suppkey % 4 IN (0, 2) AS ignored FROM supplier")
def prd13_ignored_paths(s, d):
    path = F.expr("element_at(array('build/x.md', 'docs/keep.log', 'a/b.log', 'docs/a.md'), cast(s_suppkey % 4 as int) + 1)")
    test = doc.column(lambda p: doc.ignored(p, ["*.log", "build/", "!docs/keep.log"]), "boolean")
    return v.table(s, d, "supplier").select("s_suppkey", test(path).alias("ignored"))


@query("SELECT s_suppkey, concat('{\"authorization\": \"Bearer [REDACTED]\", \"n\": ', s_suppkey, ', \"nested\": [{\"apiToken\": \"[REDACTED]\"}]}') AS shown FROM supplier")
def str17_redacted_json(s, d):
    text = F.concat(F.lit('{"authorization": "Bearer abc", "nested": [{"apiToken": "x"}], "n": '), "s_suppkey", F.lit("}"))
    return v.table(s, d, "supplier").select("s_suppkey", _col("redacted_json")(text).alias("shown"))


@query("SELECT s_suppkey, concat('HELLO ', s_suppkey, '!') AS said FROM supplier")
def str27_templates(s, d):
    render = doc.column(lambda n: doc.rendered("{{upper greeting}} {{ n }}!{{missing}}", {"greeting": "hello", "n": n}), "string")
    return v.table(s, d, "supplier").select("s_suppkey", render(F.col("s_suppkey")).alias("said"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ['unclosed-code'] ELSE ['unsafe-link', 'empty-link'] END AS codes FROM supplier")
def val02_markdown_issues(s, d):
    text = F.expr("CASE WHEN s_suppkey % 2 = 0 THEN '```\\nx' ELSE '[a](javascript:x) [b]()' END")
    return v.table(s, d, "supplier").select("s_suppkey", _col("markdown_issues")(text).alias("i")).select("s_suppkey", F.col("i.code").alias("codes"))


@query("SELECT doc_id, 'yes' AS tag, concat('Doc ', doc_id) AS title FROM documents")
def src17_frontmatter(s, d):
    text = F.concat(F.lit("---\ntag: 'yes'\nid: 1\n---\n# Doc "), "doc_id", F.lit("\nbody"))
    return v.table(s, d, "documents").select("doc_id", sources.frontmatter(text)["tag"].alias("tag"), sources.heading(text).alias("title"))


def _scratch(s) -> str:
    folder = s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not s.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or "/tmp/tessera"
    return f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query("SELECT issue_key, priority, points_raw FROM v_issues")
def snk08_csv_round_trip(s, d):
    path = _scratch(s)
    sources.write_csv(v.issues(s, d).select("issue_key", "priority", "points_raw"), path)
    return sources.load(s, "csv", path).select("issue_key", "priority", "points_raw")


@query("SELECT event_id, level, type FROM v_logs WHERE timestamp >= TIMESTAMP '2024-01-20'")
def snk10_log_files(s, d):
    path = _scratch(s)
    sources.append_logs(v.logs(s, d).select("event_id", "timestamp", "level", "type"), path)
    return sources.logs_from(s, path, before="2024-01-20").select("event_id", "level", "type")


@query("SELECT page_id, title, version FROM v_pages")
def snk05_versioned_table(s, d):
    path = _scratch(s)
    sources.write_table(v.pages(s, d).select("page_id", "title", "version").withColumn("version", F.col("version") * 0), path)
    sources.write_table(v.pages(s, d).select("page_id", "title", "version"), path)
    return sources.read_table(s, path)


@query("SELECT page_id, label FROM v_labels")
def snk06_store_export(s, d):
    path, labels = _scratch(s), v.labels(s, d)
    sources.export_store({"labels": labels}, path)
    return sources.import_store(s, path, {"labels": labels.schema})["labels"]


@query("SELECT 'A' AS page_id, 'a.md' AS path, 'One' AS title, 2 AS version, 'synced' AS sync_state UNION ALL SELECT 'B', 'B.md', 'Untitled', 1, 'conflict'")
def snk07_legacy_state(s, d):
    text = '{"schemaVersion": 1, "pages": {"A": {"path": "a.md", "title": "One", "version": 2}, "B": {"syncState": "conflict"}}}'
    return sources.migrate_state(s, text).select("page_id", "path", "title", "version", "sync_state")


@query("SELECT issue_key AS k, priority, NULL AS score FROM v_issues UNION ALL SELECT concat('P-', page_id), NULL, version FROM v_pages")
def set05_column_union(s, d):
    a = v.issues(s, d).select(F.col("issue_key").alias("k"), "priority")
    b = v.pages(s, d).select(F.expr("concat('P-', page_id)").alias("k"), F.col("version").alias("score"))
    return sources.union_all([a, b])


_EVENTS = "SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'waiting' ELSE 'failed' END AS state FROM events"


@query(f"""WITH e AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS was FROM ({_EVENTS})) SELECT job_id, seq, was, state FROM e WHERE was IS NOT NULL AND was <> state AND NOT (
  (was = 'queued' AND state IN ('running', 'cancelled')) OR (was = 'running' AND state IN ('waiting', 'succeeded', 'failed', 'cancelled', 'queued')) OR (was = 'waiting' AND state IN ('queued', 'running', 'cancelled', 'failed')))""")
def chg12_invalid_transitions(s, d):
    state = F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'waiting' ELSE 'failed' END")
    return states.invalid_transitions(v.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("state")))


@query("""WITH r AS (SELECT job_id % 300 AS action_key, job_id AS seq, state, CASE WHEN job_id % 2 = 0 THEN 'retry' ELSE 'rerun' END AS action, concat('p', job_id % 4) AS payload FROM v_jobs)
  SELECT action_key, seq, CASE WHEN first_value(payload) OVER (PARTITION BY action_key ORDER BY seq) <> payload THEN 'conflict' WHEN NOT (CASE WHEN action = 'retry' THEN state IN ('failed', 'cancelled') ELSE state = 'succeeded' END) THEN 'refused' ELSE 'accepted' END AS verdict FROM r""")
def chg13_replays(s, d):
    r = v.jobs(s, d).select((F.col("job_id") % 300).alias("action_key"), F.col("job_id").alias("seq"), "state", F.expr("CASE WHEN job_id % 2 = 0 THEN 'retry' ELSE 'rerun' END").alias("action"), F.expr("concat('p', job_id % 4)").alias("payload"))
    return states.replay_verdicts(r)


@query("SELECT job_id AS id, 'bytes' AS resource, bytes - 3000.0 AS missing FROM v_jobs WHERE bytes > 3000 UNION ALL SELECT job_id, 'pages', job_id % 50 - 40.0 FROM v_jobs WHERE job_id % 50 > 40")
def chg14_shortfalls(s, d):
    needs = v.jobs(s, d).select(F.col("job_id").alias("id"), F.col("bytes").cast("double").alias("bytes"), (F.col("job_id") % 50).cast("double").alias("pages"))
    return states.shortfalls(needs, {"bytes": 3000.0, "pages": 40.0})


@query("""SELECT l_orderkey AS run_id, CAST(epoch(max(l_shipdate)) - epoch(min(l_shipdate)) AS BIGINT) AS wall_s, sum(l_quantity) AS runner_s, CASE WHEN bool_or(l_returnflag = 'A') THEN 'cancelled' WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'green' END AS class FROM lineitem GROUP BY 1""")
def agg31_job_timings(s, d):
    runs = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("created"), F.col("l_shipdate").alias("ended"), F.col("l_quantity").alias("seconds"), F.expr("CASE l_returnflag WHEN 'A' THEN 'cancelled' WHEN 'R' THEN 'failed' ELSE 'ok' END").alias("state"))
    return states.job_timings(runs)


@query("""WITH RECURSIVE j AS (SELECT l_orderkey AS run_id, l_linenumber AS job, min(l_shipdate) AS ended FROM lineitem GROUP BY 1, 2), l AS (SELECT n.run_id, n.job, arg_max(n.needs, {'e': j.ended, 'n': n.needs}) AS parent
    FROM (SELECT a.run_id, a.job, b.job AS needs FROM j a JOIN j b ON a.run_id = b.run_id AND b.job < a.job) n JOIN j ON j.run_id = n.run_id AND j.job = n.needs GROUP BY 1, 2),
  p AS (SELECT run_id, arg_max(job, {'e': ended, 'n': job}) AS job, 0 AS "at" FROM j GROUP BY 1 UNION ALL SELECT p.run_id, l.parent, p."at" + 1 FROM p JOIN l ON l.run_id = p.run_id AND l.job = p.job) SELECT run_id, "at", job FROM p""")
def agg31_critical_path(s, d):
    j = v.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("job")).agg(F.min("l_shipdate").alias("ended"))
    needs = j.select("run_id", "job").join(j.select("run_id", F.col("job").alias("needs")), "run_id").filter("needs < job")
    return states.critical_path(j, needs)


@query("""WITH p AS (SELECT page_id AS source_id, CASE WHEN page_id % 3 = 0 THEN concat('/r', page_id % 90) ELSE concat('/p', page_id) END AS route FROM v_pages WHERE page_id % 4 <> 1), w AS (SELECT page_id AS source_id, concat('/R', page_id % 90) AS base FROM v_pages WHERE page_id % 5 <> 2),
  n AS (SELECT w.source_id, w.base, row_number() OVER (PARTITION BY lower(base) ORDER BY w.base, w.source_id) = 1 AND lower(w.base) NOT IN (SELECT lower(route) FROM p) AS free FROM w WHERE w.source_id NOT IN (SELECT source_id FROM p))
  SELECT w.source_id, p.route, 'kept' AS change FROM w JOIN p USING (source_id) UNION ALL SELECT source_id, CASE WHEN free THEN base ELSE concat(base, '-', source_id) END, 'assigned' FROM n UNION ALL SELECT source_id, route, 'tombstoned' FROM p WHERE source_id NOT IN (SELECT source_id FROM w)""")
def hie06_stable_routes(s, d):
    pages = v.pages(s, d)
    previous = pages.filter("page_id % 4 <> 1").select(F.col("page_id").alias("source_id"), F.expr("CASE WHEN page_id % 3 = 0 THEN concat('/r', page_id % 90) ELSE concat('/p', page_id) END").alias("route"))
    wanted = pages.filter("page_id % 5 <> 2").select(F.col("page_id").alias("source_id"), F.expr("concat('/R', page_id % 90)").alias("base"))
    return states.stable_routes(previous, wanted)


@query("""WITH RECURSIVE d AS (SELECT page_id, unnest([page_id // 2, page_id // 3]) AS include FROM v_pages WHERE page_id > 3), r AS (SELECT page_id, include, 1 AS depth FROM d UNION SELECT r.page_id, d.include, r.depth + 1 FROM r JOIN d ON d.page_id = r.include)
  SELECT page_id, include, min(depth) AS depth FROM r WHERE include <> page_id GROUP BY 1, 2""")
def hie09_includes(s, d):
    pages = v.pages(s, d).filter("page_id > 3").select("page_id", F.expr("array(page_id div 2, page_id div 3)").alias("includes"))
    return states.expand_includes(pages)


@query("SELECT plan, count(*) AS units, count(DISTINCT unit) AS distinct_units FROM (SELECT l_orderkey AS plan, l_linenumber AS unit FROM lineitem) GROUP BY 1")
def srt13_least_loaded(s, d):
    units = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("long").alias("unit"), F.col("l_quantity").alias("weight"))
    return states.least_loaded(units, 3).groupBy("plan").agg(F.count("bin").alias("units"), F.count_distinct("unit").alias("distinct_units"))


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY priority, group_key ORDER BY enqueued_at, job_id) AS turn FROM v_jobs WHERE state = 'queued') SELECT job_id, group_key FROM q WHERE turn = 1 ORDER BY CASE WHEN priority = 'interactive' THEN 0 ELSE 1 END, CASE WHEN group_key > 17 THEN 0 ELSE 1 END, group_key, job_id LIMIT 1""")
def win16_claim_next(s, d):
    queued = v.jobs(s, d).filter("state = 'queued'")
    return states.claim_next(queued, 17, jobs.fair_order(queued).select("job_id", "turn"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN least(600, greatest(1, o_orderkey % 900)) WHEN 1 THEN 60 END AS wait FROM orders")
def dat18_retry_after(s, d):
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN cast(o_orderkey % 900 as string) WHEN 1 THEN 'Thu, 02 Aug 2001 00:01:00 GMT' ELSE '-5' END")
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))) - F.unix_timestamp(F.lit(v.AS_OF).cast("timestamp"))
    wait = F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).when(text.rlike("^[A-Za-z]"), at)
    return v.table(s, d, "orders").select("o_orderkey", F.when(wait.isNotNull(), F.least(F.lit(600), F.greatest(F.lit(1), wait))).alias("wait"))


@query("SELECT DISTINCT k, CASE k % 4 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 5 END AS minutes FROM (SELECT o_orderkey % 8 AS k FROM orders)")
def dat05_rounding_intervals(s, d):
    text = F.expr("CASE k % 4 WHEN 0 THEN '15m' WHEN 1 THEN '1h' WHEN 2 THEN '5' ELSE 'x' END")
    n = F.regexp_extract(text, "^([0-9]+)[mh]?$", 1).try_cast("int")
    return v.table(s, d, "orders").select((F.col("o_orderkey") % 8).alias("k")).distinct().select("k", F.when(text.endswith("h"), n * 60).otherwise(n).alias("minutes"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year_start FROM orders")
def dat15_period_starts(s, d):
    return v.table(s, d, "orders").select("o_orderkey", F.date_format(F.add_months(F.date_trunc("month", "o_orderdate"), 1), "yyyy-MM-dd").alias("next_month"), F.date_format(F.date_trunc("year", "o_orderdate"), "yyyy-MM-dd").alias("year_start"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def dat14_locale_dates(s, d):
    text = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') WHEN o_orderkey % 4 = 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE '32.13.2000' END")
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("dd.MM.yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return v.table(s, d, "orders").select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd").alias("day"))


@query("SELECT k, CAST(unnest(generate_series(k, k + 40, 10)) AS BIGINT) AS tick FROM (SELECT DISTINCT o_orderkey % 5 AS k FROM orders)")
def mth04_ticks(s, d):
    k = v.table(s, d, "orders").select((F.col("o_orderkey") % 5).alias("k")).distinct()
    return k.select("k", F.explode(F.sequence("k", F.col("k") + 40, F.lit(10).cast("long"))).alias("tick"))


@query("SELECT DISTINCT k, k % 3 = 0 AS flag, CASE WHEN k % 5 < 3 THEN (k % 5) / 2.0 END AS opacity FROM (SELECT o_orderkey % 15 AS k FROM orders)")
def mth08_chart_parameters(s, d):
    k = v.table(s, d, "orders").select((F.col("o_orderkey") % 15).alias("k")).distinct()
    flag = F.lower(F.when(F.col("k") % 3 == 0, "TRUE").otherwise("no")).isin("true", "yes", "1")
    percent = F.expr("concat((k % 5) * 50, '%')")
    n = F.regexp_extract(percent, "^([0-9]+)%$", 1).try_cast("double") / 100
    return k.select("k", flag.alias("flag"), F.when(n.between(0, 1), n).alias("opacity"))


@query("SELECT label, count(*) > 2000 OR count(DISTINCT vec_id) > 20000 AS too_large, count(*) AS n FROM embeddings GROUP BY 1")
def val01_chart_limits(s, d):
    return v.table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("u")).select("label", ((F.col("n") > 2000) | (F.col("u") > 20000)).alias("too_large"), "n")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([^/?#]*)$', 1) AS leaf FROM pages")
def str26_url_parts(s, d):
    return _html(s, d).select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([^/?#]*)$", 1).alias("leaf"))


@query("SELECT label, sum(CASE WHEN series = '1-URGENT' THEN value ELSE 0 END) AS urgent FROM (SELECT year(o_orderdate) AS label, o_orderpriority AS series, o_totalprice AS value FROM orders) GROUP BY 1")
def rsh05_selected_series(s, d):
    rows = v.table(s, d, "orders").groupBy(F.year("o_orderdate").alias("label")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.sum("o_totalprice"))
    wanted = {c.lower(): c for c in rows.columns}["1-urgent"]
    return rows.select("label", F.coalesce(F.col(wanted), F.lit(0.0)).alias("urgent"))


@query("SELECT o_orderstatus AS series, unnest([1, 2, 3]) AS place, unnest([min(o_orderkey), max(o_orderkey), count(*)]) AS value FROM orders GROUP BY 1")
def rsh06_long_rows(s, d):
    g = v.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("series")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count(F.lit(1)).alias("c"))
    return g.select("series", F.posexplode(F.array("a", "b", "c")).alias("at", "value")).select("series", (F.col("at") + 1).alias("place"), "value")
