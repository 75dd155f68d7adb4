"""Queries of the content audit, change detection, jobs and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import audit, jobs, store
from tessera.plans import views as v
from tessera.plans.register import query

_STALE = """SELECT page_id, months, CASE WHEN months >= 24 THEN 'high' WHEN months >= 12 THEN 'medium' ELSE 'low' END AS severity FROM
  (SELECT page_id, greatest(0, (2001 - year(last_modified)) * 12 + 8 - month(last_modified)) AS months, last_modified FROM v_pages WHERE NOT inaccessible) WHERE months >= 6 AND last_modified < DATE '2001-02-03'"""


def _stale(s, d):
    return audit.stale_pages(store.list_pages(v.pages(s, d)), v.AS_OF, high=24, medium=12, low=6)


@query(_STALE)
def chg09_stale_pages(s, d):
    return _stale(s, d).select("page_id", "months", "severity")


@query("SELECT page_id, version_count FROM v_pages WHERE NOT inaccessible AND version_count >= 25 ORDER BY version_count DESC, page_id")
def srt03_high_churn(s, d):
    return store.list_pages(v.pages(s, d), store.PageFilter(min_version_count=25)).select("page_id", "version_count").orderBy(F.desc("version_count"), "page_id")


@query(f"SELECT page_id, severity IS NOT NULL AS stale FROM v_pages p LEFT JOIN ({_STALE}) USING (page_id) WHERE p.page_id % 4 = 0 AND NOT p.inaccessible")
def chg10_unsynced(s, d):
    remote = store.list_pages(v.pages(s, d))
    unsynced = remote.join(v.pages(s, d).filter("page_id % 4 <> 0").select("page_id"), "page_id", "left_anti")
    return unsynced.select("page_id").join(_stale(s, d).select("page_id", "severity"), "page_id", "left").select("page_id", F.col("severity").isNotNull().alias("stale"))


@query(f"""WITH st AS ({_STALE}), o AS (SELECT page_id FROM v_pages p WHERE parent_id IS NULL AND NOT inaccessible AND NOT EXISTS (SELECT 1 FROM v_links l WHERE l.link_type = 'internal' AND l.target_page_id = p.page_id))
  SELECT 'add-label' AS action, page_id FROM st WHERE severity = 'high' UNION ALL SELECT 'archive', page_id FROM st WHERE months >= 24 UNION ALL SELECT 'delete', page_id FROM o WHERE page_id IN (SELECT page_id FROM st WHERE months >= 12)""")
def chg11_fix_plan(s, d):
    return audit.fix_plan(_stale(s, d), store.orphans(v.pages(s, d), v.links(s, d)))


@query("""WITH c AS (SELECT c.page_id, count(*) AS n, bool_and(coalesce(NOT u.is_active, false)) AS gone FROM v_contributors c LEFT JOIN v_users u USING (user_id) WHERE c.user_id IN ('u1', 'u2', 'u3', 'u4', 'u5') GROUP BY 1)
  SELECT p.page_id, CASE WHEN n = 1 THEN 'bus-factor' ELSE 'no-maintainer' END AS risk FROM v_pages p JOIN c USING (page_id) WHERE n = 1 OR gone""")
def agg19_contributor_risk(s, d):
    few = v.contributors(s, d).filter(F.col("user_id").isin("u1", "u2", "u3", "u4", "u5"))
    return audit.contributor_risks(v.pages(s, d), few, v.users(s, d)).select("page_id", "risk")


@query("SELECT source_page_id, count(*) AS broken FROM v_links WHERE is_broken GROUP BY 1")
def agg14_broken_by_page(s, d):
    return v.links(s, d).filter("is_broken").groupBy("source_page_id").agg(F.count(F.lit(1)).alias("broken"))


@query("SELECT link_type, count(*) AS n, count(target_page_id) AS resolved, count(*) FILTER (is_broken) AS broken FROM v_links GROUP BY 1")
def agg15_link_stats(s, d):
    return audit.link_stats(v.links(s, d))


_DOMAIN = "CASE WHEN target_path IS NULL THEN 'unknown' WHEN regexp_extract(target_path, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) = '' THEN 'invalid-url' ELSE lower(regexp_extract(target_path, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) END"


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM v_links WHERE link_type = 'external' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg33_top_domains(s, d):
    return audit.top_domains(v.links(s, d))


@query(f"SELECT DISTINCT target_path, {_DOMAIN} AS domain FROM v_links WHERE link_type = 'external'")
def str12_link_domains(s, d):
    return v.links(s, d).filter("link_type = 'external'").select("target_path", audit.link_domain(F.col("target_path")).alias("domain")).distinct()


@query(f"""SELECT 'stale' AS "check", count(*) AS n FROM ({_STALE}) UNION ALL SELECT 'broken', count(*) FROM v_links WHERE is_broken UNION ALL SELECT 'external', count(*) FROM v_links WHERE link_type = 'external'
  UNION ALL SELECT 'restricted', count(*) FROM v_pages WHERE is_restricted UNION ALL SELECT 'drafts', count(*) FROM v_pages WHERE content_status = 'draft' UNION ALL SELECT 'folders', count(*) FROM v_pages WHERE content_type = 'folder'""")
def agg20_audit_summary(s, d):
    pages, links = v.pages(s, d), v.links(s, d)
    return audit.audit_summary({
        "stale": _stale(s, d), "broken": links.filter("is_broken"), "external": links.filter("link_type = 'external'"), "restricted": pages.filter("is_restricted"),
        "drafts": pages.filter("content_status = 'draft'"), "folders": pages.filter("content_type = 'folder'"),
    })


@query("SELECT sync_state, count(*) AS n FROM v_pages GROUP BY 1")
def agg21_sync_counts(s, d):
    return v.pages(s, d).groupBy("sync_state").agg(F.count(F.lit(1)).alias("n"))


_LC, _RC = "local_hash <> base_hash", "remote_hash <> base_hash"


@query(f"SELECT page_id, CASE WHEN {_LC} AND {_RC} THEN CASE WHEN local_hash = remote_hash THEN 'synced' ELSE 'conflict' END WHEN {_LC} THEN 'local-modified' WHEN {_RC} THEN 'remote-modified' ELSE 'synced' END AS state FROM v_pages")
def chg01_sync_states(s, d):
    return v.pages(s, d).select("page_id", audit.sync_state(F.col("local_hash"), F.col("remote_hash"), F.col("base_hash")).alias("state"))


@query("""SELECT page_id, CASE WHEN l IS NULL AND r IS NULL THEN 'synced' WHEN l IS NULL THEN 'remote-modified' WHEN r IS NULL THEN 'local-modified' WHEN l <> b AND r <> b THEN CASE WHEN l = r THEN 'synced' ELSE 'conflict' END WHEN l <> b THEN 'local-modified' WHEN r <> b THEN 'remote-modified' ELSE 'synced' END AS state
  FROM (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN local_hash END AS l, CASE WHEN page_id % 6 <> 0 THEN remote_hash END AS r, base_hash AS b FROM v_pages)""")
def chg02_attachment_states(s, d):
    local, remote = F.expr("CASE WHEN page_id % 4 <> 0 THEN local_hash END"), F.expr("CASE WHEN page_id % 6 <> 0 THEN remote_hash END")
    return v.pages(s, d).select("page_id", audit.attachment_state(local, remote, F.col("base_hash")).alias("state"))


@query(f"SELECT page_id, CASE WHEN {_LC} AND version > 4 THEN 'conflict' WHEN {_LC} THEN 'local-modified' WHEN version > 4 THEN 'remote-modified' ELSE 'synced' END AS state FROM v_pages")
def chg03_states_by_version(s, d):
    return v.pages(s, d).select("page_id", audit.sync_state_by_version(F.col("local_hash"), F.col("base_hash"), F.col("version"), F.lit(4)).alias("state"))


@query(f"SELECT page_id, CASE WHEN sync_state = 'conflict' THEN 'conflict' WHEN {_LC} THEN 'local-modified' ELSE 'synced' END AS state FROM v_pages")
def chg04_sticky_conflicts(s, d):
    return v.pages(s, d).select("page_id", F.when(F.col("sync_state") == "conflict", "conflict").when(F.col("local_hash") != F.col("base_hash"), "local-modified").otherwise("synced").alias("state"))


@query("""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(concat(replace(text, ' ', '  '), chr(10), chr(10), chr(10), 'x ', chr(13), chr(10)), chr(13) || chr(10), chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g') AS t FROM documents)
  SELECT doc_id, sha256(concat(regexp_replace(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+$', ''), chr(10))) AS digest FROM x""")
def chg08_content_digests(s, d):
    text = F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n\n\nx \r\n"))
    return v.table(s, d, "documents").select("doc_id", F.sha2(audit.normalized_markdown(text), 256).alias("digest"))


_PREV = "SELECT page_id AS id, version FROM v_pages WHERE page_id % 9 <> 0"
_CUR = "SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN version + 1 WHEN page_id % 7 = 0 THEN version - 1 ELSE version END AS version FROM v_pages WHERE page_id % 8 <> 0"


@query(f"SELECT id, CASE WHEN p.version IS NULL THEN 'created' WHEN c.version IS NULL THEN 'deleted' ELSE 'changed' END AS kind FROM ({_PREV}) p FULL JOIN ({_CUR}) c USING (id) WHERE p.version IS NULL OR c.version IS NULL OR c.version > p.version")
def jn08_poll_events(s, d):
    pages = v.pages(s, d)
    before = pages.filter("page_id % 9 <> 0").select(F.col("page_id").alias("id"), "version")
    now = pages.filter("page_id % 8 <> 0").select(F.col("page_id").alias("id"), F.expr("CASE WHEN page_id % 5 = 0 THEN version + 1 WHEN page_id % 7 = 0 THEN version - 1 ELSE version END").alias("version"))
    return audit.snapshot_events(before, now)


def _snapshots(s, d):
    pages = v.pages(s, d)
    cols = lambda shift: ("page_id as source_id", f"concat(title, CASE WHEN page_id % 10 = {shift} THEN ' (old)' ELSE '' END) as title", f"parent_id + CASE WHEN page_id % 12 = {shift} THEN 1 ELSE 0 END as parent_id", "page_id % 6 as position", f"concat(base_hash, page_id % 14 = {shift}) as content_digest", f"concat(space_key, page_id % 15 = {shift}) as metadata_digest")
    return pages.filter("page_id % 9 <> 0").selectExpr(*cols(1)), pages.filter("page_id % 8 <> 0").selectExpr(*cols(99))


@query("""WITH p AS (SELECT * FROM v_pages WHERE page_id % 9 <> 0), c AS (SELECT * FROM v_pages WHERE page_id % 8 <> 0), b AS (SELECT page_id FROM p INTERSECT SELECT page_id FROM c)
  SELECT page_id AS source_id, 'added' AS change FROM c WHERE page_id NOT IN (SELECT page_id FROM p) UNION ALL SELECT page_id, 'deleted' FROM p WHERE page_id NOT IN (SELECT page_id FROM c)
  UNION ALL SELECT page_id, 'renamed' FROM b WHERE page_id % 10 = 1 UNION ALL SELECT b.page_id, 'moved' FROM b JOIN p USING (page_id) WHERE b.page_id % 12 = 1 AND p.parent_id IS NOT NULL
  UNION ALL SELECT page_id, 'content' FROM b WHERE page_id % 14 = 1 UNION ALL SELECT page_id, 'metadata' FROM b WHERE page_id % 15 = 1""")
def jn07_refresh_plan(s, d):
    before, now = _snapshots(s, d)
    return audit.refresh_plan(before, now, complete=True)


@query("""WITH a AS (SELECT source_page_id, coalesce(CAST(target_page_id AS VARCHAR), target_path, '') AS k FROM v_links WHERE line_number IS NULL OR line_number % 2 = 0), b AS (SELECT source_page_id, coalesce(CAST(target_page_id AS VARCHAR), target_path, '') AS k FROM v_links WHERE source_page_id % 3 <> 0)
  SELECT 'removed' AS change, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def jn09_link_changes(s, d):
    key = F.coalesce(F.col("target_page_id").cast("string"), "target_path", F.lit("")).alias("k")
    old = v.links(s, d).filter("line_number is null or line_number % 2 = 0").select("source_page_id", key).distinct()
    new = v.links(s, d).filter("source_page_id % 3 <> 0").select("source_page_id", key).distinct()
    on = ["source_page_id", "k"]
    return old.join(new, on, "left_anti").withColumn("change", F.lit("removed")).unionByName(new.join(old, on, "left_anti").withColumn("change", F.lit("added")))


_FAIR = """WITH q AS (SELECT *, row_number() OVER (PARTITION BY priority, group_key ORDER BY enqueued_at, job_id) AS turn, first_value(enqueued_at) OVER w AS ht, first_value(job_id) OVER w AS hid FROM v_jobs WHERE state = 'queued' WINDOW w AS (PARTITION BY priority, group_key ORDER BY enqueued_at, job_id))
  SELECT job_id, turn, row_number() OVER (ORDER BY CASE WHEN priority = 'interactive' THEN 0 ELSE 1 END, turn, ht, hid, group_key, job_id) AS place FROM q"""


@query(_FAIR)
def win04_fair_queue(s, d):
    return jobs.fair_order(v.jobs(s, d).filter("state = 'queued'")).select("job_id", "turn", "place")


@query(f"SELECT job_id, place FROM ({_FAIR})")
def win05_queue_position(s, d):
    return jobs.fair_order(v.jobs(s, d).filter("state = 'queued'")).select("job_id", "place")


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id DESC) AS n, delivered_at IS NOT NULL OR dismissed_at IS NOT NULL AS seen FROM v_jobs WHERE state IN ('succeeded', 'failed', 'cancelled')),
  r AS (SELECT job_id, n, created_at, state, seen, coalesce(state <> 'succeeded' OR (seen AND greatest(finished_at, delivered_at, dismissed_at) <= TIMESTAMP '2001-08-01'), false) AS release_artifact, coalesce(finished_at <= TIMESTAMP '2001-07-26', false) AS release_report FROM t)
  SELECT job_id, release_artifact, release_report, (n > 100 OR created_at <= TIMESTAMP '2001-07-03') AND release_artifact AND release_report AND (state <> 'succeeded' OR seen) AS delete_row FROM r""")
def win06_retention(s, d):
    return jobs.retention(v.jobs(s, d), v.AS_OF).select("job_id", "release_artifact", "release_report", "delete_row")


@query("""SELECT ref, bytes, freed FROM (SELECT job_id AS ref, bytes, sum(bytes) OVER (ORDER BY job_id % 4, created_at, job_id) AS freed FROM v_jobs WHERE bytes > 0) WHERE freed - bytes < 400000""")
def win07_eviction(s, d):
    items = v.jobs(s, d).select(F.col("job_id").alias("ref"), "bytes", (F.col("job_id") % 4).alias("rank"), F.col("created_at").alias("eligible_at"))
    return jobs.evict(items, 400_000).select("ref", "bytes", "freed")


@query("""SELECT job_id, bytes FROM (SELECT job_id, bytes, sum(bytes) OVER (ORDER BY CASE WHEN state = 'succeeded' THEN 0 ELSE 1 END, created_at, job_id) AS freed FROM v_jobs WHERE bytes > 0) WHERE freed - bytes < (SELECT sum(bytes) FROM v_jobs) - 1000000""")
def win17_byte_budget(s, d):
    items = v.jobs(s, d).select(F.col("job_id").alias("ref"), "bytes", F.when(F.col("state") == "succeeded", 0).otherwise(1).alias("rank"), F.col("created_at").alias("eligible_at"))
    total = items.agg(F.sum("bytes").alias("n")).first()["n"]
    return jobs.evict(items, total - 1_000_000).select(F.col("ref").alias("job_id"), "bytes")


@query("""WITH c AS (SELECT count(*) FILTER (state NOT IN ('succeeded', 'failed', 'cancelled')) AS active, count(*) FILTER (state = 'failed' AND acknowledged_at IS NULL AND dismissed_at IS NULL) AS failed, count(*) FILTER (state = 'succeeded' AND acknowledged_at IS NULL AND dismissed_at IS NULL) AS succeeded FROM v_jobs)
  SELECT active, failed, succeeded, 'active' AS kind, '9+' AS "text" FROM c""")
def agg23_job_badge(s, d):
    return jobs.badge(v.jobs(s, d))


@query("SELECT job_id, created_at FROM v_jobs WHERE created_at < TIMESTAMP '1999-06-01' OR (created_at = TIMESTAMP '1999-06-01' AND job_id < 5000) ORDER BY created_at DESC, job_id DESC LIMIT 50")
def srt08_keyset_page(s, d):
    return jobs.keyset_page(v.jobs(s, d).select("job_id", "created_at"), 50, ("1999-06-01 00:00:00", 5000))


@query("SELECT count(*) > 200 AS truncated, least(count(*), 200) AS n FROM v_jobs WHERE state = 'failed'")
def srt09_capped_probe(s, d):
    rows, flag = jobs.capped(v.jobs(s, d).filter("state = 'failed'"), ["job_id"], 200)
    return flag.withColumn("n", F.lit(rows.count()).cast("long"))


@query("""SELECT job_id, CASE state WHEN 'running' THEN 0 WHEN 'queued' THEN 1 WHEN 'waiting' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END AS rank FROM v_jobs ORDER BY 2, created_at DESC, job_id""")
def srt10_activity_order(s, d):
    return v.jobs(s, d).withColumn("rank", jobs.activity_rank(F.col("state"))).orderBy("rank", F.desc("created_at"), "job_id").select("job_id", "rank")


@query("SELECT job_id, state FROM v_jobs WHERE dismissed_at IS NULL AND state IN ('failed', 'running') AND created_at > TIMESTAMP '1998-01-01'")
def prd11_activity_filter(s, d):
    return v.jobs(s, d).filter(F.col("dismissed_at").isNull() & F.col("state").isin("failed", "running") & (F.col("created_at") > F.lit("1998-01-01").cast("timestamp"))).select("job_id", "state")


@query("SELECT job_id FROM v_jobs WHERE state IN ('succeeded', 'failed', 'cancelled') AND finished_at < TIMESTAMP '1999-01-01' AND (state <> 'succeeded' OR delivered_at IS NOT NULL OR dismissed_at IS NOT NULL) ORDER BY finished_at, job_id LIMIT 400")
def prd19_deletable_jobs(s, d):
    seen = F.col("delivered_at").isNotNull() | F.col("dismissed_at").isNotNull()
    return v.jobs(s, d).filter(F.col("state").isin(*jobs.TERMINAL) & (F.col("finished_at") < F.lit("1999-01-01").cast("timestamp")) & ((F.col("state") != "succeeded") | seen)).orderBy("finished_at", "job_id").limit(400).select("job_id")


_SWEEP = """SELECT job_id, CASE WHEN group_key % 5 = 0 THEN 'wrong-scope' WHEN job_id % 3 = 0 THEN 'name-mismatch' WHEN state = 'running' THEN 'no-marker' WHEN created_at >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY THEN 'within-ttl' ELSE 'sweep' END AS verdict FROM v_jobs"""


def _sweep(s, d):
    rows = v.jobs(s, d).select(
        "job_id", F.expr("CASE WHEN job_id % 3 = 0 THEN 'By hand' ELSE concat('run-', unix_timestamp(created_at), '-page') END").alias("name"),
        F.expr("CASE WHEN group_key % 10 = 0 THEN 'other' WHEN group_key % 5 <> 0 THEN 'ci' END").alias("scope"), F.expr("CASE WHEN state = 'running' THEN ' ' ELSE 'r' END").alias("run_id"),
    )
    return jobs.sweep_verdicts(rows, scope="ci", now=v.AS_OF, ttl_seconds=365 * 86400, title="^run-([0-9]+)-")


@query(_SWEEP)
def prd18_sweep_gates(s, d):
    return _sweep(s, d).select("job_id", "verdict")


@query(f"SELECT count(*) FILTER (verdict = 'sweep') AS targets, count(*) FILTER (verdict <> 'sweep') AS skipped, count(*) FILTER (verdict = 'sweep') > 50 AS tripped FROM ({_SWEEP})")
def prd18_sweep_breaker(s, d):
    return jobs.sweep_summary(_sweep(s, d), 50)


@query("SELECT event_id, level, type FROM v_logs WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' AND level = 'info' AND starts_with(type, 'api.')")
def prd09_log_filter(s, d):
    return jobs.log_rows(v.logs(s, d), since="2024-01-05", until="2024-01-20", level="info", type_prefix="api.").select("event_id", "level", "type")


@query("SELECT event_id, CAST(json_extract_string(data, '$.k') AS BIGINT) AS k FROM v_logs")
def jsn03_log_data(s, d):
    return v.logs(s, d).select("event_id", F.get_json_object("data", "$.k").cast("long").alias("k"))


@query("SELECT event_id, timestamp, type FROM v_logs WHERE level = 'error' ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def src13_latest_errors(s, d):
    return jobs.log_rows(v.logs(s, d), level="error").orderBy(F.desc("timestamp"), F.desc("event_id")).limit(100).select("event_id", "timestamp", "type")


@query("SELECT job_id, state FROM v_jobs WHERE state = 'queued' ORDER BY created_at DESC, job_id DESC LIMIT 80")
def src21_job_list(s, d):
    return jobs.keyset_page(v.jobs(s, d).filter("state = 'queued'"), 80).select("job_id", "state")


@query("""WITH r AS (SELECT l_returnflag AS e1, l_linestatus AS e2, l_shipdate, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS ms, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS n FROM lineitem),
  b AS (SELECT e1, e2, max(ms) FILTER (n = 1) AS latest, median(ms) FILTER (n BETWEEN 2 AND 41) AS baseline FROM r GROUP BY 1, 2) SELECT *, latest / baseline AS ratio, latest / baseline > 1.2 AS regressed FROM b""")
def agg27_regressions(s, d):
    rows = v.table(s, d, "lineitem").select(F.col("l_returnflag").alias("e1"), F.col("l_linestatus").alias("e2"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("ms"))
    return jobs.regressions(rows, ["e1", "e2"])


@query("SELECT status_category AS code, priority AS severity, count(*) AS n FROM v_issues GROUP BY 1, 2")
def agg24_report_counts(s, d):
    return v.issues(s, d).groupBy(F.col("status_category").alias("code"), F.col("priority").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT group_key // 10 AS batch, count(*) AS total, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed FROM v_jobs GROUP BY 1")
def agg32_bulk_outcomes(s, d):
    return v.jobs(s, d).groupBy(F.expr("group_key div 10").alias("batch")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.count_if(F.col("state") == "failed").alias("failed"))


@query("SELECT event_id, user_id, value >= coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS monotonic FROM v_logs JOIN (SELECT event_id AS e, ts FROM events) ON e = event_id")
def win11_monotonic(s, d):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("timestamp", "event_id"))
    return v.logs(s, d).select("event_id", "user_id", (F.col("value") >= F.coalesce(before, F.col("value"))).alias("monotonic"))
