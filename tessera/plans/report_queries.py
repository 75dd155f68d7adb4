"""Queries of the whole audit summary, of chart limits, of product addresses and of bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import audit, charts, graph, states, store
from tessera.plans import views as v
from tessera.plans.audit_queries import _STALE, _stale
from tessera.plans.register import query

_OPEN = "SELECT * FROM v_pages WHERE NOT inaccessible"
_COUNTERS = {
    **{f"stale.{k}": f"SELECT 1 FROM ({_STALE}) WHERE severity = '{k}'" for k in ("high", "medium", "low")},
    "orphans": "SELECT 1 FROM v_pages AS p WHERE parent_id IS NULL AND NOT inaccessible AND NOT EXISTS (SELECT 1 FROM v_links AS l WHERE l.link_type = 'internal' AND l.target_page_id = p.page_id)",
    "brokenLinks": "SELECT 1 FROM v_links WHERE is_broken AND link_type <> 'external'",
    "contributorRisks": "SELECT 1 FROM (SELECT c.page_id, count(*) AS n, bool_and(coalesce(NOT u.is_active, false)) AS gone FROM v_contributors c LEFT JOIN v_users u USING (user_id) GROUP BY 1) AS c JOIN v_pages USING (page_id) WHERE n = 1 OR gone",
    "externalLinks": "SELECT 1 FROM v_links WHERE link_type = 'external'", "brokenExternalLinks": "SELECT 1 FROM v_links WHERE link_type = 'external' AND is_broken",
    "missingLabel": f"SELECT 1 FROM ({_OPEN}) AS p WHERE NOT EXISTS (SELECT 1 FROM v_labels AS l WHERE l.page_id = p.page_id AND l.label = 'Draft')", "restricted": f"SELECT 1 FROM ({_OPEN}) WHERE is_restricted",
    "drafts": f"SELECT 1 FROM ({_OPEN}) WHERE content_status = 'draft'", "archived": f"SELECT 1 FROM ({_OPEN}) WHERE content_status = 'archived'", "highChurn": f"SELECT 1 FROM ({_OPEN}) WHERE version_count >= 25",
    "folderIssues": "SELECT 1 FROM v_pages AS p WHERE content_type = 'folder' AND NOT EXISTS (SELECT 1 FROM v_pages AS c WHERE c.parent_id = p.page_id)", "unsynced": f"SELECT 1 FROM ({_OPEN}) WHERE page_id % 4 = 0",
    **{f"unsyncedStale.{k}": f"SELECT 1 FROM ({_STALE}) WHERE severity = '{k}' AND page_id % 4 = 0" for k in ("high", "medium", "low")},
}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS "check", (SELECT count(*) FROM ({sql})) AS n""" for k, sql in _COUNTERS.items()))
def agg20_audit_counters(s, d):
    """All counters of the audit: those of pages in one pass over them, those of links in one over the links."""
    pages, links, labels = v.pages(s, d), v.links(s, d), v.labels(s, d)
    open_ = store.list_pages(pages)
    severity = _stale(s, d).select("page_id", "severity")
    tagged = labels.filter("label = 'Draft'").select("page_id", F.lit(True).alias("tagged")).distinct()
    synced = pages.filter("page_id % 4 <> 0").select("page_id", F.lit(True).alias("synced"))
    at = open_.join(severity, "page_id", "left").join(tagged, "page_id", "left").join(synced, "page_id", "left")
    external = F.col("link_type") == "external"
    parts = {
        **{f"stale.{k}": F.col("severity") == k for k in ("high", "medium", "low")}, "missingLabel": F.col("tagged").isNull(), "restricted": F.col("is_restricted"), "drafts": F.col("content_status") == "draft",
        "archived": F.col("content_status") == "archived", "highChurn": F.col("version_count") >= 25, "unsynced": F.col("synced").isNull(), **{f"unsyncedStale.{k}": F.col("synced").isNull() & (F.col("severity") == k) for k in ("high", "medium", "low")},
    }
    of_links = {"brokenLinks": F.col("is_broken") & ~external, "externalLinks": external, "brokenExternalLinks": F.col("is_broken") & external}
    risks = audit.contributor_risks(pages, v.contributors(s, d), v.users(s, d))
    counted = audit.counters(at, parts).unionByName(audit.counters(links, of_links))
    return counted.unionByName(audit.audit_summary({"orphans": store.orphans(pages, links), "contributorRisks": risks, "folderIssues": graph.empty_folders(pages)}))


_POINTS = """SELECT o_custkey % 12 AS chart, CASE WHEN o_custkey % 12 < 6 THEN 'categories' ELSE 'points' END AS mode, CASE WHEN o_custkey % 12 = 3 THEN concat('s', o_orderkey % 70) WHEN o_custkey % 12 = 4 AND o_orderpriority = '1-URGENT' THEN ' ' ELSE o_orderpriority END AS series,
  CASE WHEN o_custkey % 12 = 1 AND o_orderkey % 50 = 0 THEN '' ELSE concat('k', o_orderkey % 9) END AS label, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders"""


@query(f"""WITH p AS ({_POINTS}), l AS (SELECT chart, count(DISTINCT label) AS total FROM p GROUP BY 1), s AS (SELECT chart, mode, series, count(*) AS n, count(DISTINCT label) AS labels, count(*) FILTER (WHERE trim(label) = '') AS empty, count(*) FILTER (WHERE value IS NULL) AS inf FROM p GROUP BY 1, 2, 3),
  c AS (SELECT chart, mode, count(*) AS series, count(*) FILTER (WHERE mode = 'categories' AND (n <> total OR labels <> total)) AS uneven, count(*) FILTER (WHERE mode = 'points' AND n > 2000) AS wide, sum(empty) AS empty, sum(inf) AS inf, count(*) FILTER (WHERE trim(series) = '') AS nameless, sum(n) AS n FROM s JOIN l USING (chart) GROUP BY 1, 2),
  x AS (SELECT chart, unnest([{{'code': 'too-many-series', 'n': series - 64}}, {{'code': 'too-many-rows', 'n': wide}}, {{'code': 'too-many-points', 'n': CASE WHEN mode = 'points' THEN n - 20000 ELSE 0 END}}, {{'code': 'uneven-series', 'n': uneven}}, {{'code': 'empty-label', 'n': CASE WHEN mode = 'categories' THEN empty ELSE 0 END}}, {{'code': 'not-finite', 'n': inf}}, {{'code': 'nameless-series', 'n': nameless}}], recursive := true) FROM c)
  SELECT chart, code, CAST(n AS BIGINT) AS n FROM x WHERE n > 0""")
def val01_chart_value_issues(s, d):
    return charts.value_issues(v.table(s, d, "orders").select(*(F.expr(e) for e in (
        "o_custkey % 12 AS chart", "CASE WHEN o_custkey % 12 < 6 THEN 'categories' ELSE 'points' END AS mode", "CASE WHEN o_custkey % 12 = 3 THEN concat('s', o_orderkey % 70) WHEN o_custkey % 12 = 4 AND o_orderpriority = '1-URGENT' THEN ' ' ELSE o_orderpriority END AS series",
        "CASE WHEN o_custkey % 12 = 1 AND o_orderkey % 50 = 0 THEN '' ELSE concat('k', o_orderkey % 9) END AS label", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS value",
    ))))


@query("""WITH t AS (SELECT l_suppkey % 7 AS chart, CASE WHEN l_partkey % 60 = 0 THEN '' ELSE concat('t', l_orderkey, '-', l_linenumber % 6) END AS id, l_partkey % 41 = 0 AS reversed, l_partkey % 53 = 0 AS undated, l_quantity / 49 AS progress FROM lineitem),
  c AS (SELECT chart, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (WHERE id = '') AS nameless, count(*) FILTER (WHERE undated) AS undated, count(*) FILTER (WHERE reversed AND NOT undated) AS reversed, count(*) FILTER (WHERE progress > 1) AS beyond FROM t GROUP BY 1),
  x AS (SELECT chart, unnest([{'code': 'too-many-tasks', 'n': n - 5000}, {'code': 'repeated-id', 'n': n - ids - nameless}, {'code': 'nameless-task', 'n': nameless}, {'code': 'no-date', 'n': undated}, {'code': 'ends-before-start', 'n': reversed}, {'code': 'progress-beyond', 'n': beyond}], recursive := true) FROM c) SELECT chart, code, CAST(n AS BIGINT) AS n FROM x WHERE n > 0""")
def val01_chart_task_issues(s, d):
    tasks = v.table(s, d, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("chart"), F.expr("CASE WHEN l_partkey % 60 = 0 THEN '' ELSE concat('t', l_orderkey, '-', l_linenumber % 6) END").alias("id"), F.lit("task").alias("label"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("start"), F.expr("CASE WHEN l_partkey % 53 = 0 THEN 'soon' WHEN l_partkey % 41 = 0 THEN date_format(l_shipdate - interval 3 days, 'yyyy-MM-dd') ELSE date_format(l_shipdate + interval 3 days, 'yyyy-MM-dd') END").alias("end"),
        (F.col("l_quantity") / 49).alias("progress"),
    )
    return charts.task_issues(tasks)


_URLS = [
    ("https://x.example/wiki/spaces/K#/blog/2024/01/02/5#/t", "content", "blogpost", "K#", "5#"), ("https://x.example/wiki/spaces/K#/pages/7#/a-b?x=1", "content", "page", "K#", "7#"), ("https://x.example/wiki/spaces/K#/overview", "content", "space", "K#", None),
    ("http://dc.example/own/display/K#/Some+Page", "content", "space", "K#", None), ("https://x.example/browse/AB#-12", "work", "issue", "AB#", "AB#-12"), ("https://x.example/jira/software/c/projects/AB#/boards/3", "work", "board", "AB#", "3"),
    ("https://x.example/jira/list?a=1&selectedIssue=AB#-9", "work", "issue", "AB#", "AB#-9"), ("http://dc.example/pages/viewpage.action?pageId=44#", "content", "page", None, "44#"), ("https://x.example/other?pageId=#", None, None, None, None), ("not a url", None, None, None, None),
]


def _url_case(i: int) -> str:
    return f"CASE page_id % {len(_URLS)} " + " ".join(f"WHEN {k} THEN replace('{u[i]}', '#', CAST(page_id % 8 AS VARCHAR))" for k, u in enumerate(_URLS) if u[i] is not None) + " END"


@query(f"SELECT page_id, {_url_case(1)} AS product, {_url_case(2)} AS type, {_url_case(3)} AS space_key, {_url_case(4)} AS id FROM pages")
def str26_url_entities(s, d):
    url = F.replace(F.element_at(F.array(*(F.lit(u[0]) for u in _URLS)), (F.col("page_id") % len(_URLS)).cast("int") + 1), F.lit("#"), (F.col("page_id") % 8).cast("string"))
    return v.table(s, d, "pages").select("page_id", urls.entity(url).alias("e")).select("page_id", "e.product", "e.type", "e.space_key", "e.id")


@query("""WITH RECURSIVE u AS (SELECT l_orderkey AS plan, l_linenumber AS unit, l_quantity AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS turn FROM lineitem),
  a AS (SELECT plan, 0 AS turn, [0.0::DOUBLE, 0.0, 0.0] AS load, CAST(NULL AS BIGINT) AS unit, CAST(NULL AS INTEGER) AS bin FROM u WHERE turn = 1
    UNION ALL SELECT u.plan, u.turn, [a.load[i] + CASE WHEN i = list_position(a.load, list_min(a.load)) THEN u.weight ELSE 0 END FOR i IN range(1, 4)], u.unit, CAST(list_position(a.load, list_min(a.load)) - 1 AS INTEGER) FROM a JOIN u ON u.plan = a.plan AND u.turn = a.turn + 1)
  SELECT plan, unit, bin FROM a WHERE turn > 0""")
def srt13_bins(s, d):
    """The bin of each unit: heaviest first, each to the lightest bin, the first of equals."""
    units = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("long").alias("unit"), F.col("l_quantity").alias("weight"))
    return states.least_loaded(units, 3)
