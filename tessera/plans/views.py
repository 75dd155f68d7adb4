"""Domain tables as views over the fixture tables, and the same views as SQL for the oracle.

Every view is a deterministic projection of one fixture table; none depends on a clock.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference time of views derived from orders, and of those derived from events.
AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Expressions that Spark and the oracle both read. Days are added to fixed dates.
_PAGE = {
    "page_id": "doc_id",
    "title": "concat('Page ', doc_id)",
    "space_key": "lang",
    "path": "concat(lang, '/', source, '/page-', doc_id)",
    "version": "1 + doc_id % 9",
    "version_count": "1 + (doc_id * 7) % 31",
    "parent_id": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 3 END",
    "content_type": "CASE WHEN doc_id % 11 = 0 THEN 'folder' ELSE 'page' END",
    "content_status": "CASE doc_id % 10 WHEN 7 THEN 'draft' WHEN 8 THEN 'archived' ELSE 'current' END",
    "sync_state": "CASE doc_id % 6 WHEN 1 THEN 'local-modified' WHEN 2 THEN 'remote-modified' WHEN 3 THEN 'conflict' WHEN 4 THEN 'untracked' ELSE 'synced' END",
    "is_restricted": "doc_id % 13 = 0",
    "has_attachments": "doc_id % 4 = 0",
    "created_by": "concat('u', doc_id % 23)",
    "last_modified_by": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE concat('u', doc_id % 19) END",
    "base_hash": "concat('h', doc_id % 97)",
    "local_hash": "CASE WHEN doc_id % 5 = 0 THEN concat('x', doc_id % 89) ELSE concat('h', doc_id % 97) END",
    "remote_hash": "CASE WHEN doc_id % 15 = 0 THEN concat('x', doc_id % 89) WHEN doc_id % 6 = 0 THEN concat('y', doc_id % 89) ELSE concat('h', doc_id % 97) END",
    "inaccessible": "doc_id % 29 = 0",
}
_PAGE_DAYS = {"created_at": ("1998-01-01", "(doc_id * 37) % 900", None), "last_modified": ("1999-03-31", "(doc_id * 13) % 850", "doc_id % 17 = 0")}


def _spark(expression: str) -> str:
    return re.sub(r"(\w+) // (\w+)", r"(\1 div \2)", expression)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    days = []
    for name, (start, offset, null_if) in _PAGE_DAYS.items():
        value = f"cast('{start} 00:00:00' as timestamp) + make_dt_interval(cast({offset} as int))"
        days.append(F.expr(f"CASE WHEN {null_if} THEN NULL ELSE {value} END" if null_if else value).alias(name))
    return docs.select(
        *(F.expr(_spark(e)).alias(n) for n, e in _PAGE.items()), *days, F.size(F.split("text", " ")).alias("word_count"),
        F.expr(
            "filter(array(" + ", ".join(f"CASE WHEN {_chain(k)} THEN doc_id div {3 ** (k + 1)} END" for k in range(3)) + "), x -> x is not null)"
        ).alias("ancestors"),
    )


def _chain(k: int) -> str:
    """Whether the page has an ancestor k + 1 steps up."""
    return " AND ".join(["doc_id % 7 <> 0", *(f"(doc_id div {3 ** j}) % 7 <> 0" for j in range(1, k + 1))])


def _pages_sql() -> str:
    days = []
    for name, (start, offset, null_if) in _PAGE_DAYS.items():
        value = f"TIMESTAMP '{start} 00:00:00' + to_days(CAST({offset} AS INTEGER))"
        days.append((f"CASE WHEN {null_if} THEN NULL ELSE {value} END" if null_if else value) + f" AS {name}")
    chain = ", ".join(f"CASE WHEN {_chain(k).replace(' div ', ' // ')} THEN doc_id // {3 ** (k + 1)} END" for k in range(3))
    return (
        "SELECT " + ", ".join([*(f"{e} AS {n}" for n, e in _PAGE.items()), *days, "len(string_split(text, ' ')) AS word_count", f"list_filter([{chain}], lambda x: x IS NOT NULL) AS ancestors"])
        + " FROM documents"
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("page_id"),
        F.explode(F.expr("filter(array(source, CASE WHEN doc_id % 2 = 0 THEN concat('lang-', lang) END, CASE WHEN doc_id % 10 = 3 THEN 'Draft' END), x -> x is not null)")).alias("label"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three links a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    kind = F.expr("element_at(array('internal','external','attachment','internal'), cast((doc_id + i) % 4 as int) + 1)")
    return docs.select(
        F.col("doc_id").alias("source_page_id"), kind.alias("link_type"),
        F.expr("CASE WHEN (doc_id + i) % 4 = 1 OR (doc_id + i) % 9 = 0 THEN NULL ELSE (doc_id div 2) + i END").alias("target_page_id"),
        F.expr("CASE WHEN (doc_id + i) % 4 = 1 THEN CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN 'not a url' ELSE concat('https://host', doc_id % 6, '.example.com/p', i) END ELSE concat('../page-', doc_id div 2, '.md') END").alias("target_path"),
        F.expr("CASE WHEN doc_id % 15 = 0 THEN NULL ELSE i * 10 + doc_id % 7 END").alias("line_number"),
        F.expr("(doc_id + i) % 6 = 0").alias("is_broken"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.expr("concat('u', s_suppkey)").alias("user_id"), F.col("s_name").alias("display_name"),
        F.expr("CASE WHEN s_acctbal < 0 THEN false WHEN s_acctbal < 2000 THEN NULL ELSE true END").alias("is_active"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE timestamp '2001-07-10 00:00:00' + make_dt_interval(cast(s_suppkey % 30 as int)) END").alias("last_checked_at"),
    )


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("page_id"), F.concat(F.lit("u"), F.col("l_suppkey")).alias("user_id"))
        .agg(F.count(F.lit(1)).alias("contribution_count"), F.max("l_shipdate").alias("last_contributed_at"))
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("issue_id"), F.expr("concat('T-', o_orderkey)").alias("issue_key"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'new' ELSE 'indeterminate' END").alias("status_category"),
        F.col("o_orderpriority").alias("priority"), F.expr("concat('c', o_custkey)").alias("assignee"), F.col("o_custkey").alias("epic_id"),
        F.col("o_orderdate").alias("created"),
        F.expr("CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN concat(o_orderkey % 7, ' pts') WHEN 2 THEN 'n/a' WHEN 3 THEN concat(o_orderkey % 5, '.5') ELSE cast(o_orderkey % 13 as string) END").alias("points_raw"),
        F.expr("year(o_orderdate) * 12 + month(o_orderdate)").cast("long").alias("sprint_id"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + make_dt_interval(cast(o_orderkey % 40 as int)) END").alias("resolved"),
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change item an event: array order ``pos`` is the event id."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 200).alias("issue_id"), F.col("event_id").alias("pos"), F.col("ts").alias("created"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'status' WHEN 'signup' THEN 'Sprint' WHEN 'click' THEN 'assignee' ELSE 'other' END").alias("field"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN 'Sprint name only' ELSE concat('com.Sprint@1[id=', event_id % 12, ',state=ACTIVE]') END").alias("from_text"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('com.Sprint@1[id=', event_id % 8, '],com.Sprint@2[id=', event_id % 5, ']') END").alias("to_text"),
    )


def worklogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("issue_id"), F.expr("concat('u', l_suppkey)").alias("author_id"),
        F.expr("CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE concat('Author ', l_suppkey) END").alias("author_name"),
        F.expr("cast(l_quantity * 600 as bigint)").alias("seconds"),
        F.expr("concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T', lpad(cast(l_linenumber % 24 as string), 2, '0'), ':30:00.000+0200')").alias("started"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END").alias("level"),
        F.expr("concat(CASE WHEN event_id % 3 = 0 THEN 'cli.' ELSE 'api.' END, event_type)").alias("type"), F.col("props").alias("data"), "user_id", "value",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export jobs; days are counted from the order's date."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 40).alias("group_key"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("enqueued_at"),
        F.expr("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'interactive' ELSE 'retry' END").alias("priority"),
        F.expr("CASE o_orderkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'waiting' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'succeeded' END").alias("state"),
        F.expr("CASE WHEN o_orderkey % 8 >= 3 THEN o_orderdate + make_dt_interval(cast(o_orderkey % 5 as int)) END").alias("finished_at"),
        F.expr("CASE WHEN o_orderkey % 8 > 4 AND o_orderkey % 3 = 0 THEN o_orderdate + make_dt_interval(cast(o_orderkey % 9 as int)) END").alias("delivered_at"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + make_dt_interval(12) END").alias("dismissed_at"),
        F.expr("CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + make_dt_interval(6) END").alias("acknowledged_at"),
        F.expr("(o_orderkey * 7919) % 5000").alias("bytes"),
    )


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "v_pages": pages, "v_labels": labels, "v_links": links, "v_users": users, "v_contributors": contributors, "v_issues": issues,
    "v_changelog": changelog, "v_worklogs": worklogs, "v_logs": logs, "v_jobs": jobs,
}

SQL: dict[str, str] = {
    "v_pages": _pages_sql(),
    "v_labels": "SELECT doc_id AS page_id, unnest(list_filter([source, CASE WHEN doc_id % 2 = 0 THEN concat('lang-', lang) END, CASE WHEN doc_id % 10 = 3 THEN 'Draft' END], lambda x: x IS NOT NULL)) AS label FROM documents",
    "v_links": """SELECT doc_id AS source_page_id, (['internal','external','attachment','internal'])[(doc_id + i) % 4 + 1] AS link_type,
      CASE WHEN (doc_id + i) % 4 = 1 OR (doc_id + i) % 9 = 0 THEN NULL ELSE doc_id // 2 + i END AS target_page_id,
      CASE WHEN (doc_id + i) % 4 = 1 THEN CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN 'not a url' ELSE concat('https://host', doc_id % 6, '.example.com/p', i) END ELSE concat('../page-', doc_id // 2, '.md') END AS target_path,
      CASE WHEN doc_id % 15 = 0 THEN NULL ELSE i * 10 + doc_id % 7 END AS line_number, (doc_id + i) % 6 = 0 AS is_broken
      FROM documents, (SELECT unnest([0, 1, 2]) AS i)""",
    "v_users": "SELECT concat('u', s_suppkey) AS user_id, s_name AS display_name, CASE WHEN s_acctbal < 0 THEN false WHEN s_acctbal < 2000 THEN NULL ELSE true END AS is_active, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2001-07-10 00:00:00' + to_days(CAST(s_suppkey % 30 AS INTEGER)) END AS last_checked_at FROM supplier",
    "v_contributors": "SELECT l_partkey % 500 AS page_id, concat('u', l_suppkey) AS user_id, count(*) AS contribution_count, max(l_shipdate) AS last_contributed_at FROM lineitem GROUP BY 1, 2",
    "v_issues": """SELECT o_orderkey AS issue_id, concat('T-', o_orderkey) AS issue_key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'new' ELSE 'indeterminate' END AS status_category,
      o_orderpriority AS priority, concat('c', o_custkey) AS assignee, o_custkey AS epic_id, o_orderdate AS created,
      CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN concat(o_orderkey % 7, ' pts') WHEN 2 THEN 'n/a' WHEN 3 THEN concat(o_orderkey % 5, '.5') ELSE CAST(o_orderkey % 13 AS VARCHAR) END AS points_raw,
      CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS sprint_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS resolved FROM orders""",
    "v_points": "SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(points_raw, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE), 0.0) AS points FROM v_issues",
    "v_changelog": """SELECT user_id % 200 AS issue_id, event_id AS pos, ts AS created, CASE event_type WHEN 'purchase' THEN 'status' WHEN 'signup' THEN 'Sprint' WHEN 'click' THEN 'assignee' ELSE 'other' END AS field,
      CASE WHEN event_id % 5 = 0 THEN 'Sprint name only' ELSE concat('com.Sprint@1[id=', event_id % 12, ',state=ACTIVE]') END AS from_text,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('com.Sprint@1[id=', event_id % 8, '],com.Sprint@2[id=', event_id % 5, ']') END AS to_text FROM events""",
    "v_worklogs": "SELECT l_orderkey AS issue_id, concat('u', l_suppkey) AS author_id, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE concat('Author ', l_suppkey) END AS author_name, CAST(l_quantity * 600 AS BIGINT) AS seconds, concat(strftime(l_shipdate, '%Y-%m-%d'), 'T', lpad(CAST(l_linenumber % 24 AS VARCHAR), 2, '0'), ':30:00.000+0200') AS started FROM lineitem",
    "v_logs": "SELECT event_id, ts AS timestamp, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END AS level, concat(CASE WHEN event_id % 3 = 0 THEN 'cli.' ELSE 'api.' END, event_type) AS type, props AS data, user_id, value FROM events",
    "v_jobs": """SELECT o_orderkey AS job_id, o_custkey % 40 AS group_key, o_orderdate AS created_at, o_orderdate AS enqueued_at, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'interactive' ELSE 'retry' END AS priority,
      CASE o_orderkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'waiting' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'succeeded' END AS state,
      CASE WHEN o_orderkey % 8 >= 3 THEN o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) END AS finished_at,
      CASE WHEN o_orderkey % 8 > 4 AND o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER)) END AS delivered_at,
      CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 12 DAY END AS dismissed_at, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL 6 DAY END AS acknowledged_at,
      (o_orderkey * 7919) % 5000 AS bytes FROM orders""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it names, and those that they name, as leading common tables."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(SQL[name])
                needed.append(name)

    add(sql)
    sql = sql.strip()
    if not needed:
        return sql
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I):
        return f"WITH {m[1] or ''}{heads}, {sql[m.end():]}"
    return f"WITH {heads} {sql}"
