"""Queries of the page store: scans, filters, joins, writes, sets and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import store
from tessera.plans import views as v
from tessera.plans.register import query

PF = store.PageFilter


@query("SELECT page_id, title, path FROM v_pages WHERE page_id = 42 OR path = 'en/src1/page-1'")
def src04_page_lookup(s, d):
    return v.pages(s, d).filter((F.col("page_id") == 42) | (F.col("path") == "en/src1/page-1")).select("page_id", "title", "path")


@query("""SELECT page_id, title, version_count FROM v_pages WHERE NOT inaccessible AND space_key = 'en' AND sync_state IN ('synced', 'conflict')
  AND content_status = 'current' AND content_type = 'page' AND last_modified > TIMESTAMP '2000-01-01' AND created_at < TIMESTAMP '2000-06-01'
  AND version_count >= 3 AND word_count >= 5 AND word_count <= 5000 AND NOT is_restricted""")
def src05_filtered_pages(s, d):
    f = PF(space_key="en", sync_state=("synced", "conflict"), content_status="current", content_type="page", modified_since="2000-01-01", created_before="2000-06-01", min_version_count=3, min_word_count=5, max_word_count=5000, is_restricted=False)
    return store.list_pages(v.pages(s, d), f).select("page_id", "title", "version_count")


@query("""SELECT 'out' AS direction, source_page_id AS page_id, count(*) AS n FROM v_links WHERE source_page_id = 12 GROUP BY 2
  UNION ALL SELECT 'in', target_page_id, count(*) FROM v_links WHERE target_page_id = 12 GROUP BY 2
  UNION ALL SELECT 'label', page_id, count(*) FROM v_labels WHERE page_id = 12 GROUP BY 2""")
def src06_child_rows(s, d):
    links, labels = v.links(s, d), v.labels(s, d)
    n = F.count(F.lit(1)).alias("n")
    out = links.filter("source_page_id = 12").groupBy(F.col("source_page_id").alias("page_id")).agg(n).withColumn("direction", F.lit("out"))
    into = links.filter("target_page_id = 12").groupBy(F.col("target_page_id").alias("page_id")).agg(n).withColumn("direction", F.lit("in"))
    has = labels.filter("page_id = 12").groupBy("page_id").agg(n).withColumn("direction", F.lit("label"))
    return out.unionByName(into).unionByName(has)


@query("SELECT issue_key, created FROM v_issues ORDER BY created DESC, issue_id LIMIT 250")
def src08_first_issues(s, d):
    return v.issues(s, d).orderBy(F.desc("created"), "issue_id").limit(250).select("issue_key", "created")


@query("""SELECT page_id, 'tree' AS scope FROM v_pages WHERE page_id = 4 OR list_contains(ancestors, 4)
  UNION ALL SELECT page_id, 'page' FROM v_pages WHERE page_id = 4 UNION ALL SELECT page_id, 'space' FROM v_pages WHERE space_key = 'fr'""")
def src10_scopes(s, d):
    pages = v.pages(s, d)
    parts = {"tree": {"ancestor_id": 4}, "page": {"page_id": 4, "ancestor_id": 1}, "space": {"space_key": "fr"}}
    out = [store.scope(pages, **k).select("page_id", F.lit(name).alias("scope")) for name, k in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT page_id, last_modified FROM v_pages WHERE last_modified >= DATE '2001-03-01'")
def src11_pages_since(s, d):
    return v.pages(s, d).filter(F.col("last_modified") >= F.to_date(F.lit("2001-03-01T15:00:00"))).select("page_id", "last_modified")


@query("""WITH n AS (SELECT page_id, title, version + 1 AS version, created_at + INTERVAL 1000 DAY AS created_at FROM v_pages WHERE page_id % 50 = 0
    UNION ALL SELECT page_id + 10000000, title, version, created_at FROM v_pages WHERE page_id % 100 = 1)
  SELECT p.page_id, p.title, p.version, p.created_at FROM v_pages p WHERE p.page_id NOT IN (SELECT page_id FROM n)
  UNION ALL SELECT n.page_id, n.title, n.version, coalesce(p.created_at, n.created_at) FROM n LEFT JOIN v_pages p ON p.page_id = n.page_id""")
def snk01_upsert_pages(s, d):
    pages = v.pages(s, d).select("page_id", "title", "version", "created_at")
    changed = pages.filter("page_id % 50 = 0").withColumn("version", F.col("version") + 1).withColumn("created_at", F.expr("created_at + interval 1000 days"))
    added = pages.filter("page_id % 100 = 1").withColumn("page_id", F.col("page_id") + 10_000_000)
    return store.upsert(pages, changed.unionByName(added), ["page_id"], keep=["created_at"])


@query("""SELECT page_id, label FROM v_labels WHERE page_id % 20 <> 0 UNION ALL SELECT DISTINCT page_id, 'renewed' FROM v_labels WHERE page_id % 40 = 0""")
def snk02_replace_labels(s, d):
    labels = v.labels(s, d)
    parents = labels.filter("page_id % 20 = 0").select("page_id")
    new = labels.filter("page_id % 40 = 0").select("page_id", F.lit("renewed").alias("label")).distinct()
    return store.replace_children(labels, parents, new, "page_id")


@query("""SELECT 'pages' AS tbl, count(*) AS n FROM v_pages WHERE page_id % 3 <> 0 UNION ALL SELECT 'labels', count(*) FROM v_labels WHERE page_id % 3 <> 0
  UNION ALL SELECT 'links', count(*) FROM v_links WHERE source_page_id % 3 <> 0""")
def snk03_delete_cascade(s, d):
    pages = v.pages(s, d)
    left = store.delete_pages({"pages": (pages, "page_id"), "labels": (v.labels(s, d), "page_id"), "links": (v.links(s, d), "source_page_id")}, pages.filter("page_id % 3 = 0"))
    parts = [t.agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(k)) for k, t in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT page_id, (page_id % 10 = 1 OR inaccessible) AS inaccessible, CASE WHEN page_id % 10 = 1 THEN TIMESTAMP '2001-08-02' END AS inaccessible_at,
  CASE WHEN page_id % 10 = 1 THEN 'not-found' END AS inaccessible_reason FROM v_pages""")
def snk04_mark_inaccessible(s, d):
    pages = v.pages(s, d)
    return store.mark_inaccessible(pages, pages.filter("page_id % 10 = 1"), v.AS_OF, "not-found").select("page_id", "inaccessible", "inaccessible_at", "inaccessible_reason")


@query("SELECT 'page' AS kind, page_id AS a, NULL AS b FROM v_pages UNION ALL SELECT 'link', source_page_id, target_page_id FROM v_links WHERE target_page_id IS NOT NULL")
def snk12_link_graph(s, d):
    nodes = v.pages(s, d).select(F.lit("page").alias("kind"), F.col("page_id").alias("a"), F.lit(None).cast("long").alias("b"))
    return nodes.unionByName(v.links(s, d).filter("target_page_id is not null").select(F.lit("link").alias("kind"), F.col("source_page_id").alias("a"), F.col("target_page_id").alias("b")))


@query("SELECT page_id FROM v_pages WHERE NOT inaccessible AND parent_id IS NULL")
def prd01_root_pages(s, d):
    return store.list_pages(v.pages(s, d), PF(parent_id=None)).select("page_id")


@query("SELECT page_id, sync_state FROM v_pages WHERE NOT inaccessible AND sync_state IN ('conflict', 'untracked') AND content_type = 'page'")
def prd02_enum_lists(s, d):
    return store.list_pages(v.pages(s, d), PF(sync_state=["conflict", "untracked"], content_type="page")).select("page_id", "sync_state")


@query("SELECT page_id FROM v_pages WHERE NOT inaccessible AND last_modified < TIMESTAMP '2000-07-01' AND last_modified > TIMESTAMP '2000-01-01'")
def prd03_time_range(s, d):
    return store.list_pages(v.pages(s, d), PF(modified_before="2000-07-01", modified_since="2000-01-01")).select("page_id")


@query("SELECT page_id, path FROM v_pages WHERE NOT inaccessible AND starts_with(path, 'en/src1')")
def prd04_path_prefix(s, d):
    return store.list_pages(v.pages(s, d), PF(path_prefix="en/src1")).select("page_id", "path")


@query("SELECT page_id, word_count FROM v_pages WHERE NOT inaccessible AND version_count >= 20 AND word_count <= 200")
def prd05_bounds(s, d):
    return store.list_pages(v.pages(s, d), PF(min_version_count=20, min_word_count=0, max_word_count=200)).select("page_id", "word_count")


@query("""SELECT page_id FROM v_pages WHERE page_id IN (SELECT page_id FROM v_labels WHERE label = 'lang-en') AND (list_contains(ancestors, 1) OR parent_id = 1)
  AND page_id NOT IN (SELECT page_id FROM v_labels WHERE label = 'src0')""")
def prd07_audit_scope(s, d):
    return store.audit_scope(v.pages(s, d), v.labels(s, d), include_label="lang-en", exclude_label="src0", under=1)


@query("SELECT r.user_id, u.last_checked_at FROM (SELECT DISTINCT user_id FROM v_contributors) r LEFT JOIN v_users u USING (user_id) WHERE u.last_checked_at IS NULL OR u.last_checked_at < TIMESTAMP '2001-08-02' - INTERVAL 7 DAY")
def prd16_users_to_check(s, d):
    return store.users_to_check(v.contributors(s, d), v.users(s, d), v.AS_OF)


@query("SELECT p.page_id, p.title, l.label FROM v_pages p JOIN v_labels l USING (page_id) WHERE l.label = 'lang-de' AND NOT p.inaccessible")
def jn01_pages_with_label_rows(s, d):
    return v.pages(s, d).filter("not inaccessible").join(v.labels(s, d).filter("label = 'lang-de'"), "page_id").select("page_id", "title", "label")


@query("SELECT page_id, title FROM v_pages WHERE NOT inaccessible AND page_id IN (SELECT page_id FROM v_labels WHERE label = 'Draft')")
def jn02_pages_with_label(s, d):
    return store.list_pages(v.pages(s, d), PF(label="Draft"), v.labels(s, d)).select("page_id", "title")


@query("""SELECT page_id, title FROM v_pages p WHERE parent_id IS NULL AND NOT inaccessible AND NOT EXISTS
  (SELECT 1 FROM v_links l WHERE l.link_type = 'internal' AND l.target_page_id = p.page_id)""")
def jn03_orphan_pages(s, d):
    return store.orphans(v.pages(s, d), v.links(s, d)).select("page_id", "title")


@query("SELECT l.source_page_id, l.target_path, l.line_number, p.title AS source_title, p.space_key FROM v_links l LEFT JOIN v_pages p ON p.page_id = l.source_page_id WHERE l.is_broken")
def jn04_broken_links(s, d):
    return store.broken_links(v.links(s, d), v.pages(s, d)).select("source_page_id", "target_path", "line_number", "source_title", "space_key")


@query("SELECT page_id, title FROM v_pages r WHERE page_id NOT IN (SELECT page_id FROM v_pages WHERE page_id % 4 <> 0)")
def jn05_unsynced_pages(s, d):
    remote = v.pages(s, d)
    return remote.join(remote.filter("page_id % 4 <> 0").select("page_id"), "page_id", "left_anti").select("page_id", "title")


@query("""SELECT p.page_id, coalesce(l.labels, []) AS labels FROM v_pages p LEFT JOIN (SELECT page_id, list_sort(list(DISTINCT label)) AS labels FROM v_labels GROUP BY 1) l USING (page_id)
  WHERE NOT p.inaccessible AND NOT list_contains(coalesce(l.labels, []), 'lang-en')""")
def jn06_missing_label(s, d):
    return store.missing_label(store.list_pages(v.pages(s, d)), v.labels(s, d), "lang-en").select("page_id", "labels")


@query("SELECT user_id, count(DISTINCT page_id) AS page_count, CAST(sum(contribution_count) AS BIGINT) AS total_contributions FROM v_contributors GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def agg01_top_contributors(s, d):
    return store.top_contributors(v.contributors(s, d))


@query("SELECT count(*) AS n FROM v_pages WHERE NOT inaccessible AND space_key = 'en' AND content_status IN ('draft', 'archived')")
def agg02_count_pages(s, d):
    return store.list_pages(v.pages(s, d), PF(space_key="en", content_status=["draft", "archived"])).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(last_checked_at) AS oldest FROM v_users")
def agg03_oldest_check(s, d):
    return v.users(s, d).agg(F.min("last_checked_at").alias("oldest"))


@query("SELECT DISTINCT label FROM v_labels ORDER BY label")
def agg04_all_labels(s, d):
    return v.labels(s, d).select("label").distinct().orderBy("label")


@query("""SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive, count(*) FILTER (is_active IS NULL) AS unknown,
  count(*) FILTER (last_checked_at IS NULL OR last_checked_at < TIMESTAMP '2001-08-02' - INTERVAL 7 DAY) AS stale FROM v_users""")
def agg16_user_stats(s, d):
    return store.user_stats(v.users(s, d), v.AS_OF)


@query("""SELECT page_id, user_id, count(*) AS contribution_count, max(happened) AS last_contributed_at FROM
  (SELECT user_id % 200 AS page_id, concat('u', event_id % 50) AS user_id, ts AS happened FROM events) GROUP BY 1, 2""")
def agg17_contributor_history(s, d):
    versions = v.table(s, d, "events").select((F.col("user_id") % 200).alias("page_id"), F.expr("concat('u', event_id % 50)").alias("user_id"), F.col("ts").alias("at"))
    return versions.groupBy("page_id", "user_id").agg(F.count(F.lit(1)).alias("contribution_count"), F.max("at").alias("last_contributed_at"))


@query("""SELECT page_id, created_by AS user_id, CASE WHEN created_by = last_modified_by THEN 2 ELSE 1 END AS contribution_count,
  CASE WHEN created_by = last_modified_by THEN coalesce(last_modified, created_at) ELSE created_at END AS last_contributed_at FROM v_pages
  UNION ALL SELECT page_id, last_modified_by, 1, coalesce(last_modified, created_at) FROM v_pages WHERE last_modified_by IS NOT NULL AND last_modified_by <> created_by""")
def agg18_page_contributors(s, d):
    return store.contributors_from_pages(v.pages(s, d))


@query("SELECT created_by AS user_id FROM v_pages UNION SELECT last_modified_by FROM v_pages WHERE last_modified_by IS NOT NULL UNION SELECT user_id FROM v_contributors")
def agg34_referenced_users(s, d):
    return store.referenced_users(v.pages(s, d), v.contributors(s, d))


@query("SELECT page_id, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY label) AS n FROM v_labels) WHERE n = 1")
def win08_first_label(s, d):
    return store.first_per_key(v.labels(s, d), ["page_id"], ["label"])


@query("SELECT source_page_id, line_number, target_path FROM v_links WHERE link_type = 'external'")
def srt04_external_links(s, d):
    return store.external_links(v.links(s, d)).select("source_page_id", "line_number", "target_path")


@query("SELECT page_id, parent_id, title, row_number() OVER (PARTITION BY parent_id ORDER BY CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 10 END NULLS LAST, title, page_id) AS place FROM v_pages")
def srt06_child_order(s, d):
    from pyspark.sql import Window

    position = F.expr("CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 10 END")
    return v.pages(s, d).select("page_id", "parent_id", "title", F.row_number().over(Window.partitionBy("parent_id").orderBy(position.asc_nulls_last(), "title", "page_id")).alias("place"))


@query("SELECT page_id FROM v_pages ORDER BY page_id LIMIT 20 OFFSET 30")
def srt07_page_slice(s, d):
    return store.page_slice(v.pages(s, d).select("page_id"), offset=30, limit=20)


@query("""SELECT label FROM v_labels WHERE page_id % 2 = 0 INTERSECT SELECT label FROM v_labels WHERE page_id % 3 = 0""")
def set03_common_labels(s, d):
    labels = v.labels(s, d)
    return labels.filter("page_id % 2 = 0").select("label").intersect(labels.filter("page_id % 3 = 0").select("label"))


@query("SELECT target_page_id FROM v_links WHERE is_broken AND target_page_id IS NOT NULL EXCEPT SELECT page_id FROM v_pages WHERE page_id % 2 = 0")
def set02_difference(s, d):
    return v.links(s, d).filter("is_broken and target_page_id is not null").select("target_page_id").exceptAll(
        v.links(s, d).limit(0).select("target_page_id")
    ).distinct().join(v.pages(s, d).filter("page_id % 2 = 0").select(F.col("page_id").alias("target_page_id")), "target_page_id", "left_anti")


@query("SELECT event_id, type FROM v_logs WHERE starts_with(type, 'cli.') UNION ALL SELECT event_id, type FROM v_logs WHERE starts_with(type, 'api.') AND level = 'error'")
def set01_log_union(s, d):
    logs = v.logs(s, d)
    return logs.filter(F.col("type").startswith("cli.")).select("event_id", "type").unionByName(logs.filter(F.col("type").startswith("api.") & (F.col("level") == "error")).select("event_id", "type"))


@query("SELECT DISTINCT user_id FROM v_contributors")
def set06_distinct_users(s, d):
    return v.contributors(s, d).select("user_id").dropDuplicates()


@query("SELECT page_id, word_count IS NULL AS no_words, coalesce(last_modified_by, 'unknown') AS last_modified_by, coalesce(last_modified, created_at) AS last_modified FROM v_pages")
def prj09_record_defaults(s, d):
    return v.pages(s, d).select("page_id", F.col("word_count").isNull().alias("no_words"), F.coalesce("last_modified_by", F.lit("unknown")).alias("last_modified_by"), F.coalesce("last_modified", "created_at").alias("last_modified"))
