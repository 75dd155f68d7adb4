"""Queries of page macros, reports over threads and issues, and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import documents as doc
from tessera.functions import macros, texts
from tessera.operators import reports
from tessera.plans import views as v
from tessera.plans.register import query


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'thumbs-up' WHEN 1 THEN 'warning' WHEN 2 THEN 'light-off' WHEN 3 THEN NULL ELSE 'heart' END AS name,
  CASE page_id % 5 WHEN 0 THEN '👍' WHEN 1 THEN concat('see ', title) WHEN 2 THEN '○' WHEN 3 THEN concat(': p', page_id, ':') ELSE '♥' END AS shown FROM v_pages""")
def str19_emoji(s, d):
    short = F.expr("CASE page_id % 5 WHEN 0 THEN ':+1:' WHEN 1 THEN 'WARN' WHEN 2 THEN ':light_bulb_off:' WHEN 3 THEN concat(': p', page_id, ':') ELSE ':Love:' END")
    source = F.expr("CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('see ', title) WHEN 2 THEN ':x:' END")
    return v.pages(s, d).select("page_id", macros.emoji_name(short, typed=True).alias("name"), macros.emoji_text(short, source).alias("shown"))


@query("""WITH g AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total FROM g)
  SELECT o_custkey, o_orderpriority, concat(o_orderpriority, ': ', n, ' (', CAST(floor(n * 100.0 / total + 0.5) AS BIGINT), '%)') AS shown, o_orderpriority AS plain FROM t""")
def str24_pie_labels(s, d):
    rows = v.table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(rows.groupBy("o_custkey").agg(F.sum("n").alias("total")), "o_custkey")
    label = lambda pattern: macros.pie_label(pattern, F.col("o_orderpriority"), F.col("n"), F.col("total"))
    return rows.select("o_custkey", "o_orderpriority", label(F.lit("%0%: %1% (%2%)")).alias("shown"), label(F.lit(None).cast("string")).alias("plain"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '$scroll.title' WHEN 1 THEN '$scroll.creationdate' WHEN 4 THEN concat('$scroll.custom.f', page_id) WHEN 5 THEN concat('$scroll.x', page_id) ELSE '$scroll.pageproperty' END AS base,
  CASE page_id % 6 WHEN 4 THEN 'never' WHEN 5 THEN 'unsupported' ELSE 'supported' END AS status, CASE WHEN page_id % 6 = 3 THEN 'spaceHomepage' ELSE 'none' END AS dependency,
  CASE page_id % 6 WHEN 2 THEN concat('key ', page_id) WHEN 3 THEN 'k' WHEN 1 THEN 'yyyy' ELSE '' END AS key FROM v_pages""")
def str30_placeholders(s, d):
    raw = F.expr("""CASE page_id % 6 WHEN 0 THEN '$scroll.title' WHEN 1 THEN '$scroll.creationdate.("yyyy")' WHEN 2 THEN concat('$scroll.pageproperty.( "key ', page_id, '" )') WHEN 3 THEN '$scroll.pageproperty.(k,true)'
      WHEN 4 THEN concat('$scroll.custom.f', page_id) ELSE concat('$scroll.x', page_id) END""")
    return v.pages(s, d).select("page_id", macros.placeholder(raw).alias("p"), macros.property_arguments(raw)["key"].alias("key")).select("page_id", "p.*", "key")


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('https://team.example/wiki/spaces/~', space_key, '/whiteboard/', page_id + 1) WHEN 7 THEN concat('https://team.example/wiki/spaces/', space_key, '/whiteboard/', page_id) END AS url,
  CASE page_id % 8 WHEN 1 THEN 'cross-site' WHEN 2 THEN 'fragment' WHEN 3 THEN 'credentials' WHEN 4 THEN 'malformed-url' WHEN 5 THEN 'invalid-whiteboard-id' WHEN 6 THEN 'unsupported-scheme' END AS reason FROM v_pages""")
def prd17_whiteboard_targets(s, d):
    raw = F.expr("""CASE page_id % 8 WHEN 0 THEN concat(' /wiki/spaces/%7E', space_key, '/whiteboard/', page_id + 1, '?a=b ') WHEN 1 THEN 'https://other.example/wiki/spaces/A/whiteboard/1' WHEN 2 THEN '/wiki/spaces/A/whiteboard/1#x'
      WHEN 3 THEN 'https://me@team.example/wiki/spaces/A/whiteboard/1' WHEN 4 THEN '/wiki/../spaces' WHEN 5 THEN concat('/wiki/spaces/A/whiteboard/0', page_id) WHEN 6 THEN 'javascript:x' ELSE concat('HTTPS://Team.example:443/wiki/spaces/', space_key, '/whiteboard/', page_id, '/') END""")
    return v.pages(s, d).select("page_id", macros.whiteboard_target(raw, F.lit("https://team.example/start")).alias("t")).select("page_id", "t.*")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS dotted, concat('Q', quarter(o_orderdate), ' ''', strftime(o_orderdate, '%y')) AS quartered, strftime(o_orderdate, '%Y-%m-%d') AS unknown,
  concat(['1st', '2nd', '3rd', '4th'][quarter(o_orderdate)], ' quarter of ', year(o_orderdate)) AS spoken FROM orders""")
def dat17_simple_dates(s, d):
    by = lambda pattern: macros.simple_date(F.col("o_orderdate"), pattern)
    return v.table(s, d, "orders").select("o_orderkey", by("dd.MM.yyyy").alias("dotted"), by("QQQ ''yy").alias("quartered"), by("EEE dd").alias("unknown"), by("QQQQ 'of' yyyy").alias("spoken"))


@query("SELECT page_id, [concat('seite-', page_id, '-a'), 'anchor'] AS anchors FROM v_pages")
def str05_anchor_ids(s, d):
    names = F.array(F.concat(F.lit("Séite "), "page_id", F.lit(" / A!")), F.lit("???"))
    return v.pages(s, d).select("page_id", doc.column(doc.unique_anchors, "array<string>")(names).alias("anchors"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn >= 3 THEN turn // 3 END AS parent FROM conversations),
  t AS (SELECT conv_id, turn, turn % 2 = 1 AS inl FROM n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM n m WHERE m.conv_id = n.conv_id AND m.turn = n.parent) UNION ALL SELECT n.conv_id, n.turn, t.inl FROM t JOIN n ON n.conv_id = t.conv_id AND n.parent = t.turn)
  SELECT conv_id AS page_id, count(*) FILTER (NOT inl) AS footer, count(*) FILTER (inl) AS inline, count(*) AS total FROM t GROUP BY 1""")
def agg25_comment_counts(s, d):
    turns = v.table(s, d, "conversations").select("conv_id", "turn").distinct()
    comments = turns.select(
        F.expr("concat(conv_id, '-', turn)").alias("id"), F.col("conv_id").alias("page_id"), F.expr("CASE WHEN turn % 2 = 1 THEN 'inline' ELSE 'footer' END").alias("kind"),
        F.expr("CASE WHEN turn >= 3 THEN concat(conv_id, '-', turn div 3) END").alias("parent_id"),
    )
    return reports.comment_counts(comments)


_ISSUES = "SELECT user_id AS report, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity, concat(event_type, '-', event_id % 7) AS code FROM events"


@query(f"""WITH i AS ({_ISSUES}), c AS (SELECT report, code, count(*) AS n, row_number() OVER (PARTITION BY report ORDER BY count(*) DESC, code) AS place FROM i GROUP BY 1, 2)
  SELECT report, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error,
    CASE WHEN report % 5 = 0 THEN 7 WHEN report % 2 = 0 AND count(*) FILTER (severity <> 'info') > 0 THEN 2 ELSE 0 END AS exit_code,
    (SELECT list(concat(code, ':', n) ORDER BY place) FROM c WHERE c.report = i.report AND place <= 3) AS top_codes FROM i GROUP BY report""")
def agg24_export_reports(s, d):
    issues = v.table(s, d, "events").select(
        F.col("user_id").alias("report"), F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END").alias("severity"), F.expr("concat(event_type, '-', event_id % 7)").alias("code")
    )
    found = reports.export_reports(issues, F.col("report") % 2 == 0, 3, F.when(F.col("report") % 5 == 0, 7))
    return found.withColumn("top_codes", F.transform("top_codes", lambda x: F.concat(x["code"], F.lit(":"), x["n"])))


@query("""WITH i AS (SELECT source_page_id AS page_id, CASE WHEN is_broken AND source_page_id % 40 < 3 THEN 1 ELSE 0 END AS e, CASE WHEN target_page_id IS NULL AND NOT (is_broken AND source_page_id % 40 < 3) THEN 1 ELSE 0 END AS w FROM v_links),
  f AS (SELECT page_id, sum(e) AS e, sum(w) AS w FROM i GROUP BY 1) SELECT path_root, count(*) AS files, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings, sum(e) = 0 AS passed FROM (SELECT page_id, created_by AS path_root FROM v_pages) JOIN f USING (page_id) GROUP BY 1""")
def agg22_validation_totals(s, d):
    files = v.pages(s, d).select(F.col("page_id").alias("file"), F.col("created_by").alias("path_root"))
    severity = F.expr("CASE WHEN is_broken AND source_page_id % 40 < 3 THEN 'error' WHEN target_page_id IS NULL THEN 'warning' END")
    issues = v.links(s, d).select(F.col("source_page_id").alias("file"), severity.alias("severity")).filter("severity is not null")
    return reports.validation_totals(files, issues, "path_root")


@query("SELECT page_id, list_contains(ancestors, page_id // 9) AS below FROM v_pages")
def arr02_ancestor_contains(s, d):
    return v.pages(s, d).select("page_id", F.expr("array_contains(ancestors, page_id div 9)").alias("below"))


@query("SELECT c.page_id, c.ancestors = list_slice(list_prepend(p.page_id, p.ancestors), 1, 3) AS moved_along FROM v_pages c JOIN v_pages p ON p.page_id = c.parent_id")
def arr03_ordered_lists(s, d):
    child, parent = v.pages(s, d), v.pages(s, d).select(F.col("page_id").alias("parent_id"), F.expr("slice(array_prepend(ancestors, page_id), 1, 3)").alias("chain"))
    return child.join(parent, "parent_id").select("page_id", (F.col("ancestors") == F.col("chain")).alias("moved_along"))


@query("""WITH l AS (SELECT page_id, list(DISTINCT label) AS labels FROM v_labels GROUP BY 1) SELECT c.page_id, len(list_intersect(a.labels, b.labels)) AS shared FROM v_pages c JOIN l a ON a.page_id = c.page_id JOIN l b ON b.page_id = c.parent_id""")
def arr05_shared_labels(s, d):
    labels = v.labels(s, d).groupBy("page_id").agg(F.collect_set("label").alias("labels"))
    above = labels.select(F.col("page_id").alias("parent_id"), F.col("labels").alias("above"))
    return v.pages(s, d).select("page_id", "parent_id").join(labels, "page_id").join(above, "parent_id").select("page_id", F.size(F.array_intersect("labels", "above")).alias("shared"))


@query("SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM documents")
def str02_short_slugs(s, d):
    return v.table(s, d, "documents").select("doc_id", texts.slug(F.col("text"), 80).alias("slug"))
