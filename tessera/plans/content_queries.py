"""Queries of text functions, trees, links, charts and searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import charts, graph, ranks, search
from tessera.plans import views as v
from tessera.plans.register import query


def _docs(s, d):
    return v.table(s, d, "documents")


_SLUG = "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT doc_id, substr({_SLUG.format(x='text')}, 1, 100) AS slug, substr({_SLUG.format(x='text')}, 1, 80) AS short FROM documents")
def str01_slugs(s, d):
    return _docs(s, d).select("doc_id", texts.slug(F.col("text")).alias("slug"), texts.slug(F.col("text"), 80).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) > 90 THEN concat(substr(text, 1, 87), '...') ELSE text END AS cut FROM documents")
def str06_truncated(s, d):
    return _docs(s, d).select("doc_id", texts.truncated(F.col("text"), 90).alias("cut"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS excerpt FROM pages")
def str07_excerpts(s, d):
    return v.table(s, d, "pages").select("page_id", texts.plain_excerpt(F.col("html")).alias("excerpt"))


_TARGETS = "SELECT DISTINCT doc_id % 8 AS k, CASE doc_id % 8 WHEN 0 THEN '#top' WHEN 1 THEN 'https://a.example.com/x' WHEN 2 THEN 'mailto:a@b.example' WHEN 3 THEN 'img/plan.PNG?v=1' WHEN 4 THEN '../b/c.md' WHEN 5 THEN 'javascript:alert(1)' WHEN 6 THEN ' java script:x' ELSE '' END AS t FROM documents"


def _targets(s, d):
    t = F.expr("CASE doc_id % 8 WHEN 0 THEN '#top' WHEN 1 THEN 'https://a.example.com/x' WHEN 2 THEN 'mailto:a@b.example' WHEN 3 THEN 'img/plan.PNG?v=1' WHEN 4 THEN '../b/c.md' WHEN 5 THEN 'javascript:alert(1)' WHEN 6 THEN ' java script:x' ELSE '' END")
    return _docs(s, d).select((F.col("doc_id") % 8).alias("k"), t.alias("t")).distinct()


@query(f"SELECT k, t, CASE WHEN k = 0 THEN 'anchor' WHEN k IN (1, 2) THEN 'external' WHEN k = 3 THEN 'attachment' ELSE 'relative' END AS kind FROM ({_TARGETS})")
def str08_link_kinds(s, d):
    return _targets(s, d).withColumn("kind", texts.link_kind(F.col("t")))


@query(f"SELECT k, k NOT IN (5, 6, 7) AS safe FROM ({_TARGETS})")
def prd15_safe_links(s, d):
    return _targets(s, d).select("k", texts.is_safe_link(F.col("t")).alias("safe"))


@query("""SELECT DISTINCT doc_id // 2 AS k, concat('en/p', doc_id // 2, '/a/page.md') AS base, concat('en/p', doc_id // 2, '/img/x.md') AS path FROM documents""")
def str11_resolved_paths(s, d):
    base = F.expr("concat('en/p', doc_id div 2, '/a/page.md')")
    return _docs(s, d).select(F.expr("doc_id div 2").alias("k"), base.alias("base"), texts.resolved_path(base, F.lit("./.././img/x.md#top")).alias("path")).distinct()


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '[\",\\n\\r]') THEN concat('\"', replace(text, '\"', '\"\"'), '\"') ELSE text END AS csv FROM documents")
def str14_csv_values(s, d):
    return _docs(s, d).select("doc_id", texts.csv_value(F.col("text")).alias("csv"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def str15_escaped_html(s, d):
    return v.table(s, d, "pages").select("page_id", texts.html_escaped(F.col("html")).alias("escaped"))


@query("SELECT DISTINCT o_orderstatus, 'Last modified by' AS label FROM orders")
def str16_column_labels(s, d):
    return v.table(s, d, "orders").select("o_orderstatus", texts.words_of_camel_case(F.lit("lastModifiedBy")).alias("label")).distinct()


@query("SELECT DISTINCT event_type, event_type IN ('click') AS sensitive FROM events")
def prd12_sensitive_keys(s, d):
    key = F.when(F.col("event_type") == "click", "X-Api_Key-Id").otherwise(F.col("event_type"))
    return v.table(s, d, "events").select("event_type", texts.is_sensitive_key(key).alias("sensitive")).distinct()


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '[REDACTED]' ELSE concat('short-', s_suppkey) END AS shown FROM supplier")
def str18_redacted_values(s, d):
    value = F.expr("CASE WHEN s_suppkey % 2 = 0 THEN concat('abcdefghijklmnopqrstuv', s_suppkey) ELSE concat('short-', s_suppkey) END")
    return v.table(s, d, "supplier").select("s_suppkey", texts.redacted_value(value).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576 * 10 + 0.5) / 10) END AS size FROM (SELECT o_orderkey, (o_orderkey * 977) % 3000001 AS n FROM orders)")
def str20_file_sizes(s, d):
    return v.table(s, d, "orders").select("o_orderkey", texts.file_size((F.col("o_orderkey") * 977) % 3000001).alias("size"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '#AABBCC' WHEN 1 THEN '#112233' WHEN 2 THEN '#008080' END AS colour FROM supplier")
def str22_colours(s, d):
    text = F.expr("CASE s_suppkey % 4 WHEN 0 THEN '#ABC' WHEN 1 THEN '#11223344' WHEN 2 THEN ' Teal ' ELSE 'mauve' END")
    return v.table(s, d, "supplier").select("s_suppkey", texts.colour(text).alias("colour"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN concat('plan-', s_suppkey, '.pdf') WHEN 1 THEN 'attachment' ELSE 'ab.txt' END AS name FROM supplier")
def str29_file_names(s, d):
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, F.concat(F.lit("../x/plan-"), "s_suppkey", F.lit(".pdf"))).when(k == 1, "..").otherwise("c:/a\x07b.txt")
    return v.table(s, d, "supplier").select("s_suppkey", texts.file_name(text).alias("name"))


@query("SELECT a, b, CASE WHEN a // 10 <> b // 10 THEN a // 10 > b // 10 ELSE a % 10 > b % 10 END AS newer FROM (SELECT s_suppkey AS a, (s_suppkey * 7) % 100 AS b FROM supplier)")
def srt12_versions(s, d):
    a, b = F.col("s_suppkey"), (F.col("s_suppkey") * 7) % 100
    text = lambda x: F.concat(F.lit("v1."), F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"), F.lit("-rc"))
    return v.table(s, d, "supplier").select(a.alias("a"), b.alias("b"), (texts.version_key(text(a)) > texts.version_key(text(b))).alias("newer"))


@query("SELECT page_id, row_number() OVER (ORDER BY page_id) AS place FROM v_pages")
def srt01_natural_order(s, d):
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    return ranks.placed(v.pages(s, d).select("page_id"), texts.natural_key(title)).select("page_id", "place")


@query("SELECT count(*) = count(*) FILTER (a = b) AS same FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS a, row_number() OVER (ORDER BY page_id DESC) AS b FROM v_pages)")
def srt02_same_order(s, d):
    rows = ranks.placed(ranks.placed(v.pages(s, d).select("page_id"), "page_id", name="a"), F.desc("page_id"), name="b")
    return rows.agg((F.count(F.lit(1)) == F.count_if(F.col("a") == F.col("b"))).alias("same"))


@query("SELECT source_page_id, target_path, CASE WHEN link_type <> 'external' OR target_path IS NULL OR target_path = 'not a url' THEN 'unprovable' WHEN starts_with(target_path, 'https://host1.') THEN 'same' ELSE 'cross' END AS verdict FROM v_links")
def prd14_same_site(s, d):
    return v.links(s, d).select("source_page_id", "target_path", texts.same_site(F.col("target_path"), F.lit("HTTPS://host1.example.com/wiki")).alias("verdict"))


@query("SELECT doc_id, concat('\"', replace(replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\', '\\\\'), '\"', '\\\"'), '\"') AS literal FROM documents")
def qry06_query_literals(s, d):
    return _docs(s, d).select("doc_id", texts.query_literal(F.col("text")).alias("literal"))


@query("SELECT doc_id, lower(split_part(trim(text), ' ', 1)) AS prefix FROM documents WHERE starts_with(lower(text), 'the')")
def prd21_prefix_completion(s, d):
    return _docs(s, d).filter(F.lower("text").startswith("the")).select("doc_id", F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("prefix"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links FROM pages")
def str13_page_titles(s, d):
    return v.table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("links"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def str10_page_links(s, d):
    return v.table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def mth06_text_digests(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT DISTINCT status_category, CASE status_category WHEN 'done' THEN 'green' WHEN 'indeterminate' THEN 'blue' ELSE 'grey' END AS colour FROM v_issues")
def mth07_status_colours(s, d):
    colours = F.create_map(*[F.lit(x) for x in ("done", "green", "indeterminate", "blue", "new", "grey")])
    return v.issues(s, d).select("status_category", F.element_at(colours, F.col("status_category")).alias("colour")).distinct()


@query("SELECT doc_id, concat(lang, '|', source) AS parts FROM documents")
def arr04_split_lists(s, d):
    parts = F.filter(F.transform(F.split(F.concat("lang", F.lit(" , "), "source", F.lit(",,"), "lang"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return _docs(s, d).select("doc_id", F.array_join(F.array_distinct(parts), "|").alias("parts"))


@query("SELECT page_id, labels FROM (SELECT page_id, list_sort(list(DISTINCT trim(label))) AS labels FROM (SELECT page_id, label FROM v_labels UNION ALL SELECT page_id, concat(' ', label, ' ') FROM v_labels) GROUP BY 1)")
def prd08_normal_labels(s, d):
    twice = v.labels(s, d).unionByName(v.labels(s, d).withColumn("label", F.concat(F.lit(" "), "label", F.lit(" "))))
    return twice.groupBy("page_id").agg(F.array_sort(F.array_distinct(F.transform(F.collect_list("label"), lambda x: F.trim(x)))).alias("labels"))


_TREE = """WITH RECURSIVE t AS (SELECT page_id AS id, 0 AS depth, [page_id] AS path FROM v_pages WHERE parent_id IS NULL
  UNION ALL SELECT p.page_id, t.depth + 1, list_append(t.path, p.page_id) FROM t JOIN v_pages p ON p.parent_id = t.id WHERE NOT list_contains(t.path, p.page_id))"""


def _tree(s, d):
    return graph.expand_levels(v.pages(s, d).select(F.col("page_id").alias("id"), "parent_id"))


@query(f"{_TREE} SELECT id, depth, path[1] AS root FROM t")
def hie05_navigation_depths(s, d):
    return _tree(s, d).select("id", "depth", "root")


_ORDER = _TREE + """, k AS (SELECT t.id, t.depth, string_agg(concat(lpad(CAST(n.node % 5 AS VARCHAR), 12, '0'), chr(1), p.title, chr(1), lpad(CAST(n.node AS VARCHAR), 20, '0')), chr(2) ORDER BY n.at_) AS key
  FROM t, LATERAL (SELECT unnest(t.path) AS node, unnest(range(len(t.path))) AS at_) n JOIN v_pages p ON p.page_id = n.node GROUP BY 1, 2), o AS (SELECT id, depth, row_number() OVER (ORDER BY key) AS place FROM k)"""


def _order(s, d):
    titles = v.pages(s, d).select(F.col("page_id").alias("id"), (F.col("page_id") % 5).alias("position"), "title")
    return graph.pre_order(_tree(s, d), titles)


@query(f"{_ORDER} SELECT id, depth, place FROM o")
def hie02_pre_order(s, d):
    return _order(s, d)


@query(f"{_ORDER} SELECT id, lag(id) OVER (ORDER BY place) AS previous, lead(id) OVER (ORDER BY place) AS next FROM o")
def win03_neighbours(s, d):
    return graph.neighbours(_order(s, d))


@query("""WITH h AS (SELECT page_id AS hit FROM v_labels WHERE label = 'Draft'), c AS (SELECT page_id, unnest(list_append(ancestors, page_id)) AS hit FROM v_pages) SELECT page_id FROM v_pages WHERE page_id NOT IN (SELECT page_id FROM c JOIN h USING (hit))""")
def hie01_label_prune(s, d):
    return graph.prune_by_label(v.pages(s, d), v.labels(s, d), "Draft").select("page_id")


@query("""WITH k AS (SELECT * FROM v_pages WHERE page_id NOT IN (SELECT page_id FROM v_labels WHERE label = 'Draft')), c AS (SELECT page_id, unnest(ancestors) AS a, unnest(range(len(ancestors))) AS i FROM k),
  n AS (SELECT page_id, arg_min(a, i) AS new_parent, count(*) AS effective_depth FROM c WHERE a IN (SELECT page_id FROM k) GROUP BY 1) SELECT k.page_id, n.new_parent, coalesce(n.effective_depth, 0) AS effective_depth FROM k LEFT JOIN n USING (page_id)""")
def hie01_label_reparent(s, d):
    return graph.reparent_by_label(v.pages(s, d), v.labels(s, d), "Draft")


@query("""WITH c AS (SELECT page_id, unnest(ancestors) AS a, unnest(range(len(ancestors))) AS i FROM v_pages), t AS (SELECT c.page_id, list(p.title ORDER BY i) AS titles FROM c JOIN v_pages p ON p.page_id = c.a GROUP BY 1) SELECT page_id, coalesce(titles, []) AS titles FROM v_pages LEFT JOIN t USING (page_id)""")
def jn13_ancestor_titles(s, d):
    return graph.ancestor_titles(v.pages(s, d))


@query(f"""SELECT id, CASE WHEN n = 1 THEN sl ELSE concat(sl, '-', n) END AS slug FROM (SELECT id, sl, row_number() OVER (PARTITION BY sl ORDER BY id) AS n FROM (SELECT page_id AS id, {_SLUG.format(x="concat('Plan ', page_id % 37, '!')")} AS sl FROM v_pages))""")
def win10_unique_slugs(s, d):
    return graph.unique_slugs(v.pages(s, d).select(F.col("page_id").alias("id"), F.expr("concat('Plan ', page_id % 37, '!')").alias("name")))


@query(f"""{_TREE}, sl AS (SELECT page_id, CASE WHEN n = 1 THEN sl ELSE concat(sl, '-', n) END AS slug FROM (SELECT page_id, sl, row_number() OVER (PARTITION BY sl ORDER BY page_id) AS n FROM (SELECT page_id, {_SLUG.format(x='title')} AS sl FROM v_pages)))
  SELECT t.id, string_agg(sl.slug, '/' ORDER BY n.at_) AS path FROM t, LATERAL (SELECT unnest(t.path) AS node, unnest(range(len(t.path))) AS at_) n JOIN sl ON sl.page_id = n.node GROUP BY 1""")
def hie03_slug_paths(s, d):
    slugs = graph.unique_slugs(v.pages(s, d).select(F.col("page_id").alias("id"), F.col("title").alias("name"))).withColumnRenamed("id", "node")
    steps = _tree(s, d).select("id", F.posexplode("path").alias("at", "node")).join(slugs, "node")
    return steps.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "slug"))), lambda x: x["slug"]), "/").alias("path"))


@query("SELECT page_id, string_split(path, '/')[-1] AS leaf, list_aggregate(string_split(path, '/')[1:-2], 'string_agg', '/') AS folder, ancestors <> [parent_id] AS deeper FROM v_pages WHERE parent_id IS NOT NULL")
def hie04_path_parts(s, d):
    parts = F.split("path", "/")
    return v.pages(s, d).filter("parent_id is not null").select("page_id", F.element_at(parts, -1).alias("leaf"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), (F.col("ancestors") != F.array("parent_id")).alias("deeper"))


@query("SELECT page_id FROM v_pages f WHERE content_type = 'folder' AND NOT EXISTS (SELECT 1 FROM v_pages c WHERE c.parent_id = f.page_id)")
def hie08_empty_folders(s, d):
    return graph.empty_folders(v.pages(s, d)).select("page_id")


@query("""WITH p AS (SELECT page_id, title, parent_id, coalesce(ancestors[-1], page_id) AS root FROM v_pages), o AS (SELECT DISTINCT source_page_id AS a, target_page_id AS b FROM v_links),
  l AS (SELECT DISTINCT x.page_id AS a, y.page_id AS b FROM v_labels x JOIN v_labels y ON x.label = y.label),
  g AS (SELECT x.page_id AS a, y.page_id AS b, y.title, CASE WHEN u.a IS NULL THEN 0 ELSE 100 END + CASE WHEN w.a IS NULL THEN 0 ELSE 75 END + CASE WHEN l.a IS NULL THEN 0 ELSE 20 END + CASE WHEN x.parent_id IS NOT DISTINCT FROM y.parent_id THEN 10 ELSE 0 END + CASE WHEN x.root = y.root THEN 5 ELSE 0 END AS score
    FROM p x JOIN p y ON x.page_id <> y.page_id LEFT JOIN o u ON u.a = x.page_id AND u.b = y.page_id LEFT JOIN o w ON w.a = y.page_id AND w.b = x.page_id LEFT JOIN l ON l.a = x.page_id AND l.b = y.page_id)
  SELECT a AS page_id, b AS related, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, title, b) AS rank FROM g WHERE score > 0) WHERE rank <= 5""")
def jn10_related_pages(s, d):
    return graph.related_pages(v.pages(s, d), v.links(s, d), v.labels(s, d))


@query("SELECT l.source_page_id, l.target_path, t.page_id AS target_id, t.page_id IS NULL AS broken FROM v_links l JOIN v_pages p ON p.page_id = l.source_page_id LEFT JOIN v_pages t ON t.path = concat(p.space_key, '/', substr(replace(l.target_path, '.md', ''), 4)) WHERE l.link_type = 'internal'")
def jn11_resolved_links(s, d):
    src = v.pages(s, d).select(F.col("page_id").alias("source_page_id"), F.col("path").alias("source_path"))
    links = v.links(s, d).filter("link_type = 'internal'").join(src, "source_page_id").withColumn("target", F.replace("target_path", F.lit(".md"), F.lit("")))
    return graph.resolve_links(links, v.pages(s, d)).select("source_page_id", "target_path", "target_id", "broken")


@query("SELECT source_page_id, target_page_id FROM v_links WHERE target_page_id IS NOT NULL AND target_page_id NOT IN (SELECT page_id FROM v_pages WHERE page_id % 5 <> 0)")
def jn16_dangling_references(s, d):
    known = v.pages(s, d).filter("page_id % 5 <> 0").select(F.col("page_id").alias("target_page_id"))
    return graph.dangling(v.links(s, d).filter("target_page_id is not null"), known, "target_page_id").select("source_page_id", "target_page_id")


@query("""WITH f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN concat('Doc-', s_suppkey, '.PDF') ELSE concat('doc-', s_suppkey, '.pdf') END AS file FROM supplier), w AS (SELECT DISTINCT concat('doc-', s_suppkey % 60, '.pdf') AS want FROM supplier)
  SELECT want, coalesce((SELECT file FROM f WHERE file = want), (SELECT min(file) FROM f WHERE lower(file) = lower(want))) AS file FROM w WHERE EXISTS (SELECT 1 FROM f WHERE lower(file) = lower(want))""")
def jn17_attachment_names(s, d):
    sup = v.table(s, d, "supplier")
    files = sup.select(F.expr("CASE WHEN s_suppkey % 2 = 0 THEN concat('Doc-', s_suppkey, '.PDF') ELSE concat('doc-', s_suppkey, '.pdf') END").alias("file"))
    return graph.exact_or_folded(sup.select(F.expr("concat('doc-', s_suppkey % 60, '.pdf')").alias("want")).distinct(), files)


@query("SELECT s_suppkey, list_filter(['a', 'b', 'c'], lambda x: (x = 'b' OR s_suppkey % 2 = 0) AND x <> 'c' OR x = 'c' AND s_suppkey % 3 = 0) AS missing FROM supplier")
def jn18_missing_capabilities(s, d):
    have = F.expr("filter(array(CASE WHEN s_suppkey % 2 <> 0 THEN 'a' END, CASE WHEN s_suppkey % 3 <> 0 THEN 'c' END), x -> x is not null)")
    return v.table(s, d, "supplier").select("s_suppkey", F.array_except(F.array(F.lit("a"), F.lit("b"), F.lit("c")), have).alias("missing"))


@query("""SELECT name, level, level > first AS shadowed, CASE WHEN level > first THEN first END AS overridden_by FROM (SELECT l_partkey % 50 AS name, l_linenumber AS level, min(l_linenumber) OVER (PARTITION BY l_partkey % 50) AS first FROM (SELECT DISTINCT l_partkey % 50 AS l_partkey, l_linenumber FROM lineitem))""")
def win14_overrides(s, d):
    rows = v.table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("name"), F.col("l_linenumber").alias("level")).distinct()
    return graph.first_priority(rows, "name", "level").select("name", "level", "shadowed", "overridden_by")


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY doc_id % 700) > 1 THEN concat('f', doc_id % 700, '-', doc_id) ELSE concat('f', doc_id % 700) END AS name FROM documents")
def win15_duplicate_names(s, d):
    name = F.expr("concat('f', doc_id % 700)")
    return _docs(s, d).select("doc_id", F.when(F.count(F.lit(1)).over(Window.partitionBy(F.col("doc_id") % 700)) > 1, F.concat(name, F.lit("-"), "doc_id")).otherwise(name).alias("name"))


@query("SELECT lower(label) AS key, list_sort(list(DISTINCT label)) AS forms, count(DISTINCT page_id) AS pages FROM v_labels GROUP BY 1")
def agg30_label_groups(s, d):
    return v.labels(s, d).groupBy(F.lower("label").alias("key")).agg(F.array_sort(F.collect_set("label")).alias("forms"), F.count_distinct("page_id").alias("pages"))


_REVENUE = "SELECT year(o_orderdate) AS yr, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1"


def _revenue(s, d):
    return v.table(s, d, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(*(F.sum(F.when(F.col("o_orderstatus") == c.upper(), F.col("o_totalprice"))).alias(c) for c in "fop"))


@query(f"SELECT yr AS label, 'f' AS series, f AS value FROM ({_REVENUE}) UNION ALL SELECT yr, 'o', o FROM ({_REVENUE}) UNION ALL SELECT yr, 'p', p FROM ({_REVENUE})")
def rsh01_series_from_columns(s, d):
    return charts.series_from_columns(_revenue(s, d), "yr", ["f", "o", "p"])


@query(f"SELECT 'f' AS label, CAST(yr AS VARCHAR) AS series, f AS value FROM ({_REVENUE}) UNION ALL SELECT 'o', CAST(yr AS VARCHAR), o FROM ({_REVENUE}) UNION ALL SELECT 'p', CAST(yr AS VARCHAR), p FROM ({_REVENUE})")
def rsh02_series_from_rows(s, d):
    return charts.series_from_rows(_revenue(s, d), "yr", ["f", "o", "p"])


@query("SELECT CAST(o_orderkey AS DOUBLE) AS x, o_totalprice AS y FROM orders WHERE o_orderkey % 3 <> 0")
def rsh03_points(s, d):
    return charts.points(v.table(s, d, "orders"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE cast(o_orderkey as string) END"), F.col("o_totalprice").cast("string"))


@query("SELECT o_orderkey, CASE WHEN p > 1 THEN least(p / 100, 1.0) ELSE p END AS progress FROM (SELECT o_orderkey, (o_orderkey % 300) / 2.0 AS p FROM orders)")
def rsh04_gantt_progress(s, d):
    p = (F.col("o_orderkey") % 300) / 2
    return v.table(s, d, "orders").select("o_orderkey", F.when(p > 1, F.least(p / 100, F.lit(1.0))).otherwise(p).alias("progress"))


@query("""SELECT o_custkey AS table_id, o_orderkey AS row_no, concat('T', o_orderkey) AS label, o_orderdate AS start, o_orderdate + INTERVAL 3 DAY AS "end",
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 150 > 100 THEN (o_orderkey % 150) / 10000.0 ELSE (o_orderkey % 150) / 100.0 END WHEN o_orderkey % 300 > 1 THEN least(1.0, (o_orderkey % 300) / 100.0) ELSE o_orderkey % 300 END AS progress,
  [CAST(o_orderkey - 1 AS VARCHAR), CAST(o_orderkey - 2 AS VARCHAR)] AS dependencies FROM orders WHERE o_orderkey % 7 <> 0""")
def rsh04_gantt_tasks(s, d):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    later = "date_format(date_add(o_orderdate, 3), 'dd.MM.yyyy')"
    share = "CASE WHEN o_orderkey % 5 = 0 THEN 'open' WHEN o_orderkey % 2 = 0 THEN concat(o_orderkey % 150, '%') ELSE cast(o_orderkey % 300 as string) END"
    needs, begin = "concat(o_orderkey - 1, ' ;, ', o_orderkey - 2)", f"CASE WHEN o_orderkey % 7 = 0 THEN '2001-13-45' ELSE {day} END"
    turned = F.col("o_custkey") % 2 == 0
    header = F.when(turned, F.array(*map(F.lit, ("Due date", "Predecessors", "Name", "Status", "Begins", "Task")))).otherwise(F.array(*map(F.lit, ("No header", "Start", "Finish", "% complete", "Depends on", "Other"))))
    first = F.expr(f"array({later}, {needs}, concat('T', o_orderkey), {share}, {begin}, 'x')")
    second = F.expr(f"array(concat('T', o_orderkey), {begin}, {later}, {share}, {needs}, 'x')")
    rows = v.table(s, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row_no"), header.alias("header"), F.when(turned, first).otherwise(second).alias("cells"))
    return charts.gantt_tasks(rows, dates=("yyyy-MM-dd", "dd.MM.yyyy"))


_VALUES = "SELECT year(o_orderdate) AS label, o_orderpriority AS series, sum(floor(o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END) AS value FROM orders GROUP BY 1, 2"


def _values(s, d):
    return v.table(s, d, "orders").groupBy(F.year("o_orderdate").alias("label"), F.col("o_orderpriority").alias("series")).agg(F.sum(F.floor("o_totalprice").cast("double") * F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)).alias("value"))


@query(f"WITH x AS ({_VALUES}) SELECT l.label, r.series, coalesce(x.value, 0) AS value, x.value IS NULL AS missing FROM (SELECT DISTINCT label FROM x) l CROSS JOIN (SELECT DISTINCT series FROM x) r LEFT JOIN x ON x.label = l.label AND x.series = r.series")
def set04_label_grid(s, d):
    return charts.label_grid(_values(s, d))


@query(f"SELECT label, series, greatest(value - 200000, 0) / sum(greatest(value - 200000, 0)) OVER () AS share FROM ({_VALUES})")
def agg28_pie_shares(s, d):
    return charts.shares(_values(s, d).withColumn("value", F.col("value") - 200000)).select("label", "series", "share")


@query(f"""SELECT label, series, value, sum(value) OVER (PARTITION BY label, value < 0 ORDER BY series) AS "end", sum(value) OVER (PARTITION BY label, value < 0 ORDER BY series) - value AS start FROM (SELECT label, series, value - 200000 AS value FROM ({_VALUES}))""")
def win12_stacked(s, d):
    return charts.stacked(_values(s, d).withColumn("value", F.col("value") - 200000)).select("label", "series", "value", "end", "start")


@query("WITH g AS (SELECT p_size, p_size - lag(p_size) OVER (ORDER BY p_size) AS gap FROM (SELECT DISTINCT p_size FROM part)), e AS (SELECT min(p_size) AS low, max(p_size) AS high, min(gap) AS gap FROM g) SELECT *, low - coalesce(gap, 1.0) / 2 AS padded_low, high + coalesce(gap, 1.0) / 2 AS padded_high FROM e")
def agg29_axis_extent(s, d):
    return charts.extent(v.table(s, d, "part"), "p_size")


def _properties(s, d):
    return v.table(s, d, "events").select((F.col("user_id") % 100).alias("page_id"), F.col("event_type").alias("label"), F.concat(F.lit("v"), F.col("event_id")).alias("value"), F.col("event_id").alias("pos"))


@query("""WITH f AS (SELECT user_id % 100 AS page_id, event_type AS label, concat('v', min(event_id)) AS value FROM events GROUP BY 1, 2) SELECT page_id, max(CASE WHEN label = 'click' THEN value END) AS click, max(CASE WHEN label = 'error' THEN value END) AS error, max(CASE WHEN label = 'view' THEN value END) AS "view" FROM f GROUP BY 1""")
def rsh07_property_report(s, d):
    return charts.property_report(_properties(s, d), ["click", "error", "view"])


@query("WITH m AS (SELECT event_type AS label, min({'a': user_id % 100, 'b': event_id}) AS at_ FROM events GROUP BY 1) SELECT label, row_number() OVER (ORDER BY at_, label) AS place FROM m")
def win09_first_seen(s, d):
    return charts.first_seen(_properties(s, d))


@query("SELECT s_suppkey, s_suppkey - 1 AS before FROM supplier WHERE s_suppkey >= 1")
def jn12_gantt_dependencies(s, d):
    tasks = v.table(s, d, "supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("id"), F.concat(F.lit("Task "), "s_suppkey").alias("label"), F.lit(None).cast("int").alias("place"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN concat('t', s_suppkey - 1) ELSE concat(' TASK ', s_suppkey - 1, ' , nothing') END").alias("after"))
    return charts.gantt_dependencies(tasks).select(F.substring("id", 2, 9).cast("long").alias("s_suppkey"), F.substring("depends_on", 2, 9).cast("long").alias("before"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS no FROM orders")
def prj08_numbered_rows(s, d):
    return v.table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("no"))


@query("SELECT issue_id, issue_key, status_category, priority, coalesce(assignee, '') AS assignee, epic_id, strftime(created, '%Y-%m-%d') AS created, points_raw FROM v_issues")
def prj01_flat_issues(s, d):
    nested = v.issues(s, d).select("issue_id", "issue_key", F.struct(F.struct(F.col("status_category").alias("key")).alias("status"), F.struct(F.col("priority").alias("name")).alias("priority"), F.col("assignee"), "epic_id", "created", "points_raw").alias("fields"))
    return nested.select("issue_id", "issue_key", F.col("fields.status.key").alias("status_category"), F.col("fields.priority.name").alias("priority"), F.coalesce("fields.assignee", F.lit("")).alias("assignee"), "fields.epic_id", F.date_format("fields.created", "yyyy-MM-dd").alias("created"), "fields.points_raw")


@query("SELECT issue_id, coalesce(assignee, priority, '') AS who, concat(priority, ', ', status_category) AS joined FROM v_issues")
def prj03_flat_values(s, d):
    return v.issues(s, d).select("issue_id", F.coalesce("assignee", "priority", F.lit("")).alias("who"), F.array_join(F.array("priority", "status_category"), ", ").alias("joined"))


@query("SELECT page_id, title AS \"Title\", coalesce(last_modified_by, '') AS \"Last modified by\", '' AS \"Nothing\" FROM v_pages")
def prj04_list_columns(s, d):
    known = {"title": F.col("title"), "lastmodifiedby": F.coalesce("last_modified_by", F.lit(""))}
    wanted = {"Title": "TITLE", "Last modified by": "lastModifiedBy", "Nothing": "nothing"}
    return v.pages(s, d).select("page_id", *(known.get(k.lower(), F.lit("")).alias(label) for label, k in wanted.items()))


@query("SELECT issue_key AS key, status_category AS status, priority FROM v_issues ORDER BY created DESC, issue_id LIMIT 50")
def prj05_issue_table(s, d):
    return v.issues(s, d).orderBy(F.desc("created"), "issue_id").limit(50).select(F.col("issue_key").alias("key"), F.col("status_category").alias("status"), "priority")


@query("SELECT page_id AS pageId, space_key AS spaceKey, has_attachments AS hasAttachments, to_json(ancestors) AS ancestors FROM v_pages")
def prj06_record_names(s, d):
    return v.pages(s, d).select(F.col("page_id").alias("pageId"), F.col("space_key").alias("spaceKey"), F.col("has_attachments").alias("hasAttachments"), F.to_json("ancestors").alias("ancestors"))


@query("SELECT job_id, state IN ('succeeded', 'failed', 'cancelled') AS finished, CASE WHEN state = 'failed' THEN 'error' WHEN state = 'succeeded' AND delivered_at IS NULL THEN 'ready' ELSE 'plain' END AS tone FROM v_jobs")
def prj07_activity_rows(s, d):
    tone = F.when(F.col("state") == "failed", "error").when((F.col("state") == "succeeded") & F.col("delivered_at").isNull(), "ready").otherwise("plain")
    return v.jobs(s, d).select("job_id", F.col("state").isin("succeeded", "failed", "cancelled").alias("finished"), tone.alias("tone"))


@query("SELECT event_id, event_type AS field, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")
def prj10_assignments(s, d):
    text = F.concat("event_type", F.lit("="), F.get_json_object("props", "$.k"))
    return v.table(s, d, "events").select("event_id", F.split_part(text, F.lit("="), F.lit(1)).alias("field"), F.regexp_extract(text, "=(.*)$", 1).alias("value"))


@query("SELECT page_id, to_json({'a': ancestors, 't': title}) AS doc FROM v_pages")
def jsn01_json_round_trip(s, d):
    doc = F.to_json(F.struct(F.col("ancestors").alias("a"), F.col("title").alias("t")))
    return v.pages(s, d).select("page_id", F.to_json(F.from_json(doc, "a array<long>, t string")).alias("doc"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def map01_case_insensitive_lookup(s, d):
    entries = F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda e: F.struct(F.lower(e["key"]), e["value"]))
    return v.table(s, d, "events").select("event_id", F.element_at(F.map_from_entries(entries), "k").alias("k"))


@query("SELECT event_id, concat(event_type, ':', json_extract_string(props, '$.k')) AS found FROM events")
def map02_property_lookup(s, d):
    m = F.create_map(F.lower(F.concat("event_type", F.lit("/K"))), F.get_json_object("props", "$.k"))
    return v.table(s, d, "events").select("event_id", F.concat("event_type", F.lit(":"), F.element_at(m, F.lower(F.concat("event_type", F.lit("/k"))))).alias("found"))


@query("SELECT page_id, list_contains(ancestors, 5) AS under, len(list_intersect(ancestors, [1, 2, 5])) > 0 AS near, CAST(len(list_intersect(ancestors, [1, 2, 5])) AS INTEGER) AS shared, ancestors = [parent_id] AS only FROM v_pages WHERE parent_id IS NOT NULL")
def arr01_ancestor_arrays(s, d):
    some = F.array(*[F.lit(x).cast("long") for x in (1, 2, 5)])
    return v.pages(s, d).filter("parent_id is not null").select("page_id", F.array_contains("ancestors", F.lit(5).cast("long")).alias("under"), F.arrays_overlap("ancestors", some).alias("near"), F.size(F.array_intersect("ancestors", some)).alias("shared"), (F.col("ancestors") == F.array("parent_id")).alias("only"))


@query("SELECT page_id FROM v_pages WHERE space_key IN ('en', 'fr') AND content_type = 'page' AND created_by = 'u7' AND last_modified >= DATE '2000-08-02' AND contains(lower(title), '7') AND page_id IN (SELECT page_id FROM v_labels WHERE label = 'lang-en' OR label = 'lang-fr')")
def qry01_content_search(s, d):
    found = search.ContentSearch(title="7", spaces=("en", "fr"), creator="me", modified_since="2000-08-02").apply(v.pages(s, d), v.labels(s, d), v.AS_OF, me="u7")
    tagged = v.labels(s, d).filter("label in ('lang-en', 'lang-fr')").select("page_id").distinct()
    return found.join(tagged, "page_id", "left_semi").select("page_id")


@query("""SELECT 'today' AS word, '2001-08-02' AS day UNION ALL SELECT 'yesterday', '2001-08-01' UNION ALL SELECT 'thisWeek', '2001-07-30' UNION ALL SELECT 'thisMonth', '2001-08-01' UNION ALL SELECT '7d', '2001-07-26' UNION ALL SELECT '2w', '2001-07-19' UNION ALL SELECT '1m', '2001-07-02' UNION ALL SELECT '2000-02-03', '2000-02-03'""")
def qry02_date_words(s, d):
    from tessera.functions.times import search_date

    now = F.lit(v.AS_OF).cast("timestamp")
    words = ("today", "yesterday", "thisWeek", "thisMonth", "7d", "2w", "1m", "2000-02-03")
    return s.range(1).select(F.explode(F.array(*(F.struct(F.lit(w).alias("word"), search_date(w, now).cast("string").alias("day")) for w in words))).alias("x")).select("x.*")


@query("SELECT issue_key FROM v_issues WHERE status_category IN ('new', 'indeterminate') AND priority = '1-URGENT' AND sprint_id = 24004")
def qry03_issue_search(s, d):
    return search.IssueSearch(statuses=("new", "indeterminate"), priorities=("1-URGENT",), sprint=24004).apply(v.issues(s, d)).select("issue_key")


@query("SELECT issue_key FROM v_issues WHERE assignee = 'c7' AND status_category <> 'done' ORDER BY created DESC, issue_id LIMIT 25")
def qry04_my_issues(s, d):
    return search.IssueSearch(assignee="me", unresolved=True).apply(v.issues(s, d), me="c7").orderBy(F.desc("created"), "issue_id").limit(25).select("issue_key")


@query("SELECT issue_key FROM v_issues WHERE issue_id IN (SELECT issue_id FROM v_worklogs WHERE author_id = 'u7' AND started >= '1998-01-01' AND started < '1999-01-01')")
def qry05_issues_with_worklogs(s, d):
    logs = v.worklogs(s, d).filter("author_id = 'u7' and started >= '1998-01-01' and started < '1999-01-01'")
    return v.issues(s, d).join(logs.select("issue_id"), "issue_id", "left_semi").select("issue_key")


@query("SELECT page_id FROM v_pages WHERE space_key = 'de' AND content_type IN ('page', 'folder') AND list_contains(ancestors, 1)")
def qry08_search_from_source(s, d):
    return search.search_from_source({"spaceKeys": ["de"], "contentTypes": ["page", "folder"], "ancestorIds": [1], "searchString": ""}).apply(v.pages(s, d), v.labels(s, d), v.AS_OF).select("page_id")


@query("SELECT page_id FROM v_pages WHERE page_id IN (SELECT page_id FROM v_labels WHERE label = 'lang-en') AND page_id IN (SELECT page_id FROM v_labels WHERE label = 'src0')")
def qry10_report_search(s, d):
    return search.ContentSearch(types=(), labels=("lang-en", "src0")).apply(v.pages(s, d), v.labels(s, d), v.AS_OF).select("page_id")


@query("SELECT r.r_name, o.o_orderpriority, count(*) AS n, sum(o.o_totalprice) AS revenue FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ROLLUP (r.r_name, o.o_orderpriority)")
def ext01_rollup(s, d):
    t = lambda n: v.table(s, d, n)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("revenue"))


@query("SELECT epic_id, count(*) AS n FROM v_issues GROUP BY 1 HAVING count(*) >= 15")
def ext02_having(s, d):
    return v.issues(s, d).groupBy("epic_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def ext03_distinct_counts(s, d):
    return v.table(s, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS q, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ext05_ranks(s, d):
    w = Window.partitionBy("o_custkey")
    near = F.sum("o_totalprice").over(w.orderBy("o_totalprice").rangeBetween(-1000, 0))
    return v.table(s, d, "orders").select("o_orderkey", F.rank().over(w.orderBy("o_orderpriority")).alias("r"), F.dense_rank().over(w.orderBy("o_orderpriority")).alias("dr"), F.ntile(4).over(w.orderBy("o_totalprice", "o_orderkey")).alias("q"), near.alias("near"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def ext06_hourly_events(s, d):
    return v.table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH e AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS cosine, list_distance(CAST(embedding AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS distance FROM embeddings, e WHERE vec_id <> 0)
  SELECT vec_id, round(cosine, 6) AS cosine, round(distance, 6) AS distance FROM x WHERE cosine >= 0.2 ORDER BY x.distance, vec_id LIMIT 20""")
def ext09_similar_pages(s, d):
    e = v.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = [float(x) for x in e.filter("vec_id = 0").first()["v"]]  # one vector
    qv = F.array(*map(F.lit, q))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    dist = F.sqrt(F.aggregate(F.zip_with("v", qv, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda n, x: n + x))
    x = e.filter("vec_id <> 0").select("vec_id", (dot(F.col("v"), qv) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(qv, qv)))).alias("c"), dist.alias("dd"))
    return x.filter("c >= 0.2").orderBy("dd", "vec_id").limit(20).select("vec_id", F.round("c", 6).alias("cosine"), F.round("dd", 6).alias("distance"))
