"""Queries that run a stream over the events until it has read all, and queries of files and small documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import documents as doc
from tessera.plans import views as v
from tessera.plans.document_queries import _scratch
from tessera.plans.register import query
from tessera.sources import registry as sources
from tessera.streaming import streams


def _events(s: SparkSession, d: str) -> DataFrame:
    """The events table as a stream with times that can carry a watermark."""
    schema = v.table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame) -> DataFrame:
    """All rows that a stream appends, written to files and read back."""
    path = _scratch(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


@query("""WITH x AS (SELECT DISTINCT user_id % 50 AS id, event_id % 20 AS version FROM events) SELECT id, version, CASE WHEN version = min(version) OVER (PARTITION BY id) THEN 'created' ELSE 'changed' END AS kind FROM x""")
def stm01_poll_changes(s, d):
    return _drained(streams.poll_changes(_events(s, d).select((F.col("user_id") % 50).alias("id"), (F.col("event_id") % 20).alias("version"))))


@query("SELECT DISTINCT user_id AS id, event_id % 3 AS version FROM events")
def stm02_once_per_version(s, d):
    return _drained(streams.once_per_version(_events(s, d).select(F.col("user_id").alias("id"), (F.col("event_id") % 3).alias("version"), "ts"), late="60 days").select("id", "version"))


@query("SELECT event_id, user_id % 5 AS project, event_type AS kind FROM events WHERE user_id % 5 IN (1, 2) AND event_type IN ('click', 'error')")
def stm03_webhook_events(s, d):
    rows = _events(s, d).select("event_id", (F.col("user_id") % 5).alias("project"), F.col("event_type").alias("kind"))
    return _drained(streams.webhook_events(rows, [1, 2], ["click", "error"]))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def stm04_log_tail(s, d):
    return _drained(_events(s, d).filter("event_type = 'error'").select("event_id", "event_type"))


@query("SELECT event_id, value FROM events WHERE event_id >= 500")
def stm05_after_cursor(s, d):
    return _drained(_events(s, d).filter("event_id >= 500").select("event_id", "value"))


@query("SELECT p.event_id, c.event_id AS click FROM events p JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase'")
def ext08_purchases_after_clicks(s, d):
    events = _events(s, d)
    clicks = events.filter("event_type = 'click'").withWatermark("ts", "1 hour").select(F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts"), F.col("event_id").alias("click"))
    bought = events.filter("event_type = 'purchase'").withWatermark("ts", "1 hour")
    joined = bought.join(clicks, F.expr("user_id = click_user and click_ts <= ts and click_ts >= ts - interval 1 hour"))
    return _drained(joined.select("event_id", "click"))


@query("SELECT page_id, title FROM v_pages")
def src02_json_store(s, d):
    path = _scratch(s)
    row = F.struct(F.col("page_id").cast("string").alias("page_id"), "title")
    parts = v.pages(s, d).groupBy(F.expr("page_id div 1000")).agg(F.collect_list(row).alias("pages"))  # a part holds a thousand pages at most
    parts.select(F.to_json(F.struct("pages")).alias("value")).write.text(path)
    return sources.load(s, "json", path, parts=True).select(F.col("page_id").cast("long").alias("page_id"), "title")


@query("SELECT 'A' AS key, 'High' AS priority, 'two\nlines, \"quoted\"' AS summary UNION ALL SELECT 'B', NULL, 'plain'")
def src14_csv_import(s, d):
    path = _scratch(s)
    s.createDataFrame([('key,priority,summary\nA,High,"two\nlines, ""quoted"""\nB,,plain\n',)], "value string").coalesce(1).write.text(path)
    return sources.load(s, "csv", path)


@query("SELECT 'K-1' AS key, 'High' AS priority, 'me' AS assignee UNION ALL SELECT 'K-2', NULL, NULL")
def src15_json_import(s, d):
    path = _scratch(s)
    text = json.dumps({"issues": [{"key": "K-1", "fields": {"priority": {"name": "High"}, "assignee": {"accountId": "me"}, "status": {"name": "x"}}}, {"key": "K-2", "fields": {"summary": "s"}}]})
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return sources.load(s, "issues-json", path).select("key", F.try_element_at("fields", F.lit("priority")).alias("priority"), F.try_element_at("fields", F.lit("assignee")).alias("assignee"))


@query("SELECT 'Plan' AS title, 'x' AS tag")
def src16_markdown_tree(s, d):
    path = _scratch(s)
    s.createDataFrame([("---\ntag: x\n---\n# Plan\ntext",)], "value string").coalesce(1).write.text(f"{path}/a")
    found = s.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/a").select(F.decode("content", "utf-8").alias("t"))
    return found.select(sources.heading(F.col("t")).alias("title"), sources.frontmatter(F.col("t"))["tag"].alias("tag"))


@query("SELECT event_id, level FROM v_logs")
def src12_jsonl_bad_lines(s, d):
    path = _scratch(s)
    good = v.logs(s, d).select(F.to_json(F.struct("event_id", "level", "type")).alias("value"))
    good.unionByName(s.createDataFrame([("not json",), ('{"a":',)], "value string")).write.text(path)
    return sources.load(s, "jsonl", path, schema="event_id long, level string, type string").select("event_id", "level")


@query("SELECT page_id, title, version FROM v_pages")
def snk09_json_export(s, d):
    path = _scratch(s)
    rows = v.pages(s, d).select("page_id", "title", "version")
    rows.write.json(path)
    return s.read.schema(rows.schema).json(path)


@query("SELECT space_key, concat('| ', space_key, ' | ', count(*), ' |') AS line FROM v_pages GROUP BY 1")
def snk13_report_lines(s, d):
    return v.pages(s, d).groupBy("space_key").agg(F.count(F.lit(1)).alias("n")).select("space_key", F.concat(F.lit("| "), "space_key", F.lit(" | "), "n", F.lit(" |")).alias("line"))


@query()
def rsh08_block_kinds(s, d):
    blocks = doc.column(doc.html_blocks, doc.COLUMNS["html_blocks"][1])
    return v.table(s, d, "pages").select(F.explode(blocks("html")).alias("b")).groupBy("b.type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("b.text")).alias("chars"))


@query("SELECT s_suppkey, concat('Say ', s_suppkey) AS said FROM supplier")
def str28_comment_texts(s, d):
    adf = F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"Say "},{"type":"mention","attrs":{"text":"'), "s_suppkey", F.lit('"}}]}]}'))
    blocks = doc.column(doc.adf_blocks, doc.COLUMNS["adf_blocks"][1])
    return v.table(s, d, "supplier").select("s_suppkey", F.array_join(blocks(adf)["text"], "\n").alias("said"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS image, s_suppkey % 3 = 1 AS markdown FROM supplier")
def str23_path_kinds(s, d):
    path = F.expr("element_at(array('a/b.PNG?x', 'a/c.md#h', 'a/d.txt'), cast(s_suppkey % 3 as int) + 1)")
    return v.table(s, d, "supplier").select("s_suppkey", path.rlike(r"(?i)\.(png|jpe?g|gif|svg|webp)([?#].*)?$").alias("image"), path.rlike(r"(?i)\.md([?#].*)?$").alias("markdown"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'no-provider' WHEN 2 THEN 'search' ELSE 'issues' END AS kind FROM supplier")
def qry07_source_envelopes(s, d):
    text = F.expr("""CASE s_suppkey % 4 WHEN 0 THEN '{bad' WHEN 1 THEN '{"id": ""}' WHEN 2 THEN '{"id": "content-search", "parameters": {}}' ELSE '{"id": "issue-table", "parameters": {"query": "x = 1"}}' END""")
    found = F.get_json_object(text, "$.id")
    kind = F.when(F.try_parse_json(text).isNull(), "parse").when(F.coalesce(found, F.lit("")) == "", "no-provider").when(found == "content-search", "search").otherwise("issues")
    return v.table(s, d, "supplier").select("s_suppkey", kind.alias("kind"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 2 END AS n, CASE s_suppkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'M' END AS unit FROM supplier")
def dat16_tick_units(s, d):
    text = F.expr("element_at(array('15d', '2M', 'x3'), cast(s_suppkey % 3 as int) + 1)")
    unit = F.nullif(F.regexp_extract(text, "^[0-9]+([yMdhmsu])$", 1), F.lit(""))
    return v.table(s, d, "supplier").select("s_suppkey", F.regexp_extract(text, "^([0-9]+)[yMdhmsu]$", 1).try_cast("int").alias("n"), unit.alias("unit"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def dat13_absolute_dates(s, d):
    text = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00Z') ELSE 'now(-7d)' END")
    return v.table(s, d, "orders").select("o_orderkey", F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("day"))


@query("SELECT event_id, ts - INTERVAL 45 MINUTE AS since FROM events")
def dat11_log_since(s, d):
    from tessera.functions.times import relative_period

    return v.table(s, d, "events").select("event_id", relative_period(F.lit("45m"), F.col("ts").cast("timestamp"), minutes=True).alias("since"))


@query("SELECT page_id, upper(title) AS title FROM v_pages WHERE page_id % 2 = 0")
def udf02_renderers(s, d):
    from tessera.functions.extensions import Extensions

    x = Extensions()
    x.renderer("page-list")(lambda df: None)
    x.renderer("page-list")(lambda df: df.filter("page_id % 2 = 0").select("page_id", F.upper("title").alias("title")))
    return x.render("Page-List", v.pages(s, d))


@query("SELECT s_suppkey, concat('a-', s_suppkey) AS slug FROM supplier")
def udf04_sql_helpers(s, d):
    from tessera.functions.extensions import register_helpers

    register_helpers(s)
    v.table(s, d, "supplier").createOrReplaceTempView("extension_suppliers")
    return s.sql("SELECT s_suppkey, heading_slug(concat('A ', s_suppkey)) AS slug FROM extension_suppliers")
