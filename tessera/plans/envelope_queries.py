"""Queries of data-source links: their envelopes, providers and rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import envelopes as env
from tessera.plans import views as v
from tessera.plans.register import query

_VIEWS = '"views":[{"type":"table","properties":{"columns":[{"key":"key"},{"key":" title "},{"width":3}]}}]'
#: Envelopes by the document's id, with the reason, code, macro and query that they have. ``#`` stands for a number.
_CASES = [
    (f'{{"id":"{env.ISSUES}","parameters":{{"jql":"project = P# ORDER BY  created"}},{_VIEWS}}}', None, None, "issue-list", "project = P# ORDER BY  created"),
    (f'{{"id":"{env.ISSUES}","parameters":{{"filter":"1#"}},{_VIEWS}}}', None, "datasource-filter-unsupported", None, None),
    (f'{{"id":" {env.CONTENT.upper()} ","parameters":{{"spaceKeys":["en","de"],"labels":["src#"],"searchString":""}},{_VIEWS}}}', None, None, "content-list", 'space in ("en","de") AND label in ("src#")'),
    (f'{{"id":"{env.CONTENT}","parameters":{{"entityTypes":["Blog","page"],"lastModified":{{"from":"2000-0#-01T00:00"}},"labels":[]}},{_VIEWS}}}', None, None, "content-list", 'type in ("blogpost","page") AND lastmodified >= "2000-0#-01"'),
    (f'{{"id":"{env.CONTENT}","parameters":{{"searchString":"page 1#","shouldMatchTitleOnly":true}},{_VIEWS}}}', None, None, "content-list", 'title ~ "page 1#"'),
    (f'{{"id":"{env.CONTENT}","parameters":{{"spaceKeys":["en"],"moods":["calm"]}},{_VIEWS}}}', None, "datasource-filter-unsupported", None, None),
    (f'{{"id":"{env.CONTENT}","parameters":{{"searchString":" ","cloudId":"c","moods":[null,{{"a":""}}]}},{_VIEWS}}}', None, "datasource-query-empty", None, None),
    (f'{{"id":"{env.ASSETS}","parameters":{{"aql":"x"}},{_VIEWS}}}', None, "datasource-provider-unsupported", None, None),
    (f'{{"id":"new-#","parameters":{{}},{_VIEWS}}}', None, "datasource-provider-unknown", None, None),
    ('{"id":"x","parameters":', "not-json", "datasource-invalid", None, None),
    ('[{"id":"x"}]', "not-object", "datasource-invalid", None, None),
    (f'{{"id":"x","extra":1,"parameters":{{}},{_VIEWS}}}', "unexpected-key", "datasource-invalid", None, None),
    (f'{{"id":7,"parameters":{{}},{_VIEWS}}}', "bad-id", "datasource-invalid", None, None),
    (f'{{"id":"x","parameters":[1],{_VIEWS}}}', "bad-parameters", "datasource-invalid", None, None),
    ('{"id":"x","parameters":{},"views":[{"type":"table"},{"type":3}]}', "bad-views", "datasource-invalid", None, None),
    (f'{{"id":"{env.ISSUES}","parameters":{{"jql":"x"}},"views":[{{"type":"list"}}]}}', None, "datasource-invalid", None, None),
]


def _links(s, d):
    """A link of each document; every third has its entities encoded."""
    doc = v.table(s, d, "documents").select(F.col("doc_id").alias("link_id"))
    text = F.element_at(F.array(*(F.lit(c[0]) for c in _CASES)), (F.col("link_id") % len(_CASES)).cast("int") + 1)
    text = F.replace(text, F.lit("#"), (F.col("link_id") % 5 + 1).cast("string"))
    encoded = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return doc.select("link_id", F.when(F.col("link_id") % 3 == 0, encoded).otherwise(text).alias("raw"))


def _case(column: int) -> str:
    said = " ".join(f"WHEN {i} THEN replace('{c[column]}', '#', CAST(doc_id % 5 + 1 AS VARCHAR))" for i, c in enumerate(_CASES) if c[column] is not None)
    return f"CASE doc_id % {len(_CASES)} {said} END"


@query(f"SELECT doc_id AS link_id, {_case(1)} AS reason FROM documents")
def qry07_envelope_reasons(s, d):
    return env.parsed(_links(s, d), "raw").select("link_id", "reason")


@query(f"SELECT doc_id AS link_id, {_case(2)} AS code, {_case(3)} AS macro, {_case(4)} AS query, CASE WHEN doc_id % {len(_CASES)} = 8 THEN concat('new-', doc_id % 5 + 1) ELSE {_case(1)} END AS note FROM documents")
def qry09_provider_outcomes(s, d):
    return env.outcomes(env.parsed(_links(s, d), "raw")).select("link_id", "code", "macro", "query", "note")


_CONTENT_SQL = f"""WITH q AS (SELECT doc_id AS link_id, doc_id % {len(_CASES)} AS k, doc_id % 5 + 1 AS n FROM documents WHERE doc_id % {len(_CASES)} IN (2, 3, 4)),
  m AS (SELECT DISTINCT q.k, q.n, p.page_id FROM (SELECT DISTINCT k, n FROM q) AS q JOIN v_pages AS p ON
    (q.k = 2 AND p.space_key IN ('en', 'de') AND p.page_id IN (SELECT page_id FROM v_labels WHERE label = concat('src', q.n))) OR
    (q.k = 3 AND p.content_type IN ('blogpost', 'page') AND p.last_modified >= CAST(concat('2000-0', q.n, '-01') AS DATE)) OR
    (q.k = 4 AND p.title = concat('Page 1', q.n))),
  r AS (SELECT k, n, page_id, row_number() OVER (PARTITION BY k, n ORDER BY page_id) AS place, count(*) OVER (PARTITION BY k, n) > 100 AS more FROM m)
  SELECT q.link_id, 'content-list' AS macro, CAST(r.page_id AS VARCHAR) AS row_id, CAST(r.place AS INTEGER) AS place, r.more FROM q JOIN r ON q.k = r.k AND q.n = r.n WHERE r.place <= 100"""


@query(_CONTENT_SQL + f""" UNION ALL SELECT l.doc_id, 'issue-list', issue_key, CAST(place AS INTEGER), more FROM documents AS l JOIN (SELECT 'P' || (issue_id % 40) AS project, issue_key, row_number() OVER (PARTITION BY issue_id % 40 ORDER BY issue_id) AS place, count(*) OVER (PARTITION BY issue_id % 40) > 20 AS more FROM v_issues) AS i
  ON l.doc_id % {len(_CASES)} = 0 AND i.project = concat('P', l.doc_id % 5 + 1) AND i.place <= 20""")
def qry09_dispatched_rows(s, d):
    """Rows of both providers: pages by their conditions, issues by the project that a query begins with (20 of each)."""
    found = env.outcomes(env.parsed(_links(s, d), "raw"))
    pages, labels = v.pages(s, d), v.labels(s, d)

    def issues(asked):
        own = v.issues(s, d).withColumn("project", F.concat(F.lit("P"), F.col("issue_id") % 40))
        ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("issue_id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("project"))).filter("place <= 20")
        wanted = asked.select("query", F.regexp_extract("query", r"^project = (\w+)", 1).alias("project")).distinct()
        return wanted.join(ranked, "project").select("query", F.col("issue_key").alias("row_id"), "place", (F.col("n") > 20).alias("more"))

    return env.dispatched(found, "link_id", {"content-list": lambda asked: env.content_rows(asked, pages, labels), "issue-list": issues})
