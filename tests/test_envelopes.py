"""Envelopes of data-source links against a plain reader, and refusals by hand."""

import html
import json
import random

from pyspark.sql import functions as F

from tessera.operators import envelopes as env


def plain(raw):
    """(reason, columns) of one envelope."""
    raw = (raw or "").strip()
    try:
        v = json.loads(raw)
    except ValueError:
        try:
            v = json.loads(html.unescape(raw))
        except ValueError:
            return "not-json", None
    if not isinstance(v, dict):
        return "not-object", None
    if set(v) - {"id", "parameters", "views"}:
        return "unexpected-key", None
    if not isinstance(v.get("id"), str) or not v["id"].strip():
        return "bad-id", None
    if not isinstance(v.get("parameters"), dict):
        return "bad-parameters", None
    views = v.get("views")
    if not isinstance(views, list) or not views or not all(isinstance(x, dict) and isinstance(x.get("type"), str) for x in views):
        return "bad-views", None
    table = next((x for x in views if x["type"] == "table"), None)
    if table is None:
        return None, None
    columns = table.get("properties", {}).get("columns", []) if isinstance(table.get("properties", {}), dict) else []
    return None, [c["key"].strip() for c in columns if isinstance(c, dict) and isinstance(c.get("key"), str) and c["key"].strip()] if isinstance(columns, list) else []


def test_reasons_and_columns(spark):
    r = random.Random(4)
    values = [None, 1, 1.5, True, "", " ", "x", " y ", [], {}, [1], ["a"], {"a": 1}]
    columns = [[{"key": "k"}], [{"key": " k "}, {"key": ""}, {"key": 3}, "s", None], [], "s", None]
    rows = ["", None, "{", "null", "3", '"text"', "[]", "{}", "&#123;}", "&lt;"]
    for _ in range(400):
        view = r.choice([[{"type": "table", "properties": {"columns": r.choice(columns)}}], [{"type": "list"}], [{"type": "list"}, {"type": "table"}], r.choice(values)])
        v = {"id": r.choice(["x", " x ", r.choice(values)]), "parameters": r.choice([{}, {"a": r.choice(values)}, r.choice(values)]), "views": view}
        for k in list(v):
            if r.random() < 0.08:
                del v[k]
        if r.random() < 0.08:
            v["more"] = 1
        text = json.dumps(v)
        rows.append(html.escape(text) if r.random() < 0.3 else f" {text}\n" if r.random() < 0.2 else text)
    read = env.parsed(spark.createDataFrame(list(enumerate(rows)), "link_id long, raw string"), "raw")
    got = {x["link_id"]: (x["reason"], x["columns"]) for x in read.select("link_id", "reason", "columns").collect()}
    assert {i: got[i] for i in range(len(rows))} == {i: plain(t) for i, t in enumerate(rows)}


def outcome(spark, parameters, provider=env.CONTENT):
    docs = [(i, json.dumps({"id": provider, "parameters": p, "views": [{"type": "table"}]})) for i, p in enumerate(parameters)]
    found = env.outcomes(env.parsed(spark.createDataFrame(docs, "link_id long, raw string"), "raw")).orderBy("link_id").collect()
    return [r["query"] or r["code"] for r in found]


def test_what_content_searches_become(spark):
    unsupported, empty = "datasource-filter-unsupported", "datasource-query-empty"
    cases = [
        ({"contributorAccountIds": ["u1"], "searchString": ""}, 'contributor in ("u1")'), ({"searchString": 'a"b\\c\n'}, 'text ~ "a\\"b\\\\c"'), ({"shouldMatchTitleOnly": True}, empty),
        ({"contentARIs": ["x"], "spaceKeys": ["S"]}, unsupported), ({"contentARIs": [], "spaceKeys": ["S"]}, 'space in ("S")'), ({"spaceKeys": "S"}, unsupported), ({"spaceKeys": [" ", 3]}, unsupported),
        ({"spaceKeys": [" "], "labels": ["a"]}, 'label in ("a")'), ({"entityTypes": ["Blog", "PAGE"]}, 'type in ("blogpost","page")'), ({"entityTypes": ["video"]}, unsupported),
        ({"lastModified": {"from": "2024-01-02", "to": "2024-02-03 10:00"}}, 'lastmodified >= "2024-01-02" AND lastmodified <= "2024-02-03"'), ({"lastModified": {"from": "-7d"}}, unsupported),
        ({"lastModified": "today"}, unsupported), ({"lastModified": {}}, empty), ({"contentStatuses": ["archived"]}, empty), ({"labels": ["a"], "mood": False, "tone": [None, {"x": ""}]}, 'label in ("a")'),
        ({"labels": ["a"], "mood": 0}, unsupported), ({"labels": ["a"], "mood": {"x": [{"y": "z"}]}}, unsupported), ({}, empty),
    ]
    assert outcome(spark, [p for p, _ in cases]) == [w for _, w in cases]


def test_issue_queries_pass_as_they_are(spark):
    assert outcome(spark, [{"jql": ' a  = "b" ORDER BY x '}, {"filter": "7"}, {"jql": " "}], env.ISSUES) == [' a  = "b" ORDER BY x ', "datasource-filter-unsupported", "datasource-invalid"]


def test_a_search_of_more_than_the_cap(spark):
    pages = spark.createDataFrame([(i, f"Note {i % 2}", "S", "page", "u", None, [], None) for i in range(30)], "page_id long, title string, space_key string, content_type string, created_by string, last_modified_by string, ancestors array<long>, last_modified timestamp")
    labels = spark.createDataFrame([(i, "a") for i in range(0, 30, 3)], "page_id long, label string")
    docs = [(1, json.dumps({"id": env.CONTENT, "parameters": {"searchString": "NOTE, 1", "labels": ["a", "b"]}, "views": [{"type": "table"}]})), (2, json.dumps({"id": env.CONTENT, "parameters": {"searchString": "none such"}, "views": [{"type": "table"}]}))]
    found = env.outcomes(env.parsed(spark.createDataFrame(docs, "link_id long, raw string"), "raw"))
    rows = env.dispatched(found, "link_id", {"content-list": lambda asked: env.content_rows(asked, pages, labels, cap=3)}).orderBy("place").collect()
    assert [(r["link_id"], r["row_id"], r["more"]) for r in rows] == [(1, "3", True), (1, "9", True), (1, "15", True)]
    assert found.filter(F.col("code").isNull()).count() == 2
