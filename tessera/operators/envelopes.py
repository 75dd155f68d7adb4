"""Data-source links: typed envelopes, providers, and the rows that each provider's source has for them.

An envelope is the JSON of a link (``id``, ``parameters``, ``views``), maybe with its entities still encoded: what
is no JSON is decoded once and read again. Each envelope ends in one outcome: a query for its provider, or a code
that says why it stays a link. A filter that is not understood refuses the whole query, as leaving it out would
give more rows than were asked for. Everything is column functions on variants; only texts that were no JSON at
first go through a decoder in Arrow batches.

Dispatch sends each provider's different queries to its own source and unites the rows. Queries meet pages by
equal keys (a space, a label, a word of a text), never pair by pair.

Defined cases: a null or empty text is no JSON; an object that names a key twice is none either; equal queries are
asked once; a query of many matches gives its first ``cap`` and says that there are more.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.documents import column
from tessera.operators.ranks import saved

#: The keys of an envelope; provider, label, state and what its queries are rendered as.
KEYS = ("id", "parameters", "views")
ISSUES, ASSETS, CONTENT = "d8b75300-dfda-4519-b6cd-e49abbd50401", "361d618a-3c04-40ad-9b27-3c8ea6927020", "768fc736-3af4-4a8f-b27e-203602bff8ca"
PROVIDERS = {ISSUES: ("work items", "supported", "issue-list"), ASSETS: ("assets", "known-unsupported", None), CONTENT: ("content search", "supported", "content-list")}
#: List filters of a content search in the order of the query's parts, and its further parameters.
LISTS = {"entityTypes": "type", "spaceKeys": "space", "labels": "label", "ancestorPageIds": "ancestor", "creatorAccountIds": "creator", "contributorAccountIds": "contributor"}
OTHER = ("cloudId", "searchString", "shouldMatchTitleOnly", "contentStatuses", "contentARIs", "lastModified")
TYPES = ("page", "blogpost", "attachment", "comment", "whiteboard", "database", "embed", "folder")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _of(name: str, c: str = "parameters") -> Column:
    return F.expr(f"try_variant_get({c}, '$.{name}', 'variant')")


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, VOID (a JSON null) or a kind of number; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def parsed(links: DataFrame, text: str) -> DataFrame:
    """``links`` with reason, id, parameters (a variant) and columns.

    reason is null, ``not-json``, ``not-object``, ``unexpected-key``, ``bad-id``, ``bad-parameters`` or ``bad-views``;
    columns are those of the first view that is a table, and null without one.
    """
    first = links.withColumn("_text", _trimmed(F.coalesce(text, F.lit("")))).withColumn("_v", F.try_parse_json("_text"))
    decode = column(html.unescape, "string")
    again = first.filter("_v is null").withColumn("_text", decode("_text")).withColumn("_v", F.try_parse_json("_text"))
    read = first.filter("_v is not null").unionByName(again)
    views = F.expr("try_variant_get(_v, '$.views', 'array<variant>')")
    typed = lambda x: (_kind(x) == "OBJECT") & (F.coalesce(_kind(F.try_variant_get(x, "$.type", "variant")), F.lit("")) == "STRING")
    own = F.try_variant_get("_v", "$.id", "string")
    reason = (
        F.when(F.col("_v").isNull(), "not-json").when(_kind(F.col("_v")) != "OBJECT", "not-object")
        .when(F.size(F.array_except(F.json_object_keys("_text"), F.array(*map(F.lit, KEYS)))) > 0, "unexpected-key")
        .when((F.coalesce(_kind(_of("id", "_v")), F.lit("")) != "STRING") | (_trimmed(own) == ""), "bad-id")
        .when(F.coalesce(_kind(_of("parameters", "_v")), F.lit("")) != "OBJECT", "bad-parameters")
        .when((F.coalesce(_kind(_of("views", "_v")), F.lit("")) != "ARRAY") | (F.coalesce(F.size(views), F.lit(0)) == 0) | ~F.coalesce(F.forall(views, typed), F.lit(False)), "bad-views")
    )
    table = F.try_element_at(F.filter(views, lambda x: F.try_variant_get(x, "$.type", "string") == "table"), F.lit(1))
    listed = F.coalesce(F.try_variant_get(table, "$.properties.columns", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    key = lambda x: F.when((_kind(x) == "OBJECT") & (F.coalesce(_kind(F.try_variant_get(x, "$.key", "variant")), F.lit("")) == "STRING"), _trimmed(F.try_variant_get(x, "$.key", "string")))
    columns = F.when(table.isNotNull(), F.filter(F.transform(listed, key), lambda x: x.isNotNull() & (x != "")))
    # Saved, as each of these is asked for many times: plans hold them once.
    fine = saved(read.select(*links.columns, reason.alias("reason"), _trimmed(own).alias("id"), _of("parameters", "_v").alias("parameters"), columns.alias("columns"), F.json_object_keys(F.get_json_object("_text", "$.parameters")).alias("_keys")))
    return fine.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("id", "parameters", "columns", "_keys")})


def _text_of(name: str) -> Column:
    """A parameter that is a text with something in it."""
    v = F.try_variant_get("parameters", f"$.{name}", "string")
    return F.when((_kind(_of(name)) == "STRING") & (_trimmed(v) != ""), v)


def _list_of(name: str) -> Column:
    """The texts of a parameter that is a list with at least one."""
    items = F.transform(F.expr(f"try_variant_get(parameters, '$.{name}', 'array<variant>')"), lambda x: F.when(_kind(x) == "STRING", _trimmed(F.try_variant_get(x, "$", "string"))))
    items = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.when((_kind(_of(name)) == "ARRAY") & (F.size(items) > 0), items)


def _meant(v: Column) -> Column:
    """Whether a value would narrow a search: anything but null, false, blank texts and what holds only these."""
    rest = F.to_json(v)
    for pattern, by in ((r'"(?:\\.|[^"\\])*"\s*:', ""), (r'"(?:\s|\\[ntrf])*"', ""), (r"\b(?:null|false)\b(?=\s*(?:[,\]}]|$))", ""), (r"[\[\]{},\s]", "")):
        rest = F.regexp_replace(rest, pattern, by)
    return v.isNotNull() & (F.coalesce(rest, F.lit("")) != "")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x1F\x7F-\x9F]", ""), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _day(name: str) -> Column:
    v = _trimmed(F.when(_kind(_of(f"lastModified.{name}")) == "STRING", F.try_variant_get("parameters", f"$.lastModified.{name}", "string")))
    return F.nullif(F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1), F.lit(""))


def _types() -> Column:
    """The asked types in the search's spelling."""
    return F.transform(_list_of("entityTypes"), lambda x: F.when(F.lower(x) == "blog", "blogpost").otherwise(F.lower(x)))


def content_query() -> tuple[Column, Column]:
    """(query, refused): the text of a content search, or the code of why there is none."""
    lists = {p: _types() if p == "entityTypes" else _list_of(p) for p in LISTS}
    in_ = lambda field, values: F.concat(F.lit(f"{field} in ("), F.array_join(F.transform(values, lambda x: F.concat(F.lit('"'), escaped(x), F.lit('"'))), ","), F.lit(")"))
    said = _text_of("searchString")
    title_only = F.coalesce(F.try_variant_get("parameters", "$.shouldMatchTitleOnly", "boolean"), F.lit(False)) & (_kind(_of("shouldMatchTitleOnly")) == "BOOLEAN")
    parts = [F.concat(F.when(title_only, "title").otherwise("text"), F.lit(' ~ "'), escaped(said), F.lit('"')), *(in_(f, lists[p]) for p, f in LISTS.items())]
    parts += [F.concat(F.lit('lastmodified >= "'), _day("from"), F.lit('"')), F.concat(F.lit('lastmodified <= "'), _day("to"), F.lit('"'))]
    query = F.nullif(F.concat_ws(" AND ", *parts), F.lit(""))
    window = _of("lastModified")
    unsupported = [
        _meant(_of("contentARIs")), *(lists[p].isNull() & _meant(_of(p)) for p in LISTS),
        F.coalesce(F.exists(_types(), lambda x: ~x.isin(*TYPES)), F.lit(False)),
        _meant(window) & ((_kind(window) != "OBJECT") | (_of("lastModified.from").isNotNull() & _day("from").isNull()) | (_of("lastModified.to").isNotNull() & _day("to").isNull())),
        F.exists(F.array_except("_keys", F.array(*map(F.lit, (*LISTS, *OTHER)))), lambda k: _meant(F.expr("try_variant_get(parameters, '$', 'map<string,variant>')")[k])),
    ]
    refused = F.when(reduce(Column.__or__, [F.coalesce(u, F.lit(False)) for u in unsupported]), "datasource-filter-unsupported").when(query.isNull(), "datasource-query-empty")
    return query, refused


def outcomes(read: DataFrame) -> DataFrame:
    """``read`` with provider, code, macro and query of each link: a macro and its query, or a code and a note."""
    at = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, p in PROVIDERS.items() for x in (k, p[i]))), F.lower("id"))
    issues, filtered = _text_of("jql"), _text_of("filter")
    content, refused = content_query()
    known = F.lower("id")
    code = (
        F.when(F.col("reason").isNotNull(), "datasource-invalid").when(at(1).isNull(), "datasource-provider-unknown").when(F.col("columns").isNull(), "datasource-invalid")
        .when(at(1) != "supported", "datasource-provider-unsupported")
        .when((known == ISSUES) & issues.isNull(), F.when(filtered.isNotNull(), "datasource-filter-unsupported").otherwise("datasource-invalid"))
        .when(known == CONTENT, refused)
    )
    coded = saved(read.select("*", at(0).alias("provider"), at(2).alias("_macro"), code.alias("code"), F.when(known == ISSUES, issues).when(known == CONTENT, content).alias("_query")))
    said = lambda c: F.when(F.col("code").isNull(), F.col(c))
    note = F.when(F.col("code") == "datasource-provider-unknown", F.col("id")).when(F.col("reason").isNotNull(), F.col("reason"))
    return coded.withColumns({"macro": said("_macro"), "query": said("_query"), "note": note}).drop("_macro", "_query")


def content_conditions(asked: DataFrame) -> DataFrame:
    """(query, kind, value) of content searches: a page must meet each kind by one of its values. Each word of a text is a kind."""
    words = F.filter(F.split(F.lower(F.coalesce(_text_of("searchString"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    field = F.when(F.coalesce(F.try_variant_get("parameters", "$.shouldMatchTitleOnly", "boolean"), F.lit(False)), "title").otherwise("text")
    one = lambda kind, values: F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(kind).alias("field"), x.alias("value")))
    parts = [one(f, _types() if p == "entityTypes" else _list_of(p)) for p, f in LISTS.items()]
    said = F.transform(F.array_distinct(words), lambda w: F.struct(F.concat(field, F.lit(":"), w).alias("kind"), field.alias("field"), w.alias("value")))
    return asked.select("query", F.explode(F.concat(*parts, said)).alias("c")).select("query", "c.kind", "c.field", "c.value").distinct()


def page_keys(pages: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """(page_id, field, value) of what pages can be asked for: only the fields that are."""
    word = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    texts = lambda c: F.transform(c, lambda x: x.cast("string"))
    own = {
        "type": F.array("content_type"), "space": F.array("space_key"), "ancestor": texts(F.col("ancestors")), "creator": F.array("created_by"),
        "contributor": F.array("created_by", "last_modified_by"), "title": word(F.col("title")), "text": word(F.concat_ws(" ", "title", "body") if "body" in pages.columns else F.col("title")),
    }
    out = [pages.select("page_id", F.lit(f).alias("field"), F.explode(F.array_distinct(own[f])).alias("value")) for f in fields if f in own]
    if "label" in fields:
        out.append(labels.select("page_id", F.lit("label").alias("field"), F.col("label").alias("value")).distinct())
    return reduce(DataFrame.unionByName, out) if out else pages.select("page_id", F.lit("").alias("field"), F.lit("").alias("value")).limit(0)


def content_rows(asked: DataFrame, pages: DataFrame, labels: DataFrame, cap: int = 100) -> DataFrame:
    """(query, row_id, place, more) of the pages that each content search finds, by page id; ``more`` where the cap cuts.

    A condition's values meet the pages' by equality; a page is found where it meets as many kinds as a query has.
    """
    asked = asked.dropDuplicates(["query"])
    conditions = content_conditions(asked)
    kinds = conditions.groupBy("query").agg(F.count_distinct("kind").alias("kinds"))
    keys = page_keys(pages, labels, ["type", "space", "label", "ancestor", "creator", "contributor", "title", "text"])
    wanted = F.broadcast(conditions.select("field").distinct())  # eight fields at most
    met = conditions.join(keys.join(wanted, "field", "left_semi"), ["field", "value"]).groupBy("query", "page_id").agg(F.count_distinct("kind").alias("kinds"))
    within = asked.select("query", _day("from").alias("from_day"), _day("to").alias("to_day"))
    full = met.join(kinds, ["query", "kinds"]).join(within, "query").join(pages.select("page_id", F.to_date("last_modified").alias("day")), "page_id")
    kept = full.filter((F.col("from_day").isNull() | (F.col("day") >= F.to_date("from_day"))) & (F.col("to_day").isNull() | (F.col("day") <= F.to_date("to_day"))))
    first = kept.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    ranked = kept.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("page_id"))).filter(F.col("place") <= cap)
    return ranked.join(first, "query").select("query", F.col("page_id").cast("string").alias("row_id"), "place", (F.col("n") > cap).alias("more"))


Handler = Callable[[DataFrame], DataFrame]


def dispatched(found: DataFrame, key: str, handlers: dict[str, Handler]) -> DataFrame:
    """(key, macro, row_id, place, more) of all links whose macro has a handler.

    A handler gets the different queries of its macro once, as rows with ``query`` and ``parameters``, and returns
    (query, row_id, place, more).
    """
    out = []
    for macro, handler in handlers.items():
        asked = found.filter(F.col("macro") == macro)
        rows = handler(asked.select("query", "parameters", "columns"))
        out.append(asked.select(key, "macro", "query").join(rows, "query").select(key, "macro", "row_id", "place", "more"))
    return reduce(DataFrame.unionByName, out)
