"""Storage and HTML texts as a table of nodes, and what is asked of it: verdicts, blocks, links.

A text becomes rows once, in the task that reads it; everything else is joins and groups on these rows. A page
whose text breaks the budget has its verdict and no nodes.

Defined cases: a null text is an empty one; an empty text is ``ok`` without nodes; page ids may repeat only if
their rows are to be taken together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.markup import CONTAINERS, Budget, read_nodes

NODES = "at int, parent int, last int, depth int, kind string, name string, attrs map<string,string>, text string, run int, link int"
_ARROW = [
    ("at", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("run", pa.int32()), ("link", pa.int32()),
]


def nodes_of(pages: DataFrame, text: str, budget: Budget = Budget(), rows: int = 20_000) -> DataFrame:
    """page_id and the nodes of each page's text, and a row of kind ``page`` with its verdict, number of nodes and depth.

    Batches of ``rows`` leave the task one by one, so a page of millions of nodes is no larger batch than others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0

            def out() -> pa.RecordBatch:
                at = pa.array([i for i, n in ids for _ in range(n)], pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, t) for c, (_, t) in zip(zip(*held), _ARROW))], ["page_id", *(n for n, _ in _ARROW)])

            for i, source in enumerate(batch.column(1).to_pylist()):
                verdict, nodes = read_nodes(source or "", budget)
                found = [(0, None, len(nodes), max((n.depth for n in nodes if n.text is None), default=0), "page", verdict, None, None, None, None)]
                found += [(n.at, n.parent, n.last, n.depth, "text" if n.attrs is None else "element", n.name, None if n.attrs is None else list(n.attrs.items()), n.text, n.run, n.link) for n in nodes]
                for begin in range(0, len(found), rows):
                    part = found[begin : begin + rows]
                    ids.append((i, len(part)))
                    held += part
                    size += len(part)
                    if size >= rows:
                        yield out()
                        ids, held, size = [], [], 0
            if held:
                yield out()

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", text).mapInArrow(run, f"page_id {kind}, {NODES}")


def verdicts(nodes: DataFrame) -> DataFrame:
    """(page_id, verdict, nodes, depth): ``ok``, ``too-many-nodes``, ``too-deep`` or ``text-too-long`` for every page."""
    return nodes.filter("kind = 'page'").select("page_id", F.col("name").alias("verdict"), F.col("last").alias("nodes"), "depth")


def _said(text: Column, at: Column) -> Column:
    """The texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), text.alias("text")))), lambda x: x["text"]), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """(page_id, place, kind, text): what stands in one block without a block in between, with white space made one space."""
    spoken = nodes.filter("kind = 'text' or name = 'br'").withColumn("said", F.when(F.col("kind") == "text", F.col("text")).otherwise("\n"))
    grouped = spoken.groupBy("page_id", "run").agg(_said(F.col("said"), F.col("at")).alias("text"), F.min_by("name", F.when(F.col("kind") == "text", F.col("at"))).alias("kind"), F.min("at").alias("place"))
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return grouped.select("page_id", "place", F.coalesce("kind", F.lit("")).alias("kind"), text.alias("text")).filter("text <> ''")


def links(nodes: DataFrame) -> DataFrame:
    """(page_id, at, kind, target_id, space_key, title, filename, url, anchor, text) of each link and attached image.

    ``internal`` links have a page's id or title, ``attachment`` a file name, ``external`` a shortcut or an
    address, ``anchor`` a place on the same page; links to users and addresses of other kinds are none. What a
    link leads to and says are the nodes whose nearest link it is.
    """
    attr = lambda c, name: F.nullif(F.try_element_at(c, F.lit(name)), F.lit(""))
    first = lambda name: F.min_by("attrs", F.when(F.col("name") == name, F.col("at")))
    inside = nodes.filter("link > 0").groupBy("page_id", "link").agg(
        F.bool_or(F.col("name") == "ri:user").alias("user"), first("ri:page").alias("page"), first("ri:attachment").alias("attachment"), first("ri:shortcut").alias("shortcut"),
        first("ri:anchor").alias("anchor_of"),
        F.nullif(F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("at", "text")))), lambda x: x["text"]), ""), r"^\s+|\s+$", "")), F.lit("")).alias("text"),
    )
    own = nodes.filter(F.col("name").isin(*CONTAINERS) & (F.col("kind") == "element")).select("page_id", F.col("at").alias("link"), "name", F.col("attrs").alias("own"))
    met = own.join(inside, ["page_id", "link"], "left")
    page_id, title, href = attr("page", "ri:content-id"), attr("page", "ri:content-title"), attr("own", "href")
    filename, shortcut = attr("attachment", "ri:filename"), attr("shortcut", "ri:value")
    is_link = (F.col("name") == "ac:link") & ~F.coalesce("user", F.lit(False))
    kind = (
        F.when(is_link & F.col("page").isNotNull(), F.when(page_id.isNotNull() | title.isNotNull(), "internal"))
        .when(is_link & F.col("attachment").isNotNull(), F.when(filename.isNotNull(), "attachment"))
        .when(is_link & shortcut.isNotNull(), "external")
        .when((F.col("name") == "a") & href.startswith("#"), "anchor")
        .when((F.col("name") == "a") & href.rlike("^(https?://|mailto:)"), "external")
        .when((F.col("name") == "ac:image") & filename.isNotNull(), "attachment")
    )
    of = lambda wanted, c: F.when(F.col("kind") == wanted, c)
    return met.withColumn("kind", kind).filter("kind is not null").select(
        "page_id", F.col("link").alias("at"), "kind", of("internal", page_id).alias("target_id"), of("internal", attr("page", "ri:space-key")).alias("space_key"), of("internal", title).alias("title"),
        of("attachment", filename).alias("filename"), of("external", F.when(F.col("name") == "a", href).otherwise(shortcut)).alias("url"),
        F.when(F.col("kind") == "anchor", F.substring(href, F.lit(2), F.length(href))).when(F.col("kind") == "internal", F.coalesce(attr("anchor_of", "ri:anchor"), attr("page", "ri:anchor"))).alias("anchor"),
        F.when(F.col("name") != "ac:image", F.col("text")).alias("text"),
    )


def resolved_links(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links with the page they lead to: by id, else by title (of equal titles the least id, of the link's space if it names one); ``broken`` where there is none.

    Two equi-joins; a title that many pages share is one row of the aggregated side.
    """
    internal = found.filter("kind = 'internal'")
    by_id = pages.select(F.col("page_id").cast("string").alias("target_id"), F.col("page_id").alias("to_id"))
    in_space = pages.groupBy("title", "space_key").agg(F.min("page_id").alias("to_title"))
    anywhere = pages.groupBy("title").agg(F.min("page_id").alias("to_any"))
    met = internal.join(by_id, "target_id", "left").join(in_space, ["title", "space_key"], "left").join(anywhere, "title", "left")
    target = F.when(F.col("target_id").isNotNull(), F.col("to_id")).when(F.col("space_key").isNotNull(), F.col("to_title")).otherwise(F.col("to_any"))
    return met.select("page_id", "at", target.alias("target_page_id"), target.isNull().alias("broken"))
