"""Markdown to storage and back, as tables of lines and of nodes.

To storage: lines are rows; a running count of fences tells code from text, lines of one kind that follow each other
are a block (a running count of where blocks begin), each block becomes one element, and blocks are joined in order.
Back: the nodes of a storage text (``operators/storage``) become events, where an element opens, says something and
closes; running sums over the events tell how deep lists are and whether a text is code or a quote, and what each
event writes is joined in order. Windows and groups are those of one page.

Built: headings, paragraphs, nested lists, fenced code, quotes, tables, rules; code, bold, emphasis, strike, links and
images in lines. Anything else is text. What comes back from storage is a fixed point: it converts to the same
storage, and that to the same markdown.

Defined cases: a null text is an empty one, and both give empty texts; a fence that is not closed ends with the text;
characters that XML does not allow are dropped; a list item is at most one level below the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import stored
from tessera.operators.storage import nodes_of

_FENCE, _ITEM = r"^\s{0,3}```\s*(\S*)\s*$", r"^(\s*)([-*+]|\d+[.)])\s+(\S.*)$"
_HEADING, _QUOTE, _RULE, _ROW, _SEPARATOR = r"^(#{1,6})\s+(\S.*)$", r"^>\s?(.*)$", r"^(-{3,}|\*{3,}|_{3,})\s*$", r"^\|.*\|\s*$", r"^\|(\s*:?-+:?\s*\|)+\s*$"


def escaped(c: Column) -> Column:
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(by))
    return c


def inline(text: Column) -> Column:
    """A line's markup; code spans first, so that nothing is read inside of them."""
    def plain(x: Column) -> Column:
        x = escaped(x)
        for pattern, by in (
            (r"!\[([^\]]*)\]\(([a-z]+://[^()\s]+)\)", '<ac:image ac:alt="$1"><ri:url ri:value="$2"/></ac:image>'), (r"!\[([^\]]*)\]\(([^()\s]+)\)", '<ac:image ac:alt="$1"><ri:attachment ri:filename="$2"/></ac:image>'),
            (r"\[([^\]\[]+)\]\(([^()\s]+)\)", '<a href="$2">$1</a>'), (r"\*\*(?=\S)(.+?)(?<=\S)\*\*", "<strong>$1</strong>"), (r"(?<![*\w])\*(?=[^\s*])([^*]*?)(?<=[^\s*])\*(?![*\w])", "<em>$1</em>"),
            (r"~~(?=\S)(.+?)(?<=\S)~~", "<del>$1</del>"),
        ):
            x = F.regexp_replace(x, pattern, by)
        return x

    parts = F.regexp_extract_all(text, F.lit(r"`[^`]+`|[^`]+|`"), F.lit(0))
    code = lambda x: F.concat(F.lit("<code>"), escaped(F.substring(x, F.lit(2), F.length(x) - 2)), F.lit("</code>"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^`[^`]+`$"), code(x)).otherwise(plain(x))), "")


def lines(pages: DataFrame, text: str) -> DataFrame:
    """(page_id, at, line, kind, block): kinds are code, heading, quote, item, row, rule, blank and para."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    rows = pages.select("page_id", F.posexplode(F.split(clean, "\n")).alias("at", "line"))
    order = Window.partitionBy("page_id").orderBy("at")
    fence = F.col("line").rlike(_FENCE)
    counted = rows.withColumn("fences", F.count_if(fence).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_code = fence | (F.col("fences") % 2 == 1)
    kind = F.when(in_code, "code")
    for pattern, name in ((r"^\s*$", "blank"), (_HEADING, "heading"), (_QUOTE, "quote"), (_RULE, "rule"), (_ITEM, "item"), (_ROW, "row")):
        kind = kind.when(F.col("line").rlike(pattern), name)
    kinds = counted.withColumn("kind", kind.otherwise("para")).withColumn("opens", fence & (F.col("fences") % 2 == 1))
    before = F.lag("kind").over(order)
    begins = F.col("kind").isin("heading", "rule", "blank") | F.col("opens") | ~before.eqNullSafe(F.col("kind"))
    return kinds.withColumn("begins", begins).withColumn("block", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("page_id", "at", "line", "kind", "block", "fences")


def _list(items: Column) -> Column:
    """Nested lists of (indent, tag, html): a fold that keeps the tags of the open lists."""
    closing = lambda tags: F.array_join(F.transform(F.reverse(tags), lambda t: F.concat(F.lit("</li></"), t, F.lit(">"))), "")
    start = F.struct(F.lit("").alias("out"), F.expr("cast(array() as array<string>)").alias("open"))

    def step(s: Column, x: Column) -> Column:
        depth = F.least(F.floor(x["indent"] / 2).cast("int"), F.size(s["open"]))
        deeper, same = F.slice(s["open"], depth + 2, F.size(s["open"])), F.try_element_at(s["open"], depth + 1)
        opened = F.concat(F.lit("<"), x["tag"], F.lit("><li>"))
        between = F.when(same.isNull(), opened).when(same == x["tag"], F.concat(closing(deeper), F.lit("</li><li>"))).otherwise(F.concat(closing(deeper), F.lit("</li></"), same, F.lit(">"), opened))
        return F.struct(F.concat(s["out"], between, x["html"]).alias("out"), F.concat(F.slice(s["open"], F.lit(1), depth), F.array(x["tag"])).alias("open"))

    return F.aggregate(items, start, step, lambda s: F.concat(s["out"], closing(s["open"])))


def to_storage(pages: DataFrame, text: str) -> DataFrame:
    """(page_id, storage) of markdown texts."""
    at = lambda pattern, group: F.regexp_extract("line", pattern, group)
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    cell = F.transform(F.filter(F.split(F.regexp_replace(trimmed, r"^\||\|$", ""), r"\|", -1), lambda x: F.lit(True)), lambda x: F.trim(x))
    read = lines(pages, text).filter("kind <> 'blank'").select(
        "page_id", "block", "kind",
        F.struct(
            "at", "line", F.col("line").rlike(_FENCE).alias("fence"), at(_FENCE, 1).alias("language"), F.col("line").rlike(_SEPARATOR).alias("separator"), F.when(F.col("kind") == "row", cell).alias("cells"),
            F.length(F.regexp_replace(at(_ITEM, 1), "\t", "  ")).alias("indent"), F.when(at(_ITEM, 2).rlike("[0-9]"), "ol").otherwise("ul").alias("tag"), F.length(at(_HEADING, 1)).alias("level"),
            F.when(F.col("kind") == "heading", F.rtrim(at(_HEADING, 2))).when(F.col("kind") == "quote", at(_QUOTE, 1)).when(F.col("kind") == "item", F.rtrim(at(_ITEM, 3))).otherwise(trimmed).alias("said"),
        ).alias("x"),
    )
    blocks = read.groupBy("page_id", "block", "kind").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    said = F.array_join(F.transform("xs", lambda x: inline(x["said"])), "\n")
    wrapped = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    code = F.array_join(F.transform(F.filter("xs", lambda x: ~x["fence"]), lambda x: x["line"]), "\n")
    language = F.try_element_at("xs", F.lit(1))["language"]
    macro = F.concat(
        F.lit('<ac:structured-macro ac:name="code">'), F.when(language != "", F.concat(F.lit('<ac:parameter ac:name="language">'), escaped(language), F.lit("</ac:parameter>"))).otherwise(""),
        F.lit("<ac:plain-text-body><![CDATA["), F.replace(code, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></ac:plain-text-body></ac:structured-macro>"),
    )
    headed = F.coalesce(F.try_element_at("xs", F.lit(2))["separator"], F.lit(False))
    row = lambda x, i: F.when(~x["separator"], wrapped("tr", F.array_join(F.transform(x["cells"], lambda c: F.when(headed & (i == 0), wrapped("th", inline(c))).otherwise(wrapped("td", inline(c)))), "")))
    rows = F.array_join(F.transform("xs", row), "")
    level = F.try_element_at("xs", F.lit(1))["level"].cast("string")
    html = (
        F.when(F.col("kind") == "code", macro).when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), said, F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "quote", wrapped("blockquote", wrapped("p", said))).when(F.col("kind") == "rule", "<hr/>")
        .when(F.col("kind") == "item", _list(F.transform("xs", lambda x: F.struct(x["indent"].alias("indent"), x["tag"].alias("tag"), inline(x["said"]).alias("html")))))
        .when(F.col("kind") == "row", F.when(rows != "", wrapped("table", wrapped("tbody", rows))).otherwise("")).otherwise(wrapped("p", said))
    )
    made = blocks.select("page_id", F.struct("block", html.alias("html")).alias("b")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["html"]), "").alias("storage"))
    return pages.select("page_id").join(made, "page_id", "left").select("page_id", F.coalesce("storage", F.lit("")).alias("storage"))


def to_markdown(pages: DataFrame, storage: str) -> DataFrame:
    """(page_id, markdown) of storage texts; a text that cannot be read within the budget has none."""
    nodes = nodes_of(pages, storage)
    attr = lambda name, c="attrs": F.coalesce(F.try_element_at(c, F.lit(name)), F.lit(""))
    # Elements meet each other without any texts; texts then join them in the one exchange that gathers a page.
    elements = stored(nodes.filter("kind = 'element'").select("page_id", "at", "parent", "last", "depth", "kind", "name", "attrs"))
    is_language = (F.col("name") == "ac:parameter") & (attr("ac:name") == "language")
    children = elements.groupBy("page_id", F.col("parent").alias("at")).agg(
        F.bool_or(F.col("name").isin("ul", "ol")).alias("has_list"), F.count_if(F.col("name") == "th").alias("ths"),
        F.min_by(F.coalesce(F.try_element_at("attrs", F.lit("ri:value")), F.try_element_at("attrs", F.lit("ri:filename"))), F.when(F.col("name").isin("ri:url", "ri:attachment"), F.col("at"))).alias("source"),
        F.min_by("at", F.when(is_language, F.col("at"))).alias("parameter"),
    )
    parents = elements.select("page_id", F.col("at").alias("parent"), F.col("name").alias("parent_name"))
    place = F.row_number().over(Window.partitionBy("page_id", "parent", "name").orderBy("at"))
    placed = elements.join(children, ["page_id", "at"], "left").join(parents, ["page_id", "parent"], "left").withColumn("ordinal", place)
    placed = placed.withColumn("first_list", F.min(F.when(F.col("name").isin("ul", "ol"), F.col("at"))).over(Window.partitionBy("page_id", "parent")))
    texts = nodes.filter("kind = 'text'").select("page_id", "at", "parent", "last", "depth", "kind", "text")
    gathered = placed.unionByName(texts, allowMissingColumns=True).repartition("page_id")
    spoken = F.col("kind") == "text"
    element = Window.partitionBy("page_id", F.when(spoken, F.col("parent")).otherwise(F.col("at")))
    known = gathered.withColumn("parent_name", F.when(spoken, F.max("name").over(element)).otherwise(F.col("parent_name")))
    # A code's language is the text below its parameter; other rows are each on their own.
    parameter = F.when(spoken & (F.col("parent_name") == "ac:parameter"), F.col("parent")).otherwise(F.coalesce("parameter", -F.col("at")))
    known = known.withColumn("language", F.min_by("text", F.when(spoken, F.col("at"))).over(Window.partitionBy("page_id", parameter)))

    name, is_text = F.col("name"), F.col("kind") == "text"
    is_code = (name == "ac:structured-macro") & (attr("ac:name") == "code")
    blank = is_text & F.col("text").rlike(r"^\s*$") & F.coalesce(F.col("parent_name").isin("ul", "ol", "table", "tbody", "tr", "blockquote", "ac:rich-text-body", "ac:structured-macro"), F.lit(True))
    kept = known.filter(~(is_text & F.coalesce(F.col("parent_name") == "ac:parameter", F.lit(False))) & ~blank)
    sides = kept.select("*", F.explode(F.when(is_text, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("closes"))
    events = sides.withColumn("pos", F.when(F.col("closes") == 1, F.col("last")).otherwise(F.col("at"))).withColumn("deep", F.when(F.col("closes") == 1, -F.col("depth")).otherwise(F.lit(0)))
    order = Window.partitionBy("page_id").orderBy("pos", "closes", "deep")
    step = lambda what: F.sum(F.when(~is_text & what, 1 - 2 * F.col("closes")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = events.withColumn("lists", step(name.isin("ul", "ol"))).withColumn("codes", step(is_code)).withColumn("quotes", step(name == "blockquote")).withColumn("cells", step(name.isin("td", "th")))

    opens, marks = F.col("closes") == 0, F.create_map(*(F.lit(x) for t, m in {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~", "strike": "~~"}.items() for x in (t, m)))
    both = lambda a, b: F.when(opens, a).otherwise(b)
    level = F.regexp_extract("name", "^h([1-6])$", 1).try_cast("int")
    written = (
        F.when(is_text, F.when((F.col("quotes") > 0) & (F.col("codes") == 0), F.replace("text", F.lit("\n"), F.lit("\n> "))).otherwise(F.col("text")))
        .when(level.isNotNull(), both(F.concat(F.repeat(F.lit("#"), level), F.lit(" ")), F.lit("\n\n"))).when(name == "p", both(F.lit(""), F.when((F.col("lists") == 0) & (F.col("cells") == 0), "\n\n").otherwise("")))
        .when(F.try_element_at(marks, name).isNotNull(), F.try_element_at(marks, name)).when(name == "a", both(F.lit("["), F.concat(F.lit("]("), attr("href"), F.lit(")")))).when(name == "br", both(F.lit("\n"), F.lit("")))
        .when(name == "hr", both(F.lit("---\n\n"), F.lit(""))).when(name == "blockquote", both(F.lit("> "), F.lit("")))
        .when(name.isin("ul", "ol"), both(F.when((F.col("lists") > 1) & (F.col("at") == F.col("first_list")), "\n").otherwise(""), F.when(F.col("lists") == 0, "\n").otherwise("")))
        .when(name == "li", both(F.concat(F.repeat(F.lit("  "), F.greatest(F.col("lists") - 1, F.lit(0)).cast("int")), F.when(F.col("parent_name") == "ol", F.concat(F.col("ordinal").cast("string"), F.lit(". "))).otherwise("- ")), F.when(F.col("has_list"), "").otherwise("\n")))
        .when(is_code, both(F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n")), F.lit("\n```\n\n"))).when(name == "table", both(F.lit(""), F.lit("\n")))
        .when(name == "tr", both(F.lit("|"), F.concat(F.lit("\n"), F.when(F.col("ths") > 0, F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("ths").cast("int")), F.lit("\n"))).otherwise("")))).when(name.isin("td", "th"), both(F.lit(" "), F.lit(" |")))
        .when(name == "ac:image", both(F.concat(F.lit("!["), attr("ac:alt"), F.lit("]("), F.coalesce("source", F.lit("")), F.lit(")")), F.lit(""))).otherwise("")
    )
    said = at.select("page_id", F.struct("pos", "closes", "deep", written.alias("w")).alias("e")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["w"]), "").alias("markdown"))
    clean = F.regexp_replace(F.coalesce("markdown", F.lit("")), r"^\n+|\s+$", "")
    return pages.select("page_id").join(said, "page_id", "left").select("page_id", clean.alias("markdown"))
