"""Queries of storage texts: nodes and verdicts of all pages, links of storage built from the documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions.markup import Budget
from tessera.operators import markdown, schema, storage
from tessera.operators.ranks import stored
from tessera.plans import views as v
from tessera.plans.register import query

#: Storage texts by document, as one expression that Spark and the oracle both read.
_KINDS = [
    """'<p>See <ac:link><ri:page ri:content-id="', doc_id // 2, '" ri:space-key="', lang, '"/><ri:anchor ri:anchor="part', doc_id % 5, '"/><ac:plain-text-link-body><![CDATA[to <b> ', doc_id, ']]></ac:plain-text-link-body></ac:link></p>'""",
    """'<p><ac:link><ri:page ri:content-title="Page ', doc_id * 3, '" ri:space-key="', lang, '" /><ac:link-body>rich <em>text ', doc_id % 9, '</em></ac:link-body></ac:link></p>'""",
    """'<ul><li>file<ac:link><ri:attachment ri:filename="a &amp; b ', doc_id % 30, '.pdf"/></ac:link></li></ul>'""",
    """'<p><ac:link><ri:shortcut ri:value="https://s', doc_id % 6, '.example.com/x?a=1&amp;b=2"/><ac:link-body>short</ac:link-body></ac:link></p>'""",
    """'<p><ac:link><ri:user ri:account-id="u', doc_id, '"/></ac:link> and <a class="x" href="http://h', doc_id % 4, '.example.com">out <!-- no --><i>side</i></a></p>'""",
    """'<p><a href="#part', doc_id % 5, '">jump</a> <a href="/relative">none</a><a name="x">none</a></p>'""",
    """'<table><tr><td><ac:image ac:width="10"><ri:attachment ri:filename="i', doc_id % 30, '.png"/></ac:image></td></tr></table>'""",
    """'<p>unclosed <b>bold <a href="mailto:a', doc_id % 7, '@example.com">write <ac:image><ri:attachment ri:filename="m.png"></ri:attachment></ac:image></a>'""",
]
_STORAGE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN concat('<h1>Page ', doc_id, '</h1>', {k})" for i, k in enumerate(_KINDS)) + " END"
_SPARK = re.sub(r"(\w+) // (\w+)", r"(\1 div \2)", _STORAGE)


def _storage(s, d):
    return v.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.expr(_SPARK).alias("storage"))


def _html_nodes(s, d, budget: Budget = Budget()):
    return storage.nodes_of(v.table(s, d, "pages"), "html", budget)


_COUNTED = """SELECT page_id, len(regexp_extract_all(h, '<[A-Za-z][^>]*>')) AS elements, len(list_filter(regexp_split_to_array(h, '<[^>]*>'), lambda x: x <> '')) AS texts
  FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->', '<!>', 'gs') AS h FROM pages)"""


@query(f"SELECT page_id, CASE WHEN elements + texts > 90 THEN 'too-many-nodes' ELSE 'ok' END AS verdict, CAST(CASE WHEN elements + texts > 90 THEN 0 ELSE elements + texts END AS INTEGER) AS nodes FROM ({_COUNTED})")
def src18_page_verdicts(s, d):
    """Pages of more than 90 nodes break this budget."""
    return storage.verdicts(_html_nodes(s, d, Budget(nodes=90))).drop("depth")


@query(f"SELECT page_id, CAST(elements AS BIGINT) AS elements, CAST(texts AS BIGINT) AS texts FROM ({_COUNTED})")
def src18_storage_nodes(s, d):
    nodes = _html_nodes(s, d)
    return nodes.groupBy("page_id").agg(F.count_if(F.col("kind") == "element").alias("elements"), F.count_if(F.col("kind") == "text").alias("texts"))


@query()
def src18_storage_blocks(s, d):
    return storage.blocks(_html_nodes(s, d))


_LINKS = """SELECT doc_id AS page_id, doc_id % 8 AS k, lang, unnest(CASE doc_id % 8
    WHEN 0 THEN [{'kind': 'internal', 'target_id': CAST(doc_id // 2 AS VARCHAR), 'space_key': lang, 'title': NULL, 'filename': NULL, 'url': NULL, 'anchor': concat('part', doc_id % 5), 'text': concat('to <b> ', doc_id)}]
    WHEN 1 THEN [{'kind': 'internal', 'target_id': NULL, 'space_key': lang, 'title': concat('Page ', doc_id * 3), 'filename': NULL, 'url': NULL, 'anchor': NULL, 'text': concat('rich text ', doc_id % 9)}]
    WHEN 2 THEN [{'kind': 'attachment', 'target_id': NULL, 'space_key': NULL, 'title': NULL, 'filename': concat('a & b ', doc_id % 30, '.pdf'), 'url': NULL, 'anchor': NULL, 'text': NULL}]
    WHEN 3 THEN [{'kind': 'external', 'target_id': NULL, 'space_key': NULL, 'title': NULL, 'filename': NULL, 'url': concat('https://s', doc_id % 6, '.example.com/x?a=1&b=2'), 'anchor': NULL, 'text': 'short'}]
    WHEN 4 THEN [{'kind': 'external', 'target_id': NULL, 'space_key': NULL, 'title': NULL, 'filename': NULL, 'url': concat('http://h', doc_id % 4, '.example.com'), 'anchor': NULL, 'text': 'out side'}]
    WHEN 5 THEN [{'kind': 'anchor', 'target_id': NULL, 'space_key': NULL, 'title': NULL, 'filename': NULL, 'url': NULL, 'anchor': concat('part', doc_id % 5), 'text': 'jump'}]
    WHEN 6 THEN [{'kind': 'attachment', 'target_id': NULL, 'space_key': NULL, 'title': NULL, 'filename': concat('i', doc_id % 30, '.png'), 'url': NULL, 'anchor': NULL, 'text': NULL}]
    ELSE [{'kind': 'external', 'target_id': NULL, 'space_key': NULL, 'title': NULL, 'filename': NULL, 'url': concat('mailto:a', doc_id % 7, '@example.com'), 'anchor': NULL, 'text': 'write'},
      {'kind': 'attachment', 'target_id': NULL, 'space_key': NULL, 'title': NULL, 'filename': 'm.png', 'url': NULL, 'anchor': NULL, 'text': NULL}] END, recursive := true) FROM documents"""


@query(f"SELECT page_id, kind, target_id, space_key, title, filename, url, anchor, text FROM ({_LINKS})")
def str10_storage_links(s, d):
    return storage.links(storage.nodes_of(_storage(s, d), "storage")).drop("at")


@query("SELECT page_id, regexp_extract(a, 'href=\"([^\"]*)', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a [^>]*href=\"[^\"]*')) AS a FROM pages)")
def str10_page_links(s, d):
    """Where the anchors of every raw page lead to."""
    href = F.try_element_at("attrs", F.lit("href"))
    return _html_nodes(s, d).filter((F.col("name") == "a") & (F.col("kind") == "element") & href.isNotNull()).select("page_id", href.alias("href"))


@query(f"""WITH l AS (SELECT * FROM ({_LINKS}) WHERE kind = 'internal'), p AS (SELECT doc_id, lang, concat('Page ', doc_id) AS title FROM documents)
  SELECT l.page_id, coalesce(i.doc_id, t.doc_id) AS target_page_id, coalesce(i.doc_id, t.doc_id) IS NULL AS broken FROM l LEFT JOIN p AS i ON l.target_id = CAST(i.doc_id AS VARCHAR)
  LEFT JOIN p AS t ON l.target_id IS NULL AND l.title = t.title AND l.space_key = t.lang""")
def str10_resolved_links(s, d):
    found = storage.links(storage.nodes_of(_storage(s, d), "storage"))
    return storage.resolved_links(found, v.pages(s, d)).drop("at")


#: A further node of the tree that each document is, and the faults that it has: (path below the node, code, what).
_TREES = [
    ('{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"h","marks":[{"type":"strong"}]}]}', []),
    ('{"type":"heading","attrs":{"level":7,"colour":"x"}}', [(".attrs.level", "invalid-attributes", "level"), ("", "unknown-attribute", "colour")]),
    ('{"type":"panel","attrs":{"panelType":"loud"},"extra":1,"content":[{"type":"sparkle"}]}', [(".attrs.panelType", "invalid-attributes", "panelType"), ("", "unknown-attribute", "extra"), (".content[0]", "unknown-node", "sparkle")]),
    ('{"type":"codeBlock","marks":[{"type":"breakout","attrs":{"mode":"wide"}}],"content":[{"type":"text","text":"x","marks":[{"type":"em"}]},{"type":"rule"}]}', [(".content[0].marks", "invalid-node", "text"), (".content[1]", "invalid-node", "rule")]),
    ('{"type":"expand","attrs":{"title":3},"marks":[{"type":"glow"}]}', [(".attrs.title", "invalid-attributes", "title"), (".content", "invalid-node", "expand"), (".marks[0]", "unknown-mark", "glow"), (".marks[0]", "invalid-node", "glow")]),
    ('{"type":"table","attrs":{"width":"wide"},"content":[{"type":"tableRow","content":[{"type":"tableCell","attrs":{"colwidth":[1,"2"]}}]}]}', [(".attrs.width", "invalid-attributes", "width"), (".content[0].content[0].attrs.colwidth", "invalid-attributes", "colwidth")]),
    ('{"type":"extensionFrame","content":[{"type":"expand","content":[{"type":"paragraph"}]}]}', [("", "invalid-node", "extensionFrame"), (".content[0]", "invalid-node", "expand")]),
    ('{"type":"paragraph","content":[{"type":"text"},{"type":"status","attrs":{"text":"","color":"pink"}},{"type":"inlineCard"}]}', [(".content[0]", "invalid-node", "text"), (".content[1].attrs.text", "invalid-attributes", "text"), (".content[1].attrs.color", "invalid-attributes", "color"), (".content[2].attrs", "invalid-attributes", "inlineCard")]),
]
_BROKEN = {0: ('{"type":"doc","version":1,', "invalid-json", "$"), 1: ('{"type":"doc","version":2,"content":[]}', "unsupported-version", "$.version"), 2: ('{"type":"page","content":[]}', "invalid-root", "$"), 3: ('{"type":"doc","version":1,"content":[7]}', "invalid-node", "$.content[0]")}


def _trees(s, d):
    """A tree of each document: its whole text in a paragraph, and a further node by its id; every eleventh cannot be read."""
    doc = v.table(s, d, "documents").select("doc_id", "text")
    node = F.element_at(F.array(*(F.lit(t) for t, _ in _TREES)), (F.col("doc_id") % len(_TREES)).cast("int") + 1)
    broken = F.element_at(F.array(*(F.lit(t) for t, _, _ in _BROKEN.values())), (F.col("doc_id") % 4).cast("int") + 1)
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    whole = F.concat(F.lit('{"type":"doc","version":1,"content":[{"type":"paragraph","content":['), said, F.lit("]},"), node, F.lit("]}"))
    return doc.select("doc_id", F.when(F.col("doc_id") % 11 == 0, broken).otherwise(whole).alias("tree"))


def _faults_sql() -> str:
    kinds = " ".join(f"WHEN {i} THEN [{', '.join(f'''{{'path': '$.content[1]{p}', 'code': '{c}', 'what': '{w}'}}''' for p, c, w in faults)}]" for i, (_, faults) in enumerate(_TREES) if faults)
    return f"SELECT doc_id, unnest(CASE doc_id % {len(_TREES)} {kinds} END, recursive := true) FROM documents WHERE doc_id % 11 <> 0"


@query(f"SELECT doc_id, path, code, what FROM ({_faults_sql()})")
def val03_tree_violations(s, d):
    return schema.violations(schema.tree_rows(_trees(s, d), "tree"))


@query("SELECT doc_id, " + " ".join(f"{'CASE' if i == 0 else ''} WHEN doc_id % 11 = 0 AND doc_id % 4 = {i} THEN '{c}'" for i, (_, c, _) in _BROKEN.items()) + " ELSE 'ok' END AS verdict, "
       + " ".join(f"{'CASE' if i == 0 else ''} WHEN doc_id % 11 = 0 AND doc_id % 4 = {i} THEN '{p}'" for i, (_, _, p) in _BROKEN.items()) + " ELSE '$' END AS path FROM documents")
def val03_tree_verdicts(s, d):
    return schema.verdicts(schema.tree_rows(_trees(s, d), "tree"))


@query(f"SELECT code, count(*) AS faults, count(DISTINCT doc_id) AS documents FROM ({_faults_sql()}) GROUP BY code")
def val03_faults_by_code(s, d):
    return schema.violations(schema.tree_rows(_trees(s, d), "tree")).groupBy("code").agg(F.count(F.lit(1)).alias("faults"), F.count_distinct("doc_id").alias("documents"))


_MARKDOWN = "concat('# Title ', doc_id, '\\n\\n', CASE doc_id % 5 WHEN 0 THEN concat('- a ', doc_id, '\\n  - *b*\\n- c') WHEN 1 THEN concat('> q & **', doc_id, '**') WHEN 2 THEN concat('```sql\\nSELECT ', doc_id, ' < 2\\n```') WHEN 3 THEN concat('| k | v |\\n|---|---|\\n| `n` | ', doc_id, ' |') ELSE concat('see [it](http://x/', doc_id, ')\\n\\n---') END)"


@query("""SELECT doc_id AS page_id, concat('<h1>Title ', doc_id, '</h1>', CASE doc_id % 5 WHEN 0 THEN concat('<ul><li>a ', doc_id, '<ul><li><em>b</em></li></ul></li><li>c</li></ul>') WHEN 1 THEN concat('<blockquote><p>q &amp; <strong>', doc_id, '</strong></p></blockquote>')
  WHEN 2 THEN concat('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[SELECT ', doc_id, ' < 2]]></ac:plain-text-body></ac:structured-macro>')
  WHEN 3 THEN concat('<table><tbody><tr><th>k</th><th>v</th></tr><tr><td><code>n</code></td><td>', doc_id, '</td></tr></tbody></table>') ELSE concat('<p>see <a href="http://x/', doc_id, '">it</a></p><hr/>') END) AS storage FROM documents""")
def str25_markdown_to_storage(s, d):
    return markdown.to_storage(v.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.expr(_MARKDOWN).alias("text")), "text")


@query("SELECT doc_id AS page_id, true AS same_markdown, true AS same_storage FROM documents")
def str25_round_trips(s, d):
    """Every whole document as markdown to storage and back, twice: the second time nothing changes."""
    text = F.concat(F.expr(_MARKDOWN), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    pages = v.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), text.alias("text"))
    once = stored(markdown.to_markdown(stored(markdown.to_storage(pages, "text")), "storage"))
    made = stored(markdown.to_storage(once, "markdown"))
    twice = stored(markdown.to_markdown(made, "storage"))
    again = markdown.to_storage(twice, "markdown")
    # Whole texts need not meet to be compared.
    digest = lambda df, text, name: df.select("page_id", F.struct(F.length(text), F.sha2(text, 256)).alias(name))
    met = digest(once, "markdown", "m1").join(digest(twice, "markdown", "m2"), "page_id").join(digest(made, "storage", "s1"), "page_id").join(digest(again, "storage", "s2"), "page_id")
    return met.select("page_id", (F.col("m1") == F.col("m2")).alias("same_markdown"), (F.col("s1") == F.col("s2")).alias("same_storage"))
