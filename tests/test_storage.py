"""Storage texts: nodes against a plain recursive reader, budgets, blocks and links by hand."""

import html
import random
import re

import pytest

from tessera.functions.markup import INLINE, VOID, Budget, read_nodes
from tessera.operators import storage


def tree(source):
    """Nested lists of [name, attributes, children] and texts, read by recursion with plain string search."""

    def text(raw, out, literal=False):
        raw = raw if literal else html.unescape(raw)
        raw = "".join(c for c in raw if not (ord(c) < 32 and c not in "\t\n\r") and c not in "\x7f￾￿")
        if raw:
            out.append(raw)

    def inner(i, out, names):
        """Reads children until a closing tag of one of the open names; returns (place, the name it closes)."""
        while i < len(source):
            lt = source.find("<", i)
            if lt < 0:
                text(source[i:], out)
                return len(source), None
            text(source[i:lt], out)
            if source.startswith("<![CDATA[", lt):
                end = source.find("]]>", lt)
                text(source[lt + 9 : end if end >= 0 else len(source)], out, True)
                i = end + 3 if end >= 0 else len(source)
                continue
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                i = end + 3 if end >= 0 else len(source)
                continue
            gt = source.find(">", lt)
            if source[lt + 1 : lt + 2] in ("!", "?"):
                i = gt + 1 if gt >= 0 else len(source)
                continue
            if gt < 0:
                text(source[lt:], out)
                return len(source), None
            tag, i = source[lt + 1 : gt].strip(), gt + 1
            if tag.startswith("/"):
                name = tag[1:].strip().lower()
                if name in names:
                    return i, name
                continue
            alone = tag.endswith("/")
            tag = tag.rstrip("/").strip() if alone and not tag.endswith("//") else tag[:-1].strip() if alone else tag
            m = re.match(r"[A-Za-z][\w:.-]*", tag, re.A)
            if not m:
                continue
            name = m[0].lower()
            attrs = {a.lower(): html.unescape(b.strip("\"'")) for a, b in re.findall(r"""([A-Za-z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", tag[m.end() :], re.A)}
            node = [name, attrs, []]
            out.append(node)
            if not alone and name not in VOID:
                i, closed = inner(i, node[2], [*names, name])
                if closed is not None and closed != name:
                    return i, closed
        return i, None

    out = []
    # A closing tag ends the nearest open element of its name, so the innermost of equal names must take it.
    inner(0, out, [])
    return out


def rebuilt(nodes):
    top, by_at = [], {}
    for n in nodes:
        item = n.text if n.attrs is None else [n.name, n.attrs, []]
        (by_at[n.parent][2] if n.parent else top).append(item)
        by_at[n.at] = item
    return top


PIECES = [
    "<p>", "</p>", "<b>", "</b>", "<div class='x y' id=3>", "</div>", "<br>", "<br/>", "<ac:link>", "</ac:link>", '<ri:page ri:content-title="A &amp; B"/>', "text", " & ", "&amp;", "&#x1;", "&uuml;", "\n",
    "<!-- c <b> -->", "<![CDATA[raw <i> &amp;]]>", "<!DOCTYPE html>", "<?xml version='1'?>", "< b >", "</ b >", "<3>", "<a href=x>", "</a>", "<P Checked>", "<", "<!-- open", "<![CDATA[open", "𓀀",
]


def test_nodes_are_those_of_a_recursive_reader():
    r = random.Random(5)
    for _ in range(4000):
        source = "".join(r.choice(PIECES) for _ in range(r.randrange(14)))
        verdict, nodes = read_nodes(source, Budget())
        assert verdict == "ok" and rebuilt(nodes) == tree(source), source
        for n in nodes:
            assert n.last == max([n.at] + [x.at for x in nodes if x.parent and n.at <= x.parent <= n.last])


def test_budgets():
    assert read_nodes("<b>" * 256, Budget())[0] == "ok" and read_nodes("<b>" * 257, Budget())[0] == "too-deep"
    assert read_nodes("<br/>" * 10, Budget(nodes=10))[0] == "ok" and read_nodes("<br/>" * 11, Budget(nodes=10))[0] == "too-many-nodes"
    assert read_nodes("𓀀" * 5, Budget(text=10))[0] == "ok" and read_nodes("𓀀" * 5 + "x", Budget(text=10))[0] == "text-too-long"
    verdict, nodes = read_nodes("<b>" * 100_000 + "x", Budget(depth=200_000))
    assert verdict == "ok" and nodes[-1].depth == 100_001 and nodes[0].last == 100_001


def test_blocks_and_verdicts(spark):
    pages = [
        (1, "<div>a<p>b <b>c</b><br>d</p>e <i>f</i><hr/>g</div>tail"), (2, None), (3, ""), (4, "<p>" * 400), (5, "<h1>Ti\n  tle</h1><ul><li>x <ac:link><ri:page/><ac:link-body>y</ac:link-body></ac:link></li></ul>"),
    ]
    nodes = storage.nodes_of(spark.createDataFrame(pages, "page_id long, html string"), "html", rows=3)
    assert {(r["page_id"], r["verdict"], r["nodes"]) for r in storage.verdicts(nodes).collect()} == {(1, "ok", 14), (2, "ok", 0), (3, "ok", 0), (4, "too-deep", 0), (5, "ok", 9)}
    got = [(r["page_id"], r["kind"], r["text"]) for r in storage.blocks(nodes).orderBy("page_id", "place").collect()]
    assert got == [(1, "div", "a"), (1, "p", "b c d"), (1, "div", "e f"), (1, "div", "g"), (1, "", "tail"), (5, "h1", "Ti tle"), (5, "li", "x y")]


def plain_blocks(source):
    """Runs of text between the beginnings and ends of blocks, by walking the recursive reader's tree."""
    out = [["", ""]]

    def walk(children, block, may_begin):
        for c in children:
            if isinstance(c, str):
                out[-1][0] = out[-1][0] or block
                out[-1][1] += c
            else:
                begins = may_begin and c[0] not in INLINE
                if begins:
                    out.append(["", ""])
                out[-1][1] += "\n" if c[0] == "br" else ""
                walk(c[2], c[0] if begins else block, begins if c[0] in INLINE or not may_begin else begins)
                if begins:
                    out.append(["", ""])

    walk(tree(source), "", True)
    return [(k, " ".join(t.split())) for k, t in out if t.split()]


def test_blocks_of_all_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {}
    for r in storage.blocks(storage.nodes_of(pages, "html")).orderBy("page_id", "place").collect():
        got.setdefault(r["page_id"], []).append((r["kind"], " ".join(r["text"].split())))
    want = {r["page_id"]: plain_blocks(r["html"]) for r in pages.collect()}
    assert {k: v for k, v in want.items() if v} == got


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<ac:link><ri:user ri:account-id="1"/><ri:page ri:content-id="2"/></ac:link>', []),
        ('<ac:link><ri:page ri:space-key="S"/></ac:link>', []),
        ('<ac:link><ri:page ri:content-id="7" ri:anchor="q"/><ac:plain-text-link-body><![CDATA[ a<b ]]></ac:plain-text-link-body></ac:link>', [("internal", "7", None, "q", "a<b")]),
        ('<ac:link><ri:attachment/></ac:link>', []),
        ('<a href="ftp://x">x</a><a href="#">top</a>', [("anchor", None, None, "", "top")]),
        ('<A HREF="HTTPS://X">x</A>', []),
        ('<a href="https://x"><ac:image><ri:attachment ri:filename="f"/></ac:image></a>', [("external", None, "https://x", None, None), ("attachment", None, None, None, None)]),
    ],
)
def test_links(spark, source, want):
    found = storage.links(storage.nodes_of(spark.createDataFrame([(1, source)], "page_id long, s string"), "s")).orderBy("at").collect()
    assert [(r["kind"], r["target_id"], r["url"], r["anchor"], r["text"]) for r in found] == want
