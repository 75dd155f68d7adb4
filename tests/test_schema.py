"""Document trees: every rule by a tree that keeps it and one that breaks it, and budgets."""

import json

import pytest

from tessera.functions.trees import TreeBudget, read_tree
from tessera.operators import schema

DOC = {"type": "doc", "version": 1}
GOOD = {
    "string": ["", "x"], "filled": ["x"], "number": [0, -1.5], "boolean": [True], "numbers": [[], [1, 2.5, -3]], "strings": [["a", "b, \"c"]], "colour": ["#00ffAA", "#00ffaa80"],
}
BAD = {
    "string": [1, None, ["x"]], "filled": ["", 3], "number": ["1", True], "boolean": ["true", 0], "numbers": [["1"], [1, None], 5, "[1]"], "strings": [[], ["a", 1], "a", [1]], "colour": ["#00ff", "red", 7],
    "whole": [1.5, "1", 10**17, -1], "range": [-1, 101, "5"], "one": ["other", "", 1, None],
}


def good_values(kind, argument):
    if kind == "one":
        return argument.split()
    if kind in ("whole", "range"):
        return [int(x) for x in argument.split()]
    return GOOD[kind]


def found(spark, trees):
    docs = spark.createDataFrame([(i, json.dumps(t) if not isinstance(t, str) else t) for i, t in enumerate(trees)], "doc_id long, t string")
    rows = schema.tree_rows(docs, "t")
    out = {i: set() for i in range(len(trees))}
    for r in schema.violations(rows).collect():
        out[r["doc_id"]].add((r["path"], r["code"]))
    return out, {r["doc_id"]: (r["verdict"], r["path"]) for r in schema.verdicts(rows).collect()}


def test_every_value_rule(spark):
    trees, want = [], []
    for marks, rules in ((False, schema.VALUES), (True, schema.MARK_VALUES)):
        for kind, attribute, required, is_, argument in rules:
            for ok, values in ((True, good_values(is_, argument)), (False, BAD[is_])):
                for value in values:
                    node = {"type": "text", "text": "x", "marks": [{"type": kind, "attrs": {attribute: value}}]} if marks else {"type": kind, "attrs": {attribute: value}}
                    trees.append(DOC | {"content": [node]})
                    want.append((f"$.content[0]{'.marks[0]' if marks else ''}.attrs.{attribute}", ok))
            if required:
                trees.append(DOC | {"content": [{"type": "text", "text": "x", "marks": [{"type": kind}]} if marks else {"type": kind}]})
                want.append((f"$.content[0]{'.marks[0]' if marks else ''}.attrs.{attribute}", False))
    got, _ = found(spark, trees)
    others = {("media", "id"), ("mediaSingle", "width"), ("table", "localId"), ("mediaSingle", "layout")}
    for i, (path, ok) in enumerate(want):
        if (trees[i]["content"][0]["type"], path.rpartition(".")[2]) not in others:
            assert ((path, "invalid-attributes") not in got[i]) == ok, trees[i]


def plain_faults(tree):
    """Unknown names and closed contents, by walking the tree."""
    out = set()

    def walk(node, path, parent):
        kind = node["type"]
        if kind not in schema.ATTRIBUTES and kind not in schema.BARE:
            out.add((path, "unknown-node"))
        if set(node) - set("type attrs content marks text version".split()) or set(node.get("attrs", {})) - set(schema.ATTRIBUTES.get(kind, "").split()):
            out.add((path, "unknown-attribute"))
        if parent in schema.CHILDREN and kind not in schema.CHILDREN[parent].split():
            out.add((path, "invalid-node"))
        for i, m in enumerate(node.get("marks", [])):
            if m["type"] not in schema.MARK_ATTRIBUTES and m["type"] not in schema.MARKS:
                out.add((f"{path}.marks[{i}]", "unknown-mark"))
            if kind in schema.ALLOWED_MARKS and m["type"] not in schema.ALLOWED_MARKS[kind].split():
                out.add((f"{path}.marks[{i}]", "invalid-node"))
        for i, c in enumerate(node.get("content", [])):
            walk(c, f"{path}.content[{i}]", kind)

    walk(tree, "$", None)
    return out


def test_contents_marks_and_names_of_all_pairs(spark):
    kinds = [*schema.ATTRIBUTES, *schema.BARE[1:], "sparkle"]
    trees = [DOC | {"content": [{"type": p, "content": [{"type": c} for c in kinds]} for p in schema.CHILDREN]}]
    trees += [DOC | {"content": [{"type": k, "marks": [{"type": m} for m in (*schema.MARK_ATTRIBUTES, *schema.MARKS, "glow")]} for k in kinds]}]
    trees += [DOC | {"content": [{"type": k, "attrs": dict.fromkeys(["localId", "layout", "odd"], "x"), "odd": 1} for k in kinds]}]
    got, verdicts = found(spark, trees)
    assert set(verdicts.values()) == {("ok", "$")}
    for i, tree in enumerate(trees):
        want = plain_faults(tree)
        assert {x for x in got[i] if x[1].startswith("unknown")} == {x for x in want if x[1].startswith("unknown")}
        assert want <= got[i]
        marks = {x for x in got[i] if x[1] == "invalid-node" and x[0].endswith("]") and ".marks[" in x[0]}
        assert marks == {x for x in want if x[1] == "invalid-node" and ".marks[" in x[0]}


@pytest.mark.parametrize(
    ("node", "want"),
    [
        ({"type": "mediaSingle", "attrs": {"layout": "center", "width": 50}}, set()),
        ({"type": "mediaSingle", "attrs": {"layout": "center", "widthType": "pixel", "width": 900}}, set()),
        ({"type": "mediaSingle", "attrs": {"layout": "center", "width": 900}}, {("$.content[0].attrs.width", "invalid-attributes")}),
        ({"type": "media", "attrs": {"type": "external", "url": "u"}}, set()),
        ({"type": "media", "attrs": {"type": "file", "id": "", "collection": "c"}}, {("$.content[0].attrs.id", "invalid-attributes")}),
        ({"type": "blockCard", "attrs": {"datasource": {"id": "d", "parameters": {}, "views": [{"type": "table"}]}, "layout": "wide"}}, set()),
        ({"type": "blockCard", "attrs": {"url": "u", "layout": "wide"}}, {("$.content[0].attrs", "invalid-attributes")}),
        ({"type": "blockCard", "attrs": {"datasource": {"id": "d", "parameters": {}, "views": []}}}, {("$.content[0].attrs.datasource", "invalid-attributes")}),
        ({"type": "expand", "content": [{"type": "paragraph"}], "marks": [{"type": "breakout", "attrs": {"mode": "wide"}}]}, set()),
        ({"type": "multiBodiedExtension", "attrs": {"extensionType": "t", "extensionKey": "k"}, "content": [{"type": "extensionFrame", "content": [{"type": "paragraph"}]}]}, set()),
    ],
)
def test_shapes(spark, node, want):
    assert found(spark, [DOC | {"content": [node]}])[0][0] == want


@pytest.mark.parametrize(
    ("source", "budget", "want"),
    [
        ("", {}, ("invalid-json", "$")), ("[]", {}, ("invalid-root", "$")), ('{"type":"doc","version":1,"content":[{"type":"x","attrs":{"a":NaN}}]}', {}, ("invalid-json", "$")),
        ('{"type":"doc","version":true,"content":[]}', {}, ("unsupported-version", "$.version")), ("x" * 11, {"input_bytes": 10}, ("input-too-large", "$")),
        (json.dumps(DOC | {"content": [{"type": "a"}, {"type": "b"}]}), {"nodes": 2}, ("node-budget-exceeded", "$.content[1]")),
        (json.dumps(DOC | {"content": [{"type": "a", "content": [{"type": "b"}]}]}), {"depth": 1}, ("depth-budget-exceeded", "$.content[0].content[0]")),
        (json.dumps(DOC | {"content": [{"type": "text", "text": "éé"}]}), {"text_bytes": 3}, ("text-budget-exceeded", "$.content[0].text")),
        (json.dumps(DOC | {"content": [{"type": "text", "marks": [{"type": "a"}, {"type": "b"}]}]}), {"marks": 1}, ("mark-budget-exceeded", "$.content[0].marks[1]")),
        (json.dumps(DOC | {"content": [{"type": "a", "attrs": {"k": [1, 2, 3]}}]}), {"attribute_values": 4}, ("attribute-budget-exceeded", "$.content[0].attrs.k[0]")),
        (json.dumps(DOC | {"content": [{"type": "a", "attrs": {"k": {"__proto__": 1}}}]}), {}, ("invalid-attributes", "$.content[0].attrs.k.__proto__")),
        (json.dumps(DOC | {"content": [{"type": "a", "marks": [3]}]}), {}, ("invalid-mark", "$.content[0].marks[0]")), (json.dumps(DOC | {"content": [{"type": ""}]}), {}, ("invalid-node", "$.content[0].type")),
        (json.dumps(DOC | {"content": [{"type": "a", "content": {}}]}), {}, ("invalid-node", "$.content[0].content")), (json.dumps(DOC | {"content": []}), {}, ("ok", "$")),
    ],
)
def test_what_cannot_be_read(source, budget, want):
    assert read_tree(source, TreeBudget(**budget))[:2] == want


def test_a_hundred_thousand_levels_end_in_a_verdict():
    deep = '{"type":"a","content":[' * 100_000 + "]}" * 100_000
    assert read_tree('{"type":"doc","version":1,"content":[' + deep + "]}", TreeBudget())[0] == "depth-budget-exceeded"


def test_nothing_and_null(spark):
    rows = schema.tree_rows(spark.createDataFrame([(1, None)], "doc_id long, t string"), "t")
    assert [r["verdict"] for r in schema.verdicts(rows).collect()] == ["invalid-json"] and schema.violations(rows).isEmpty()
