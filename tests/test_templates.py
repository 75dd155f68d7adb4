"""Templates by hand: values, defaults, helpers, blocks and what cannot be compiled."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.templates import Compiled, TemplateError, Variable, syntax_error, used_variables

def made(spark, content, values=None, variables=()):
    columns = Compiled(content, variables, {"user": "<U>"}).columns({k: F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for k, x in (values or {}).items()}, F.lit("2024-03-01 10:11:12").cast("timestamp"))
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(
    ("content", "values", "want"),
    [
        ("a {{x}} {{{x}}} b", {"x": "<&'\"`=>"}, "a &lt;&amp;&#x27;&quot;&#x60;&#x3D;&gt; <&'\"`=> b"), ('{{x "d&"}}|{{y "d"}}', {"y": "v"}, "d&amp;|v"), ("{{lowercase x}}{{uppercase x}}{{lowercase no}}", {"x": "aB"}, "abAB"),
        ('{{formatDate x "DD/MM DD YYYY HH:mm:ss"}}', {"x": "2024-02-03 04:05:06"}, "03/02 DD 2024 04:05:06"), ('{{formatDate x "YYYY"}}', {"x": "soon"}, "soon"), ("{{@user}}{{@none}}", {}, "&lt;U&gt;"),
        ("{{#if x}}1{{#if y}}2{{else}}3{{/if}}{{else}}4{{/if}}", {"x": "a", "y": "0"}, "12"), ("{{#unless x}}n{{/unless}}", {}, "n"), ("{{#each xs}}[{{this}}{{y}}]{{/each}}.", {"xs": ["a", "<"], "y": "!"}, "[a!][&lt;!]."),
        ("{{#each xs}}x{{/each}}", {"xs": []}, ""), ("{{#with x}}{{this}}{{/with}}", {"x": "w"}, "w"), ("", {}, ""), ("{ { x } } {{ x}}", {"x": 5}, "{ { x } } 5"),
    ],
)
def test_rendered(spark, content, values, want):
    assert made(spark, content, values)["content"] == want


def test_what_conditions_hold(spark):
    variables = (Variable("n", "number"), Variable("b", "boolean", default="no"))
    content = "{{#if n}}n{{/if}}{{#if b}}b{{/if}}{{#if s}}s{{/if}}"
    assert [made(spark, content, v, variables)["content"] for v in ({"n": "0", "b": "off", "s": ""}, {"n": "2", "b": "on", "s": "false"}, {})] == ["", "nbs", "b"]


def test_types_defaults_and_what_is_missing(spark):
    variables = (
        Variable("n", "number", required=True), Variable("d", "date"), Variable("b", "boolean", default="x"), Variable("s", "select", options=("a", "b"), default="b"), Variable("r", required=True), Variable("e", required=True, default="e"),
    )
    content = "{{n}}|{{d}}|{{b}}|{{s}}|{{r}}|{{e}}|{{extra}}"
    row = made(spark, content, {"n": " 7.0 ", "d": "TOMORROW", "b": "On", "s": "a", "r": "r", "extra": "y"}, variables)
    assert row["content"] == "7|2024-03-02|true|a|r|e|y" and row["missing"] == [] and row["used"] == ["n", "d", "b", "s", "r", "extra"]
    row = made(spark, content, {"n": "x", "d": "never", "b": "maybe", "s": "c", "e": ""}, variables)
    assert row["content"] == "||x|b||e|" and row["missing"] == ["n", "d", "b", "s", "r"] and row["used"] == ["e"]


@pytest.mark.parametrize("content", ["{{#if a}}x", "{{#if a}}x{{/each}}", "{{/if}}", "{{#loop a}}{{/loop}}", "{{foo bar}}", "{{else}}"])
def test_what_cannot_be_compiled(spark, content):
    with pytest.raises(TemplateError):
        made(spark, content)


def test_checks_of_contents(spark):
    rows = ['{{a}} {{ b "x" }} {{#each c}}{{this}}{{/each}} {{@d}} {{lowercase e}}', "{{#if a}}", "{{/if}}", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select(used_variables(F.col("t")), syntax_error(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c", "d", "this"], None), (["a"], "Unclosed block helper: {{#if}}"), ([], "Mismatched block helpers"), ([], None)]
