"""Markdown and storage: by hand, and back and forth until nothing changes."""

import random

import pytest

from tessera.operators import markdown

CASES = [
    ("# One *two*\ntext `a*b*` **c**\nmore\n\n---\n> q1\n> q2", "<h1>One <em>two</em></h1><p>text <code>a*b*</code> <strong>c</strong>\nmore</p><hr/><blockquote><p>q1\nq2</p></blockquote>", "# One *two*\n\ntext `a*b*` **c**\nmore\n\n---\n\n> q1\n> q2"),
    ("- a\n  - b\n    1. c\n      - d\n- e\n1. f\n2. g", "<ul><li>a<ul><li>b<ol><li>c<ul><li>d</li></ul></li></ol></li></ul></li><li>e</li></ul><ol><li>f</li><li>g</li></ol>", "- a\n  - b\n    1. c\n      - d\n- e\n\n1. f\n2. g"),
    ("```py\nx = '<a>'\n\n# no ]]> end\n```\nafter", '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[x = \'<a>\'\n\n# no ]]]]><![CDATA[> end]]></ac:plain-text-body></ac:structured-macro><p>after</p>', "```py\nx = '<a>'\n\n# no ]]> end\n```\n\nafter"),
    ("| a | b |\n|---|:-:|\n| 1 | [x](http://y/?a=1&b) |\n|  | ![i](p.png) |", '<table><tbody><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><a href="http://y/?a=1&amp;b">x</a></td></tr><tr><td></td><td><ac:image ac:alt="i"><ri:attachment ri:filename="p.png"/></ac:image></td></tr></tbody></table>', "| a | b |\n|---|---|\n| 1 | [x](http://y/?a=1&b) |\n|  | ![i](p.png) |"),
    ("a < b & c\r\n~~old~~ 2 * 3 * 4", "<p>a &lt; b &amp; c\n<del>old</del> 2 * 3 * 4</p>", "a < b & c\n~~old~~ 2 * 3 * 4"),
    ("```\nopen", '<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[open]]></ac:plain-text-body></ac:structured-macro>', "```\nopen\n```"), ("", "", ""), (None, "", ""), ("|---|\n\nx", "<p>x</p>", "x"), ("      - deep\n - x", "<ul><li>deep</li><li>x</li></ul>", "- deep\n- x"),
]


def both(spark, texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    made = spark.createDataFrame(markdown.to_storage(pages, "text").collect(), "page_id long, storage string")
    back = {r["page_id"]: r["markdown"] for r in markdown.to_markdown(made, "storage").collect()}
    return {r["page_id"]: r["storage"] for r in made.collect()}, back


def test_by_hand(spark):
    storage, back = both(spark, [c[0] for c in CASES])
    assert [storage[i] for i in range(len(CASES))] == [c[1] for c in CASES]
    assert [back[i] for i in range(len(CASES))] == [c[2] for c in CASES]


PIECES = ["# h", "## *x* y", "text", "**b** and `c`", "- a", "  - b", "    - c", "1. n", "   2) m", "> q", ">> q", ">", "", "", "```", "```js", "| a | b |", "|---|---|", "| **x** |", "---", "***", "[t](u)", "![a](http://b/c)", "a * b * c", "***x***", "`", "``", "&amp; <b>", "*a* _b_ ~~c~~", "  indented", "\ttab", "- [x](y) `z`", "1.no", "#no", "é 日本 𓀀"]


@pytest.mark.parametrize("seed", [1, 2])
def test_what_comes_back_is_a_fixed_point(spark, seed):
    r = random.Random(seed)
    texts = ["\n".join(r.choice(PIECES) for _ in range(r.randrange(1, 14))) for _ in range(400)]
    storage, once = both(spark, texts)
    again, twice = both(spark, [once[i] for i in range(len(texts))])
    for i in range(len(texts)):
        assert once[i] == twice[i], (texts[i], storage[i], once[i], again[i])
        assert storage[i] == again[i] or once[i] != texts[i]
