"""Hand-built cases that the tables do not hold: rounding, durations, dates, links, merges, colours."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import documents, macros, numbers, texts, times


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_halves_go_up(spark):
    assert one(spark, *(numbers.round_half_up(F.lit(x)) for x in (-2.5, 2.5, 0.5, -0.5))) == (-2, 3, 1, 0)
    assert one(spark, numbers.percent(F.lit(1.0), F.lit(0.0)), numbers.percent(F.lit(1.0), F.lit(8.0))) == (0, 13)


def test_points(spark):
    assert one(spark, *(numbers.leading_number(F.lit(x)) for x in ("3.5", "5 pts", "", "n/a", "-2x"))) == (3.5, 5.0, 0.0, 0.0, -2.0)
    assert one(spark, numbers.leading_number(F.lit(None).cast("string"))) == (0.0,)


@pytest.mark.parametrize(
    "text, seconds",
    [("1:30", 5400), ("1.5h", 5400), ("90m", 5400), ("1w 2d 3h 4m", 144000 + 57600 + 10800 + 240), ("1 hour 30 minutes", 5400), ("soon", None), ("", None), ("1:75", None)],
)
def test_durations(spark, text, seconds):
    assert one(spark, times.duration_seconds(F.lit(text))) == (seconds,)


def test_compact_durations(spark):
    assert one(spark, times.compact_duration(F.lit(5400)), times.compact_duration(F.lit(59)), times.spoken_duration(F.lit(3660))) == ("1h 30m", "0m", "1 hour 1 minute")


def test_month_arithmetic_runs_on(spark):
    day = lambda t, n: times.months_before(F.lit(t).cast("timestamp"), n).cast("string")
    assert one(spark, day("2001-03-31", 1), day("2000-03-30", 1), day("2001-08-02", 12)) == ("2001-03-03", "2000-03-01", "2000-08-02")
    months = lambda a, b: times.months_between_calendar(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))
    assert one(spark, months("2001-01-31", "2001-02-01"), months("2001-05-01", "2001-02-01")) == (1, 0)


def test_links(spark):
    safe = lambda x: texts.is_safe_link(F.lit(x))
    assert one(spark, safe("java\tscript:x"), safe("#a"), safe(""), safe("HTTPS://x"), safe("mailto:a")) == (False, True, False, True, True)
    assert one(spark, texts.resolved_path(F.lit("a/b/c.md"), F.lit("../d/./e.md#x")), texts.resolved_path(F.lit("c.md"), F.lit("../../e.md"))) == ("a/d/e.md", "e.md")
    links = documents.markdown_links("`[a](b)`\n```\n[c](d)\n```\n![i](x.png) [t](u.md) [m](mailto:x)")
    assert [(x["target"], x["line"]) for x in links] == [("u.md", 5), ("mailto:x", 5)]


def test_locale_numbers(spark):
    n = lambda x, loc, **k: numbers.localized_number(F.lit(x), loc, **k)
    assert one(spark, n("1.234,5", "de-DE"), n("12%", "en"), n("1,234.5", "en"), n("x", "en"), n("EUR 1.5", "en", forgiving=True)) == (1234.5, 0.12, 1234.5, None, 1.5)


def test_colours(spark):
    assert one(spark, *(texts.colour(F.lit(x)) for x in ("#abc", "AABBCC80", "red", "Fuchsia", "nope"))) == ("#AABBCC", "#AABBCC", "#FF0000", "#FF00FF", None)


def test_merges():
    m = documents.merge_three
    assert m("a\nb\nc", "a\nb\nc", "a\nx\nc") == {"text": "a\nx\nc", "conflicts": 0}
    assert m("a\nb\nc", "a\ny\nc", "a\ny\nc")["conflicts"] == 0
    both = m("a\nb\nc\nd\ne", "A\nb\nc\nd\ne", "a\nb\nc\nd\nE")
    assert both == {"text": "A\nb\nc\nd\nE", "conflicts": 0}
    clash = m("a\nb\nc", "a\nx\nc", "a\ny\nc")
    assert clash["conflicts"] == 1 and documents.resolve_conflicts(clash["text"], "local") == "a\nx\nc"
    assert documents.resolve_conflicts(clash["text"], "remote") == "a\ny\nc"


def test_ignore_patterns():
    i = documents.ignored
    assert i("a/b.log", ["*.log"]) and not i("a/keep.log", ["*.log", "!keep.log"]) and i("build/x", ["build/"]) and not i("build", ["build/"])
    assert i("docs/a.md", ["/docs/*.md"]) and not i("x/docs/a.md", ["/docs/*.md"])


def test_hosts_and_secrets():
    assert all(map(documents.private_host, ("localhost", "127.0.0.1", "10.0.0.1", "::ffff:192.168.0.1", "fe80::1"))) and not documents.private_host("1.1.1.1")
    assert documents.redacted({"Authorization": "Basic abc", "a": [{"password": "x"}]}) == {"Authorization": "Basic [REDACTED]", "a": [{"password": "[REDACTED]"}]}
    assert documents.fnv1a("a") == "e40c292c" and documents.canonical_json('{"b":[1, 2],"a":null}') == '{"a":null,"b":[1,2]}'


def test_null_texts(spark):
    for name, (function, returns) in documents.COLUMNS.items():
        n = function.__code__.co_argcount - len(function.__defaults__ or ())
        row = spark.range(1).select(documents.column(function, returns)(*[F.lit(None).cast("string")] * n).alias("x")).first()
        assert row["x"] is None or all(v is None for v in row["x"])


def test_anchors():
    a = documents.anchor_id
    assert a("Größe\u0007 / Maß") == "gro-e-ma" and a("  ") == "anchor"
    long = a("x" * 50)
    assert len(long) <= 40 and long.startswith("xxx") and long != a("x" * 51)
    found = documents.unique_anchors(["A B", "A_B", "A_B", None, ""])
    assert found[0] == "a-b" and len(set(found)) == 5 and all(len(x) <= 40 for x in found)
    assert documents._hash_of_units("a") == documents._base36(0xE40C292C)


def test_emoji(spark):
    assert one(spark, *(macros.emoji_name(F.lit(x)) for x in (":Smile:", "+1", "::x::", " x", "check_mark"))) == ("smile", "thumbs-up", None, None, None)
    shown = [macros.emoji_text(F.lit(a), F.lit(b).cast("string")) for a, b in ((":check_mark:", None), (":x:", "no"), (":x:", ":y:"), (":new:", ""))]
    assert one(spark, *shown) == ("✓", "no", "✕", ":new:")


def test_placeholders(spark):
    texts = ("$scroll.title", "$scroll.title.(a)", "$scroll.pageproperty.(k,true)", "$scroll.metadata.x", "$scroll.customer", "$scroll.custom", "$scroll.spacelogo.(1,2)", None)
    got = one(spark, *(macros.placeholder(F.lit(x).cast("string"))["status"] for x in texts), *(macros.placeholder(F.lit(x).cast("string"))["dependency"] for x in texts))
    assert got[:8] == ("supported", "supported", "supported", "unsupported", "unsupported", "never", "supported", None)
    assert got[8:] == ("none", "none", "spaceHomepage", "none", "none", "none", "spaceLogo", None)
    args = one(spark, *(macros.property_arguments(F.lit(x)) for x in ("x.(k, 'm',true,\"alt\")", "x.(k,false)", "x", "x.(a(b)c)")))
    assert [tuple(a) for a in args] == [("k", "m", True, "alt"), ("k", None, False, None), ("", None, False, None), ("a(b)c", None, False, None)]


def test_whiteboards(spark):
    site, good = F.lit("https://a.example"), "/wiki/spaces/AB/whiteboard/12"
    cases = {
        good: None, f"https://A.example{good}?q": None, f"http://a.example{good}": "unsupported-scheme", f"//a.example{good}": "protocol-relative", f"x{good}": "unsafe-relative", "": "missing-url",
        "/wiki/spaces/AB/whiteboard/1%2F2": "malformed-route", "/wiki/spaces/A_B/whiteboard/1": "invalid-space-key", "/wiki/spaces/AB/whiteboard/x": "invalid-whiteboard-id", "/a/%2e%2E/b": "malformed-url", "/a b": "malformed-url",
        "/wiki/spaces/%zz/whiteboard/1": "malformed-route",
    }
    assert one(spark, *(macros.whiteboard_target(F.lit(x), site)["reason"] for x in cases)) == tuple(cases.values())
    refused = one(spark, *(macros.whiteboard_target(F.lit(good), F.lit(x).cast("string"))["reason"] for x in (None, "http://a.example", "https://u:p@a.example", "x")))
    assert set(refused) == {"trusted-site-unavailable"}
    assert one(spark, macros.whiteboard_target(F.lit(good), site)["url"]) == (f"https://a.example{good}",)


def test_pie_labels_and_dates(spark):
    label = lambda f, v, t: macros.pie_label(F.lit(f), F.lit("L"), F.lit(v), F.lit(t))
    assert one(spark, label("%0% %1% %2%", 2.50, 20.0), label("%1%", 12345678, 1), label("%2%", 0, 0), label("%1% %1%", 100.0, 1.0)) == ("L 2.5 13%", "12345678", "NaN%", "100 100")
    at = F.lit("2024-03-05 06:07:08").cast("timestamp")
    forms = {"d.M.yy H:m:s": "5.3.24 6:07:08".replace("6:07:08", "6:7:8"), "'on' dd''MM": "on 05'03", "Q QQ QQQ QQQQ": "1 01 Q1 1st quarter", "yyy": "2024-03-05", "": "2024-03-05", "HH'open": "06open"}
    assert one(spark, *(macros.simple_date(at, f) for f in forms)) == tuple(forms.values())
