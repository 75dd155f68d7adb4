"""Text functions on columns: slugs, links, escapes, redaction, colours, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that hold secrets, by substring.
SENSITIVE = ("token", "password", "secret", "apikey", "api_key", "authorization", "credential")
#: Colour names of chart parameters.
COLOURS = {
    "black": "#000000", "silver": "#C0C0C0", "gray": "#808080", "grey": "#808080", "white": "#FFFFFF", "maroon": "#800000",
    "red": "#FF0000", "purple": "#800080", "fuchsia": "#FF00FF", "green": "#008000", "lime": "#00FF00", "olive": "#808000",
    "yellow": "#FFFF00", "navy": "#000080", "blue": "#0000FF", "teal": "#008080", "aqua": "#00FFFF", "orange": "#FFA500",
}


def slug(text: Column, most: int = 100) -> Column:
    x = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, most)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def plain_excerpt(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def link_kind(target: Column) -> Column:
    """anchor, external, attachment or relative."""
    return (
        F.when(target.startswith("#"), "anchor").when(target.rlike(r"^(?i)([a-z][a-z0-9+.-]*:)?//|^(?i)(mailto|tel):"), "external")
        .when(target.rlike(r"(?i)\.(png|jpe?g|gif|svg|pdf|docx?|xlsx?|pptx?|zip)([?#].*)?$"), "attachment").otherwise("relative")
    )


def is_safe_link(href: Column) -> Column:
    """Control characters and blanks aside: empty is unsafe, without a scheme safe, else only known schemes are."""
    x = F.lower(F.regexp_replace(href, r"[\x00-\x20\x7F]", ""))
    scheme = F.regexp_extract(x, "^([a-z][a-z0-9+.-]*):", 1)
    return F.when(F.coalesce(x, F.lit("")) == "", False).when(scheme == "", True).otherwise(scheme.isin("http", "https", "mailto", "tel"))


def csv_value(text: Column) -> Column:
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def html_escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def words_of_camel_case(name: Column) -> Column:
    spaced = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1000))


def is_sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE))


def redacted_value(text: Column) -> Column:
    """Token-like values of more than 20 signs are hidden."""
    return F.when(text.rlike("^[A-Za-z0-9+/=_.-]{21,}$"), "[REDACTED]").otherwise(text)


def query_literal(text: Column) -> Column:
    """A quoted search literal: control characters become blanks, backslashes and quotes are escaped."""
    x = F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def file_size(n: Column) -> Column:
    kb, mb = n / 1024, n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def colour(text: Column) -> Column:
    """``#RRGGBB`` of three, six or eight hexadecimal digits, with or without ``#``, or of a colour name; null for anything else."""
    x = F.trim(text)
    digits = F.upper(F.regexp_replace(x, "^#", ""))
    names = F.create_map(*[F.lit(v) for pair in COLOURS.items() for v in pair])
    short = F.concat(F.lit("#"), *(F.repeat(F.substring(digits, i, 1), F.lit(2)) for i in (1, 2, 3)))
    return F.when(digits.rlike("^[0-9A-F]{6}([0-9A-F]{2})?$"), F.concat(F.lit("#"), F.substring(digits, 1, 6))).when(digits.rlike("^[0-9A-F]{3}$"), short).otherwise(F.try_element_at(names, F.lower(x)))


def file_name(text: Column) -> Column:
    """Base name without control characters; ``attachment`` where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^.*[/\\]", ""), r"[\x00-\x1F\x7F]", ""), r"^\.{1,2}$", "")
    return F.when(x == "", "attachment").otherwise(x)


def version_key(text: Column) -> Column:
    """Three numbers to order versions by."""
    parts = F.split(F.regexp_replace(text, "^v|-.*$", ""), r"\.")
    return F.transform(F.array(*(F.get(parts, i) for i in range(3))), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits count as numbers: each is written with its length in front."""
    return F.array_join(
        F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), ""
    )


def resolved_path(base: Column, target: Column) -> Column:
    """A relative link's path from the page at ``base``: ``.`` and ``..`` are worked off one by one."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.concat(folder, F.regexp_replace(target, "[#?].*$", "")), "/")
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(walked, "/")


def same_site(url: Column, site: Column) -> Column:
    """same, cross or unprovable, by scheme and host of both."""
    origin = lambda u: F.regexp_extract(F.lower(u), r"^(https?://[^/?#]+)", 1)
    a, b = origin(url), origin(site)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), "unprovable").when(a == b, "same").otherwise("cross")
