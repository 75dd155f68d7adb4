"""Column functions of page macros: emoji names, placeholders, whiteboard targets, pie labels, date patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Emoji names and the text that each stands for.
EMOJI = {
    "smile": "☺", "sad": "☹", "cheeky": "😛", "laugh": "😄", "wink": "😉", "thumbs-up": "👍", "thumbs-down": "👎", "tick": "✓",
    "cross": "✕", "warning": "⚠", "information": "ℹ", "question": "❓", "light-on": "💡", "light-off": "○", "yellow-star": "Y★",
    "red-star": "R★", "green-star": "G★", "blue-star": "B★", "heart": "♥", "broken-heart": "💔", "plus": "✚", "minus": "−",
}
#: Other names that authors write.
EMOJI_ALIASES = {
    "+1": "thumbs-up", "thumbsup": "thumbs-up", "-1": "thumbs-down", "thumbsdown": "thumbs-down", "check": "tick", "white_check_mark": "tick",
    "heavy_check_mark": "tick", "x": "cross", "heavy_multiplication_x": "cross", "bulb": "light-on", "idea": "light-on", "lightbulb": "light-on",
    "star": "yellow-star", "info": "information", "warn": "warning", "alert": "warning", "grinning": "smile", "grin": "smile", "smiley": "smile",
    "disappointed": "sad", "cry": "sad", "stuck_out_tongue": "cheeky", "joy": "laugh", "laughing": "laugh", "love": "heart", "red_heart": "heart",
}
#: Names that only typed sources use.
EMOJI_TYPED = {
    "check_mark": "tick", "cross_mark": "cross", "question_mark": "question", "light_bulb_on": "light-on", "light_bulb_off": "light-off",
    "yellow_star": "yellow-star", "red_star": "red-star", "green_star": "green-star", "blue_star": "blue-star",
}
#: Placeholders by what is fetched to resolve them.
PLACEHOLDERS = {
    "none": (
        "$scroll.title", "$scroll.version", "$scroll.pageid", "$scroll.pageurl", "$scroll.tinyurl", "$scroll.pagelabels", "$scroll.pagelabels.capitalised",
        "$scroll.creator", "$scroll.creator.fullName", "$scroll.creator.email", "$scroll.creator.name", "$scroll.modifier", "$scroll.modifier.fullName",
        "$scroll.modifier.email", "$scroll.modifier.name", "$scroll.creationdate", "$scroll.modificationdate", "$scroll.exportdate", "$scroll.space.key",
        "$scroll.template.name", "$scroll.template.modificationdate", "$scroll.content",
    ),
    "space": ("$scroll.space.name", "$scroll.space.url"),
    "currentUser": ("$scroll.exporter", "$scroll.exporter.fullName", "$scroll.exporter.email", "$scroll.exporter.name"),
    "owner": ("$scroll.pageowner.fullName",),
    "spaceLogo": ("$scroll.spacelogo", "$scroll.globallogo"),
    "includePage": ("$scroll.includepage",),
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _is_short_name(text: Column) -> Column:
    return text.rlike(r"(?U)^:[^\s]+:$")


def emoji_name(text: Column, typed: bool = False) -> Column:
    """The name that a short name or alias stands for; one pair of colons is taken off, blanks are not; null if unknown."""
    key = F.lower(F.when(_is_short_name(text), F.regexp_replace(text, "^:|:$", "")).otherwise(text))
    known = {**(EMOJI_TYPED if typed else {}), **EMOJI_ALIASES, **{k: k for k in EMOJI}}
    return _looked_up(known, key)


def emoji_text(short_name: Column, source: Column) -> Column:
    """What a typed emoji shows: its source text if that is more than a short name, else the known sign, else the short name."""
    written = (F.coalesce(source, F.lit("")) != "") & ~_is_short_name(source)
    return F.when(written, source).otherwise(F.coalesce(_looked_up(EMOJI, emoji_name(short_name, typed=True)), short_name))


def _arguments(raw: Column) -> Column:
    """The arguments between the first and the last bracket, without blanks and quotes around each; null without brackets."""
    inner = F.when(raw.rlike(r"(?s)^[^(]*\(.*\)"), F.regexp_extract(raw, r"(?s)^[^(]*\((.*)\)", 1))
    return F.transform(F.split(inner, ","), lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), "^[\"']|[\"']$", ""))


def property_arguments(raw: Column) -> Column:
    """key, macro_id, fallback and alternate text of a page-property placeholder; a boolean second argument is the fallback flag."""
    a = _arguments(raw)
    at = lambda i: F.get(a, i)
    flag = F.coalesce(at(1).isin("true", "false"), F.lit(False))
    some = lambda c: F.when(~flag & (c != ""), c)
    return F.struct(
        F.coalesce(at(0), F.lit("")).alias("key"), some(at(1)).alias("macro_id"),
        F.coalesce(F.when(flag, at(1) == "true").otherwise(at(2) == "true"), F.lit(False)).alias("fallback"), some(at(3)).alias("alternate"),
    )


def placeholder(raw: Column) -> Column:
    """base, status (supported, unsupported, never) and dependency of a placeholder with or without arguments."""
    base = F.regexp_replace(F.regexp_replace(raw, r"(?s)\(.*$", ""), r"\.$", "")
    needs = _looked_up({name: kind for kind, names in PLACEHOLDERS.items() for name in names}, base)
    needs = F.when(base == "$scroll.pageproperty", F.when(property_arguments(raw)["fallback"], "spaceHomepage").otherwise("none")).otherwise(needs)
    status = F.when(needs.isNotNull(), "supported").when(base.rlike(r"(?s)^\$scroll\.custom(\..*)?$"), "never").when(raw.isNotNull(), "unsupported")
    return F.struct(base.alias("base"), status.alias("status"), F.when(raw.isNotNull(), F.coalesce(needs, F.lit("none"))).alias("dependency"))


def whiteboard_target(raw: Column, site: Column) -> Column:
    """url and reason: the canonical target of an embedded whiteboard on the trusted site, or why it is refused.

    ``https:`` without two slashes after it counts as malformed.
    """
    origin = lambda u: F.regexp_replace(F.lower(F.nullif(F.regexp_extract(u, r"(?i)^(https://[^/?#@\\\s]+)([/?#]|$)", 1), F.lit(""))), ":443$", "")
    x, trusted = F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), origin(site)
    has_scheme = x.rlike("(?i)^[a-z][a-z0-9+.-]*:")
    full = F.when(has_scheme, x).otherwise(F.concat(trusted, x))
    host = F.regexp_extract(full, r"(?i)^https://([^/?#]*)", 1)
    path = F.regexp_extract(full, r"(?i)^https://[^/?#]*([^?#]*)", 1)
    route = r"^/wiki/spaces/([^/]+)/whiteboard/([^/]+)/?$"
    part = lambda i: F.try_url_decode(F.replace(F.regexp_extract(path, route, i), F.lit("+"), F.lit("%2B")))
    space, board = part(1), part(2)
    reason = (
        F.when(F.coalesce(x, F.lit("")) == "", "missing-url").when(trusted.isNull(), "trusted-site-unavailable").when(x.startswith("//"), "protocol-relative")
        .when(x.rlike(r"[\x00-\x20\x7f\\]") | x.rlike(r"(?i)^([^?#]*/)?(\.{1,2}|%2e(%2e)?)([/?#]|$)"), "malformed-url")
        .when(~has_scheme & ~x.startswith("/"), "unsafe-relative").when(has_scheme & ~x.rlike("(?i)^https:"), "unsupported-scheme").when(host == "", "malformed-url")
        .when(host.contains("@"), "credentials").when(x.contains("#"), "fragment").when(~origin(full).eqNullSafe(trusted), "cross-site")
        .when(~path.rlike(route) | space.isNull() | board.isNull() | space.rlike(r"[/\\]") | board.rlike(r"[/\\]"), "malformed-route")
        .when(~space.rlike("(?i)^~?[a-z0-9]{1,255}$"), "invalid-space-key").when(~board.rlike("^[1-9][0-9]*$"), "invalid-whiteboard-id")
    )
    return F.struct(F.when(reason.isNull(), F.concat(trusted, F.lit("/wiki/spaces/"), space, F.lit("/whiteboard/"), board)).alias("url"), reason.alias("reason"))


def _plain_number(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def pie_label(pattern: Column, label: Column, value: Column, total: Column) -> Column:
    """``%0%`` is the label, ``%1%`` the value, ``%2%`` the rounded share; no pattern stands for ``%0%``."""
    share = F.when(total == 0, "NaN%").otherwise(F.concat(F.floor(F.try_divide(value, total) * 100 + 0.5).cast("string"), F.lit("%")))
    text = F.replace(F.coalesce(pattern, F.lit("%0%")), F.lit("%0%"), label)
    return F.replace(F.replace(text, F.lit("%1%"), _plain_number(value)), F.lit("%2%"), share)


def simple_date(ts: Column, pattern: str | None = None) -> Column:
    """A time by a pattern of the fields y M d H m s Q, quoted text and other signs; the ISO date for no or an unknown pattern.

    The pattern is read once, so the result is one built-in expression.
    """
    iso = F.date_format(ts, "yyyy-MM-dd")
    if not (pattern or "").strip():
        return iso
    quarter = F.quarter(ts)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = {"M": F.month(ts), "d": F.day(ts), "H": F.hour(ts), "m": F.minute(ts), "s": F.second(ts), "Q": quarter}
    fields = {"yyyy": F.year(ts).cast("string"), "yy": two(F.year(ts) % 100)}
    fields |= {k: c.cast("string") for k, c in parts.items()} | {k * 2: two(c) for k, c in parts.items()}
    fields |= {"QQQ": F.concat(F.lit("Q"), quarter), "QQQQ": F.concat(F.element_at(F.array(*map(F.lit, ("1st", "2nd", "3rd", "4th"))), quarter), F.lit(" quarter"))}
    out = []
    for m in re.finditer(r"''|'(?P<quoted>[^']*)'?|(?P<field>([A-Za-z])\3*)|[^A-Za-z']+", pattern):
        if m["field"]:
            if m["field"] not in fields:
                return iso
            out.append(fields[m["field"]])
        else:
            out.append(F.lit("'" if m.group() == "''" else m.group() if m["quoted"] is None else m["quoted"]))
    return F.when(ts.isNotNull(), F.concat(*out))
