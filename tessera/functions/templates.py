"""Templates compiled once to column expressions: variables with types and defaults, helpers, conditions and lists.

A template is read on the driver into literal texts and columns; rendering a table is one projection. Values are
escaped for HTML as ``{{name}}`` and taken as they are as ``{{{name}}}``. What a template asks for and whether its
blocks are closed are column functions too, so whole tables of templates can be judged.

Defined cases: a null or empty value takes the default, in the template or of the variable; a value that is not of
its type counts as missing; an unknown name is empty; a date that is no date stays as it is. A condition holds for
every text but the empty one, and not for a boolean that is false, a number that is zero, or null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is escaped, the tokens of date formats, and the words of truth.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("`", "&#x60;"), ("=", "&#x3D;"))
_DATE_TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
_TRUE, _FALSE = ("true", "yes", "1", "on"), ("false", "no", "0", "off")
_TAG = re.compile(r"\{\{\{\s*(?P<raw>[^{}]+?)\s*\}\}\}|\{\{\s*(?P<tag>[^{}]+?)\s*\}\}")
_WORDS = re.compile(r'"[^"]*"|\S+')
_NAMES = r"[a-zA-Z_][a-zA-Z0-9_]*"


class TemplateError(ValueError):
    """A template that cannot be compiled."""


@dataclass(frozen=True)
class Variable:
    """``type`` is string, number, date, boolean or select (one of ``options``)."""

    name: str
    type: str = "string"
    required: bool = False
    default: str | None = None
    options: tuple[str, ...] = ()


def escaped(c: Column) -> Column:
    for sign, by in _ESCAPES:
        c = F.replace(c, F.lit(sign), F.lit(by))
    return c


def formatted(at: Column, pattern: str) -> Column:
    """A time in a format of YYYY, MM, DD, HH, mm and ss; of each only the first is filled in."""
    places = sorted((pattern.index(t), t) for t in _DATE_TOKENS if t in pattern)
    parts, done = [], 0
    for place, token in places:
        parts += [F.lit(pattern[done:place]), F.date_format(at, _DATE_TOKENS[token])]
        done = place + len(token)
    return F.concat(*parts, F.lit(pattern[done:]))


def checked(value: Column, v: Variable, as_of: Column) -> tuple[Column, Column]:
    """(text of the value, whether it is valid) of a variable."""
    text = value.cast("string")
    blank = text.isNull() | (text == "")
    number = F.trim(text).try_cast("double")
    if v.type == "number":
        shown, fine = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string")), number.isNotNull() & ~F.isnan(number)
    elif v.type == "date":
        day = {"today": 0, "yesterday": -1, "tomorrow": 1}
        relative = F.coalesce(*(F.when(F.lower(text) == w, F.date_format(F.date_add(as_of.cast("date"), n), "yyyy-MM-dd")) for w, n in day.items()))
        shown, fine = F.coalesce(relative, text), relative.isNotNull() | F.try_to_timestamp(text).isNotNull()
    elif v.type == "boolean":
        shown, fine = F.when(F.lower(text).isin(*_TRUE), "true").otherwise("false"), F.lower(text).isin(*_TRUE, *_FALSE)
    elif v.type == "select":
        shown, fine = text, text.isin(*v.options) if v.options else F.lit(False)
    else:
        shown, fine = text, F.lit(True)
    fallback = F.lit(v.default if v.default is not None else "")
    return F.when(~blank & F.coalesce(fine, F.lit(False)), shown).otherwise(fallback), F.when(blank, F.lit(not v.required or v.default is not None)).otherwise(F.coalesce(fine, F.lit(False)))


@dataclass
class Compiled:
    """A template over named columns."""

    content: str
    variables: tuple[Variable, ...] = ()
    builtins: dict[str, str | Column] = field(default_factory=dict)

    def columns(self, values: dict[str, Column], as_of: Column) -> dict[str, Column]:
        """content, missing (names without a valid value) and used (names that were given), from the values' columns."""
        known = {v.name: checked(values.get(v.name, F.lit(None).cast("string")), v, as_of) for v in self.variables}
        texts = {n: c for n, (c, _) in known.items()} | {n: c for n, c in values.items() if n not in known}
        given = lambda n: known[n][1] & (F.coalesce(values.get(n, F.lit(None)).cast("string"), F.lit("")) != "")
        self._false = {v.name: given(v.name) & ((texts[v.name] == "false") if v.type == "boolean" else (texts[v.name].try_cast("double") == 0)) for v in self.variables if v.type in ("boolean", "number")}
        names = lambda pairs: F.filter(F.array(*(F.when(keep, F.lit(n)) for n, keep in pairs)), lambda x: x.isNotNull()) if pairs else F.expr("cast(array() as array<string>)")
        missing = names([(n, ~valid) for n, (_, valid) in known.items()])
        used = names([(n, values[n].isNotNull() & (known[n][1] if n in known else F.lit(True))) for n in [*(n for n in known if n in values), *(n for n in values if n not in known)]])
        tokens = self._tokens()
        body, at = self._body(tokens, 0, None, texts)
        if at < len(tokens):
            raise TemplateError(f"{{{{{tokens[at][1]}}}}} closes nothing")
        return {"content": body, "missing": missing, "used": used}

    def _tokens(self) -> list[tuple[str, str]]:
        out, done = [], 0
        for m in _TAG.finditer(self.content):
            out += [("text", self.content[done : m.start()]), ("raw", m["raw"]) if m["raw"] else ("tag", m["tag"])]
            done = m.end()
        return [x for x in [*out, ("text", self.content[done:])] if x[1]]

    def _body(self, tokens, at: int, block: str | None, texts: dict[str, Column]) -> tuple[Column, int]:
        """The column of tokens up to the end of ``block`` (or its else), and the place of that token."""
        parts = [F.lit("")]
        while at < len(tokens):
            kind, said = tokens[at]
            if kind == "text":
                parts.append(F.lit(said))
            elif kind == "tag" and (said == "else" or said.startswith("/")):
                if said != "else" and said[1:].strip() != block or block is None:
                    break
                return F.concat(*parts), at
            elif kind == "tag" and said.startswith("#"):
                name, *rest = _WORDS.findall(said[1:])
                if name not in ("if", "unless", "each", "with") or len(rest) != 1:
                    raise TemplateError(f"unknown block {said!r}")
                column, at = self._block(name, rest[0], tokens, at + 1, texts)
                parts.append(column)
            else:
                value = self._value(said, texts)
                parts.append(F.coalesce(value if kind == "raw" else escaped(value), F.lit("")))
            at += 1
        if block is not None:
            raise TemplateError(f"Unclosed block helper: {{{{#{block}}}}}")
        return F.concat(*parts), at

    def _block(self, name: str, subject: str, tokens, at: int, texts: dict[str, Column]) -> tuple[Column, int]:
        value = self._named(subject, texts)
        if name == "each":
            # The body is compiled against an item, so it stands once in the plan.
            ends: list[int] = []

            def item(x: Column) -> Column:
                body, end = self._body(tokens, at, name, texts | {"this": x})
                ends.append(end)
                return body

            said = F.array_join(F.transform(F.coalesce(value, F.expr("cast(array() as array<string>)")), item), "")
            return said, ends[0]
        inside = texts | ({"this": value} if name == "with" else {})
        yes, at = self._body(tokens, at, name, inside)
        no = F.lit("")
        if tokens[at][1] == "else":
            no, at = self._body(tokens, at + 1, name, texts)
        truth = F.coalesce(value.cast("string") != "", F.lit(False)) & ~F.coalesce(self._false.get(subject, F.lit(False)), F.lit(False))
        return F.when(truth if name != "unless" else ~truth, yes).otherwise(no), at

    def _named(self, word: str, texts: dict[str, Column]) -> Column:
        if word.startswith('"'):
            return F.lit(word[1:-1])
        if word.startswith("@"):
            value = self.builtins.get(word[1:])
            return value if isinstance(value, Column) else F.lit(value).cast("string")
        return texts.get(word, F.lit(None).cast("string"))

    def _value(self, said: str, texts: dict[str, Column]) -> Column:
        first, *rest = _WORDS.findall(said)
        if first in ("lowercase", "uppercase") and len(rest) == 1:
            return (F.lower if first == "lowercase" else F.upper)(self._named(rest[0], texts).cast("string"))
        if first == "formatDate" and len(rest) == 2 and rest[1].startswith('"'):
            text = self._named(rest[0], texts).cast("string")
            return F.coalesce(formatted(F.try_to_timestamp(text), rest[1][1:-1]), text)
        value = self._named(first, texts).cast("string")
        if len(rest) == 1 and rest[0].startswith('"'):
            return F.when(value.isNull() | (value == ""), F.lit(rest[0][1:-1])).otherwise(value)
        if rest:
            raise TemplateError(f"unknown helper {said!r}")
        return value


def used_variables(content: Column) -> Column:
    """The names that a template asks for, each once: plain ones, subjects of blocks, and built-in ones."""
    patterns = (rf'\{{\{{\s*({_NAMES})\s*(?:"[^"]*")?\s*\}}\}}', rf"\{{\{{#(?:if|unless|each|with)\s+({_NAMES})", rf"\{{\{{\s*@({_NAMES})\s*\}}\}}")
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns))))


def syntax_error(content: Column) -> Column:
    """What is wrong with the blocks of a template; null where each is closed."""
    opened, closed = F.regexp_extract_all(content, F.lit(r"\{\{#(\w+)"), F.lit(1)), F.regexp_extract_all(content, F.lit(r"\{\{/(\w+)\}\}"), F.lit(1))
    unlike = F.filter(opened, lambda x, i: ~x.eqNullSafe(F.try_element_at(closed, i + 1)))
    return F.when(F.size(opened) != F.size(closed), F.when(F.size(unlike) > 0, F.concat(F.lit("Unclosed block helper: {{#"), F.element_at(unlike, 1), F.lit("}}"))).otherwise("Mismatched block helpers"))
