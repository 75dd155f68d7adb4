"""Number functions with the rounding and parsing rules that the reports state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5): halves go up, also below zero (-2.5 gives -2)."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent of a positive whole, else 0."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0)).cast("long")


def leading_number(text: Column) -> Column:
    """The number that a text begins with; 0 where there is none."""
    head = F.regexp_extract(text, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    return F.coalesce(F.nullif(head, F.lit("")).try_cast("double"), F.lit(0.0))


#: Decimal and grouping signs by language.
SEPARATORS = {"en": (".", ","), "de": (",", "."), "fr": (",", " "), "es": (",", "."), "de-CH": (".", "'"), "sv": (",", " ")}


def localized_number(text: Column, locale: str, forgiving: bool = False) -> Column:
    """A number in a locale's notation; percents are hundredths, currency signs and (forgiving) other text are dropped."""
    decimal, group = SEPARATORS.get(locale, SEPARATORS.get(locale.split("-")[0], SEPARATORS["en"]))
    x = F.trim(F.regexp_replace(text, "[  ]", " "))
    is_percent = x.endswith("%")
    x = F.regexp_replace(x, "[%$€£¥]", "")
    if forgiving:
        x = F.regexp_replace(x, r"[^0-9.,' +\-]", "")
    x = F.replace(F.replace(F.trim(x), F.lit(group), F.lit("")), F.lit(decimal), F.lit("."))
    number = F.when(F.trim(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.trim(x).try_cast("double"))
    return F.when(is_percent, number / 100).otherwise(number)
