"""What the address of a page of the content or work-tracking product names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISSUE = r"((?:[A-Z][A-Z0-9]+)-\d+)"
#: Fixed values: (product, type, where to look, pattern, fields of its groups); the first that matches holds.
PATTERNS = [
    ("content", "blogpost", "path", r"/spaces/([^/]+)/blog/\d{4}/\d{2}/\d{2}/(\d+)", ("space_key", "id")), ("content", "page", "path", r"/spaces/([^/]+)/pages/(\d+)", ("space_key", "id")),
    ("content", "space", "path", r"/spaces/([^/]+?)(?:/overview)?/?$", ("space_key",)), ("content", "space", "path", r"(?:^|/)display/([^/]+)(?:/|$)", ("space_key",)),
    ("work", "issue", "path", rf"(?:^|/)browse/{_ISSUE}", ("id",)), ("work", "board", "path", r"/jira/software/(?:c/)?projects/([A-Z][A-Z0-9]+)/boards/(\d+)", ("space_key", "id")),
    ("work", "issue", "whole", rf"[?&]selectedIssue={_ISSUE}", ("id",)), ("content", "page", "whole", r"(?:/wiki/|/pages/|/display/|viewpage\.action)[^?#]*[?&][^#]*?\bpageId=(\d+)", ("id",)),
]


def entity(url: Column) -> Column:
    """A struct of product, type, space_key (or project) and id; null where the address names nothing known or is none."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    asked = F.try_parse_url(url, F.lit("QUERY"))
    whole = F.concat(path, F.coalesce(F.concat(F.lit("?"), asked), F.lit("")))
    out = None
    for product, kind, where, pattern, fields in PATTERNS:
        at = path if where == "path" else whole
        of = lambda name: F.regexp_extract(at, pattern, fields.index(name) + 1) if name in fields else F.lit(None).cast("string")  # noqa: B023, E731
        key = F.split_part(of("id"), F.lit("-"), F.lit(1)) if kind == "issue" else of("space_key")
        found = F.struct(F.lit(product).alias("product"), F.lit(kind).alias("type"), key.alias("space_key"), of("id").alias("id"))
        hit = at.rlike(pattern)
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), out)
