"""Issue and content searches: typed conditions become a predicate, and the query text that says the same."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.times import search_date


def quoted(value: str) -> str:
    clean = "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in value)
    return '"' + clean.replace("\\", "\\\\").replace('"', '\\"') + '"'


@dataclass(frozen=True)
class ContentSearch:
    """Conditions of a content search; all must hold."""

    text: str | None = None
    title: str | None = None
    spaces: Sequence[str] = ()
    types: Sequence[str] = ("page",)
    labels: Sequence[str] = ()
    creator: str | None = None
    modified_since: str | None = None
    created_since: str | None = None
    ancestor: int | None = None

    def query_text(self) -> str:
        parts = []
        if self.text:
            parts.append(f"text ~ {quoted(self.text)}")
        for name, values in (("space", self.spaces), ("type", self.types)):
            if len(values) == 1:
                parts.append(f"{name} = {quoted(values[0])}")
            elif values:
                parts.append(f"{name} IN ({', '.join(map(quoted, values))})")
        parts += [f"label = {quoted(x)}" for x in self.labels]
        if self.title:
            parts.append(f"title ~ {quoted(self.title)}")
        if self.creator:
            parts.append("creator = currentUser()" if self.creator == "me" else f"creator = {quoted(self.creator)}")
        if self.modified_since:
            parts.append(f"lastModified >= {quoted(self.modified_since)}")
        if self.created_since:
            parts.append(f"created >= {quoted(self.created_since)}")
        if self.ancestor is not None:
            parts.append(f"ancestor = {self.ancestor}")
        return " AND ".join(parts)

    def apply(self, pages: DataFrame, labels: DataFrame, as_of: str, me: str | None = None) -> DataFrame:
        now = F.lit(as_of).cast("timestamp")
        terms: list[Column] = []
        if self.text:
            terms.append(F.contains(F.lower(F.concat_ws(" ", "title", "body")), F.lit(self.text.lower())))
        if self.title:
            terms.append(F.contains(F.lower("title"), F.lit(self.title.lower())))
        if self.spaces:
            terms.append(F.col("space_key").isin(list(self.spaces)))
        if self.types:
            terms.append(F.col("content_type").isin(list(self.types)))
        if self.creator:
            terms.append(F.col("created_by") == (me if self.creator == "me" else self.creator))
        if self.modified_since:
            terms.append(F.col("last_modified") >= search_date(self.modified_since, now))
        if self.created_since:
            terms.append(F.col("created_at") >= search_date(self.created_since, now))
        if self.ancestor is not None:
            terms.append(F.array_contains("ancestors", F.lit(self.ancestor).cast("long")))
        found = pages.filter(reduce(Column.__and__, terms, F.lit(True)))
        for label in self.labels:
            found = found.join(labels.filter(F.col("label") == label), "page_id", "left_semi")
        return found


@dataclass(frozen=True)
class IssueSearch:
    """Conditions of an issue search."""

    statuses: Sequence[str] = ()
    priorities: Sequence[str] = ()
    assignee: str | None = None
    unresolved: bool = False
    sprint: int | str | None = None
    order: str = "created"
    extra: dict = field(default_factory=dict)

    def query_text(self) -> str:
        parts = []
        for name, values in (("status", self.statuses), ("priority", self.priorities)):
            if len(values) == 1:
                parts.append(f"{name} = {quoted(values[0])}")
            elif values:
                parts.append(f"{name} IN ({', '.join(map(quoted, values))})")
        if self.assignee:
            parts.append("assignee = currentUser()" if self.assignee == "me" else f"assignee = {quoted(self.assignee)}")
        if self.unresolved:
            parts.append("resolution = Unresolved")
        if self.sprint is not None:
            parts.append("sprint in openSprints()" if self.sprint == "current" else f"sprint = {self.sprint}")
        return (" AND ".join(parts) + f" ORDER BY {self.order} DESC").strip()

    def apply(self, issues: DataFrame, me: str | None = None, open_sprints: Sequence[int] = ()) -> DataFrame:
        terms: list[Column] = []
        if self.statuses:
            terms.append(F.col("status_category").isin(list(self.statuses)))
        if self.priorities:
            terms.append(F.col("priority").isin(list(self.priorities)))
        if self.assignee:
            terms.append(F.col("assignee") == (me if self.assignee == "me" else self.assignee))
        if self.unresolved:
            terms.append(F.col("status_category") != "done")
        if self.sprint is not None:
            terms.append(F.col("sprint_id").isin(list(open_sprints)) if self.sprint == "current" else F.col("sprint_id") == self.sprint)
        return issues.filter(reduce(Column.__and__, terms, F.lit(True)))


class Refused(ValueError):
    """A source definition holds a filter that would be lost: the result would be wider than what was asked."""


#: Filters of a content source that can be kept.
KNOWN_FILTERS = {"searchString", "spaceKeys", "contentTypes", "labels", "contributorIds", "ancestorIds", "lastModified", "title"}


def search_from_source(parameters: dict) -> ContentSearch:
    """A content search from a source definition; refuses what it does not know, and what asks for everything."""
    meant = {k: v for k, v in parameters.items() if v not in (None, "", [], {})}
    if unknown := set(meant) - KNOWN_FILTERS:
        raise Refused(f"unknown filters: {', '.join(sorted(unknown))}")
    if not meant:
        raise Refused("no filter at all")
    if len(meant.get("contributorIds", [])) > 1 or len(meant.get("ancestorIds", [])) > 1:
        raise Refused("several contributors or ancestors")
    return ContentSearch(
        text=meant.get("searchString"), title=meant.get("title"), spaces=tuple(meant.get("spaceKeys", ())), types=tuple(meant.get("contentTypes", ())), labels=tuple(meant.get("labels", ())),
        creator=next(iter(meant.get("contributorIds", ())), None), ancestor=next(iter(meant.get("ancestorIds", ())), None), modified_since=meant.get("lastModified"),
    )
