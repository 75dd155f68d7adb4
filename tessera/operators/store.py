"""The relational store of pages, links, labels, users and contributors: scans, filters, writes.

Each function takes and returns DataFrames; writes are new versions of a table, never changes in place.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSET = object()


@dataclass(frozen=True)
class PageFilter:
    """Filters of a page scan; unset fields filter nothing. ``parent_id=None`` means pages without parent,
    and the bounds treat 0 as unset."""

    space_key: str | None = None
    parent_id: object = UNSET
    sync_state: str | Sequence[str] | None = None
    content_status: str | Sequence[str] | None = None
    content_type: str | Sequence[str] | None = None
    created_by: str | None = None
    last_modified_by: str | None = None
    modified_before: str | None = None
    modified_since: str | None = None
    created_before: str | None = None
    created_since: str | None = None
    path_prefix: str | None = None
    is_restricted: bool | None = None
    has_attachments: bool | None = None
    label: str | None = None
    min_version_count: int | None = None
    min_word_count: int | None = None
    max_word_count: int | None = None
    include_inaccessible: bool = False

    def predicate(self) -> Column:
        """The filters as one predicate, which reaches the scan; the label is a semi-join of its own."""
        terms: list[Column] = [] if self.include_inaccessible else [~F.col("inaccessible")]
        for name in ("space_key", "created_by", "last_modified_by", "is_restricted", "has_attachments"):
            if (value := getattr(self, name)) is not None:
                terms.append(F.col(name) == F.lit(value))
        for name in ("sync_state", "content_status", "content_type"):
            if (value := getattr(self, name)) is not None:
                terms.append(F.col(name) == value if isinstance(value, str) else F.col(name).isin(list(value)))
        if self.parent_id is not UNSET:
            terms.append(F.col("parent_id").isNull() if self.parent_id is None else F.col("parent_id") == F.lit(self.parent_id))
        for name, column in (("modified", "last_modified"), ("created", "created_at")):
            if (value := getattr(self, f"{name}_before")) is not None:
                terms.append(F.col(column) < F.lit(value).cast("timestamp"))
            if (value := getattr(self, f"{name}_since")) is not None:
                terms.append(F.col(column) > F.lit(value).cast("timestamp"))
        if self.path_prefix:
            terms.append(F.col("path").startswith(self.path_prefix))
        if self.min_version_count:
            terms.append(F.col("version_count") >= self.min_version_count)
        if self.min_word_count:
            terms.append(F.col("word_count") >= self.min_word_count)
        if self.max_word_count:
            terms.append(F.col("word_count") <= self.max_word_count)
        return reduce(Column.__and__, terms, F.lit(True))


def list_pages(pages: DataFrame, f: PageFilter = PageFilter(), labels: DataFrame | None = None) -> DataFrame:
    found = pages.filter(f.predicate())
    if f.label is not None:
        if labels is None:
            raise ValueError("a label filter needs the labels table")
        found = with_label(found, labels, f.label)
    return found


def with_label(pages: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    return pages.join(labels.filter(F.col("label") == label), "page_id", "left_semi")


def page_slice(pages: DataFrame, offset: int = 0, limit: int | None = None, key: str = "page_id") -> DataFrame:
    """Paging over a stated key: without one the pages of two calls could overlap."""
    ordered = pages.orderBy(key)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered.limit(limit) if limit else ordered


def scope(pages: DataFrame, *, page_id: int | None = None, ancestor_id: int | None = None, space_key: str | None = None) -> DataFrame:
    """The narrowest stated scope wins: page, then tree, then space."""
    if page_id is not None:
        return pages.filter(F.col("page_id") == page_id)
    if ancestor_id is not None:
        return pages.filter((F.col("page_id") == ancestor_id) | F.array_contains("ancestors", F.lit(ancestor_id).cast("long")))
    return pages if space_key is None else pages.filter(F.col("space_key") == space_key)


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """``incoming`` replaces rows of equal key; the ``keep`` columns of a replaced row survive."""
    old = current.select(*key, *(F.col(c).alias(f"_old_{c}") for c in keep), F.lit(True).alias("_known"))
    new = incoming.join(old, list(key), "left")
    for c in keep:
        new = new.withColumn(c, F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    return current.join(incoming.select(*key), list(key), "left_anti").unionByName(new.select(*current.columns))


def replace_children(current: DataFrame, parents: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    """All children of ``parents`` are replaced by ``children``; a parent without new children loses its own."""
    return current.join(parents.select(parent_key).distinct(), parent_key, "left_anti").unionByName(children.select(*current.columns))


def delete_pages(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the pages of ``ids`` and the rows that refer to them: name -> (table, its page column)."""
    gone = ids.select(F.col("page_id").alias("_gone")).distinct()
    return {name: (t.join(gone, F.col(column) == F.col("_gone"), "left_anti")) for name, (t, column) in tables.items()}


def mark_inaccessible(pages: DataFrame, ids: DataFrame, at: str, reason: str) -> DataFrame:
    hit = ids.select("page_id").distinct().withColumn("_hit", F.lit(True))
    return (
        pages.join(hit, "page_id", "left")
        .withColumn("inaccessible", F.coalesce("_hit", F.col("inaccessible")))
        .withColumn("inaccessible_at", F.when(F.col("_hit"), F.lit(at).cast("timestamp")))
        .withColumn("inaccessible_reason", F.when(F.col("_hit"), F.lit(reason)))
        .drop("_hit")
    )


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Accessible pages without parent that no internal link with a target names; self-links count as links."""
    named = links.filter((F.col("link_type") == "internal") & F.col("target_page_id").isNotNull()).select(F.col("target_page_id").alias("page_id")).distinct()
    return pages.filter(F.col("parent_id").isNull() & ~F.col("inaccessible")).join(named, "page_id", "left_anti")


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Broken links with their source's title and space."""
    source = pages.select(F.col("page_id").alias("source_page_id"), F.col("title").alias("source_title"), "space_key")
    return links.filter("is_broken").join(source, "source_page_id", "left")


def external_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("link_type") == "external").orderBy("source_page_id", "line_number")


def top_contributors(contributors: DataFrame, limit: int = 10) -> DataFrame:
    return (
        contributors.groupBy("user_id")
        .agg(F.count_distinct("page_id").alias("page_count"), F.sum("contribution_count").alias("total_contributions"))
        .orderBy(F.desc("page_count"), F.desc("total_contributions"), "user_id").limit(limit)
    )


def audit_scope(pages: DataFrame, labels: DataFrame, *, include_label: str | None = None, exclude_label: str | None = None, under: int | None = None) -> DataFrame:
    """page_ids that hold the label, lie under the page, and do not hold the excluded label."""
    found = pages
    if include_label is not None:
        found = with_label(found, labels, include_label)
    if under is not None:
        found = found.filter(F.array_contains("ancestors", F.lit(under).cast("long")) | F.coalesce(F.col("parent_id") == under, F.lit(False)))
    if exclude_label is not None:
        found = found.join(labels.filter(F.col("label") == exclude_label), "page_id", "left_anti")
    return found.select("page_id")


def missing_label(pages: DataFrame, labels: DataFrame, required: str) -> DataFrame:
    """Pages without a required label, with the labels that they have."""
    have = labels.groupBy("page_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    joined = pages.join(have, "page_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    return joined.filter(~F.array_contains("labels", required))


def users_to_check(referenced: DataFrame, users: DataFrame, as_of: str, ttl_days: int = 7) -> DataFrame:
    """Referenced users never seen, never checked, or checked longer ago than the time to live."""
    known = users.select("user_id", "last_checked_at")
    age = F.col("last_checked_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {ttl_days} days")
    return referenced.select("user_id").distinct().join(known, "user_id", "left").filter(F.col("last_checked_at").isNull() | age)


def user_stats(users: DataFrame, as_of: str, ttl_days: int = 7) -> DataFrame:
    stale = F.col("last_checked_at").isNull() | (F.col("last_checked_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {ttl_days} days"))
    return users.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"),
        F.count_if(F.col("is_active").isNull()).alias("unknown"), F.count_if(stale).alias("stale"),
    )


def referenced_users(pages: DataFrame, contributors: DataFrame) -> DataFrame:
    parts: Iterable[DataFrame] = (pages.select(F.col("created_by").alias("user_id")), pages.select(F.col("last_modified_by").alias("user_id")), contributors.select("user_id"))
    return reduce(DataFrame.unionByName, parts).filter("user_id is not null").distinct()


def contributors_from_pages(pages: DataFrame) -> DataFrame:
    """Creator and last modifier as contributors; one row where they are the same user."""
    both = pages.select(
        "page_id",
        F.explode(F.array_distinct(F.filter(F.array("created_by", "last_modified_by"), lambda u: u.isNotNull()))).alias("user_id"), "created_by", "last_modified_by", "created_at", "last_modified",
    )
    modifier = F.col("user_id") == F.col("last_modified_by")
    count = F.when((F.col("created_by") == F.col("last_modified_by")) & modifier, 2).otherwise(1)
    return both.select("page_id", "user_id", count.alias("contribution_count"), F.when(modifier, F.coalesce("last_modified", "created_at")).otherwise(F.col("created_at")).alias("last_contributed_at"))


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the stated order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")
