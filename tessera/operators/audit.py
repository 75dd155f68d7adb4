"""Content audit: staleness, ownership risk, links, summaries and fix plans; change detection; refresh plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.times import months_before, months_between_calendar


def stale_pages(pages: DataFrame, as_of: str, *, high: int, medium: int | None = None, low: int | None = None) -> DataFrame:
    """Pages last changed so many calendar months ago or more, by the most severe threshold that they pass.

    The cut-off date of the lowest threshold prunes the scan before months are counted exactly.
    """
    now = F.lit(as_of).cast("timestamp")
    levels = [(high, "high"), *([(medium, "medium")] if medium else []), *([(low, "low")] if low else [])]
    cutoff = months_before(now, min(n for n, _ in levels))
    months = months_between_calendar(F.col("last_modified"), now)
    severity = reduce(lambda w, x: w.when(F.col("months") >= x[0], x[1]), levels[1:], F.when(F.col("months") >= levels[0][0], levels[0][1]))
    return (
        pages.filter(F.col("last_modified") < F.date_add(cutoff, 1)).withColumn("months", months).withColumn("severity", severity)
        .filter("severity is not null")
    )


def contributor_risks(pages: DataFrame, contributors: DataFrame, users: DataFrame) -> DataFrame:
    """``bus-factor`` of pages with one contributor, else ``no-maintainer`` where all are known to be inactive."""
    known = contributors.select("page_id", "user_id").join(users.select("user_id", "is_active"), "user_id", "left")
    per_page = known.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(~F.col("is_active"), F.lit(False))).alias("all_gone"))
    risk = F.when(F.col("n") == 1, "bus-factor").when(F.col("all_gone"), "no-maintainer")
    return pages.join(per_page, "page_id").withColumn("risk", risk).filter("risk is not null")


def link_stats(links: DataFrame) -> DataFrame:
    return links.groupBy("link_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_page_id").isNotNull()).alias("resolved"), F.count_if("is_broken").alias("broken"))


def link_domain(url: Column) -> Column:
    """Host of a URL; ``unknown`` for null and ``invalid-url`` for what is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(url.isNull(), "unknown").when(host == "", "invalid-url").otherwise(host)


def top_domains(links: DataFrame, limit: int = 10) -> DataFrame:
    return (
        links.filter("link_type = 'external'").groupBy(link_domain(F.col("target_path")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "domain").limit(limit)
    )


def audit_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(check, n): the number of findings of each named check."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check"), "n") for k, df in parts.items()])


def counters(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): how many rows meet each condition, all in one pass."""
    one = rows.agg(*(F.count_if(c).alias(k.replace(".", "_")) for k, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k.replace(".", "_")).alias("n")) for k in checks))).alias("x")).select("x.check", "x.n")


def fix_plan(stale: DataFrame, orphans: DataFrame, archive_from: int = 24, delete_from: int = 12) -> DataFrame:
    """(action, page_id): label high-severity stale pages, archive old ones, delete old orphans."""
    old = orphans.select("page_id").join(stale.filter(F.col("months") >= delete_from).select("page_id"), "page_id", "left_semi")
    parts = (
        stale.filter("severity = 'high'").select(F.lit("add-label").alias("action"), "page_id"),
        stale.filter(F.col("months") >= archive_from).select(F.lit("archive").alias("action"), "page_id"),
        old.select(F.lit("delete").alias("action"), "page_id"),
    )
    return reduce(DataFrame.unionByName, parts)


def sync_state(local: Column, remote: Column, base: Column) -> Column:
    """State from three hashes: equal changes on both sides are in sync."""
    local_changed, remote_changed = ~local.eqNullSafe(base), ~remote.eqNullSafe(base)
    return (
        F.when(local_changed & remote_changed, F.when(local.eqNullSafe(remote), "synced").otherwise("conflict"))
        .when(local_changed, "local-modified").when(remote_changed, "remote-modified").otherwise("synced")
    )


def attachment_state(local: Column, remote: Column, base: Column) -> Column:
    """As :func:`sync_state`, where a side that is missing was changed by the other."""
    return (
        F.when(local.isNull() & remote.isNull(), "synced").when(local.isNull(), "remote-modified").when(remote.isNull(), "local-modified")
        .otherwise(sync_state(local, remote, base))
    )


def sync_state_by_version(local: Column, base: Column, remote_version: Column, known_version: Column) -> Column:
    """State where the remote side is told by its version; both changed is always a conflict."""
    local_changed, remote_changed = ~local.eqNullSafe(base), remote_version > known_version
    return F.when(local_changed & remote_changed, "conflict").when(local_changed, "local-modified").when(remote_changed, "remote-modified").otherwise("synced")


def snapshot_events(previous: DataFrame, current: DataFrame, deletions: bool = True) -> DataFrame:
    """(id, kind) between two (id, version) snapshots: created, changed (a greater version), deleted."""
    both = previous.select("id", F.col("version").alias("was")).join(current.select("id", F.col("version").alias("now")), "id", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("was"), "changed")
    events = both.select("id", kind.alias("kind")).filter("kind is not null")
    return events if deletions else events.filter("kind <> 'deleted'")


def refresh_plan(previous: DataFrame, current: DataFrame, *, complete: bool, authoritative: bool = True) -> DataFrame:
    """(source_id, change) between publication snapshots; each kind of change is independent of the others.

    A source that is missing is deleted only if the scan was complete and is the authority, else unknown.
    """
    p = previous.select("source_id", *(F.col(c).alias(f"p_{c}") for c in previous.columns if c != "source_id"))
    both = p.join(current, "source_id", "full_outer")
    stays = F.col("p_title").isNotNull() & F.col("title").isNotNull()
    differs = lambda *names: stays & reduce(Column.__or__, [~F.col(n).eqNullSafe(F.col(f"p_{n}")) for n in names])
    kinds = F.array(
        F.when(F.col("p_title").isNull(), "added"),
        F.when(F.col("title").isNull(), "deleted" if complete and authoritative else "missing"),
        F.when(differs("title"), "renamed"), F.when(differs("parent_id", "position"), "moved"),
        F.when(differs("content_digest"), "content"), F.when(differs("metadata_digest"), "metadata"),
    )
    return both.select("source_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("change")).orderBy("source_id", "change")


def normalized_markdown(text: Column) -> Column:
    """CRLF to LF, no trailing blanks, at most one blank line in a row, one newline at the end."""
    x = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    x = F.regexp_replace(x, r"[ \t]+(?=\n|$)", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(F.regexp_replace(x, r"^\n+", ""), r"\n+$", ""), F.lit("\n"))
