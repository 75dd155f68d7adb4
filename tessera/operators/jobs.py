"""Export-job queue and log analytics: fair order, retention, eviction, badges, keyset pages, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import placed, running_sum

TERMINAL = ("succeeded", "failed", "cancelled")


def fair_order(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their place: by priority, then one of each group in turn, groups by their oldest job.

    Rounds are ranked inside a group; the place in the whole queue comes from range partitions.
    """
    inside = Window.partitionBy("priority", "group_key").orderBy("enqueued_at", "job_id")
    whole = Window.partitionBy("priority", "group_key")
    rank = F.when(F.col("priority") == "interactive", 0).otherwise(1)
    head = F.min(F.struct("enqueued_at", "job_id")).over(whole)
    turns = jobs.withColumn("turn", F.row_number().over(inside)).withColumn("head", head).withColumn("rank", rank)
    return placed(turns, "rank", "turn", "head", "group_key", "job_id").drop("head", "rank")


def newest_places(jobs: DataFrame, newest: int) -> DataFrame:
    """``recent``: whether a job is one of the ``newest`` by creation. A bounded top-n, not a rank of all jobs."""
    top = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(newest).select("job_id", F.lit(True).alias("recent"))
    return jobs.join(F.broadcast(top), "job_id", "left").withColumn("recent", F.coalesce("recent", F.lit(False)))  # ``newest`` rows


def retention(jobs: DataFrame, as_of: str, *, newest: int = 100) -> DataFrame:
    """Which payloads of terminal jobs to release, and which rows to delete."""
    now = F.lit(as_of).cast("timestamp")
    age = lambda c, days: F.col(c).cast("timestamp") <= now - F.expr(f"interval {days} days")
    done = F.col("state").isin(*TERMINAL)
    seen = F.col("delivered_at").isNotNull() | F.col("dismissed_at").isNotNull()
    last_use = F.greatest("finished_at", "delivered_at", "dismissed_at").cast("timestamp")
    artifact = (F.col("state") != "succeeded") | (seen & (last_use <= now - F.expr("interval 24 hours")))
    report = age("finished_at", 7)
    old = ~F.col("recent") | age("created_at", 30)
    return (
        newest_places(jobs.filter(done), newest)
        .withColumn("release_artifact", F.coalesce(artifact, F.lit(False))).withColumn("release_report", F.coalesce(report, F.lit(False)))
        .withColumn("delete_row", old & F.col("release_artifact") & F.col("release_report") & ((F.col("state") != "succeeded") | seen))
    )


def evict(items: DataFrame, need: int) -> DataFrame:
    """The items to evict, by rank and age, until ``need`` bytes are free; the one that crosses the line is taken too."""
    summed = running_sum(items.filter("bytes > 0"), "bytes", "rank", "eligible_at", "ref", name="freed")
    return summed.filter(F.col("freed") - F.col("bytes") < need)


def badge(jobs: DataFrame) -> DataFrame:
    """One badge: active jobs before unread failures before unread successes; more than nine is ``9+``."""
    unread = F.col("acknowledged_at").isNull() & F.col("dismissed_at").isNull()
    counts = jobs.agg(
        F.count_if(~F.col("state").isin(*TERMINAL)).alias("active"),
        F.count_if((F.col("state") == "failed") & unread).alias("failed"), F.count_if((F.col("state") == "succeeded") & unread).alias("succeeded"),
    )
    kind = F.when(F.col("active") > 0, "active").when(F.col("failed") > 0, "failed").when(F.col("succeeded") > 0, "succeeded").otherwise("none")
    n = F.coalesce(F.nullif("active", F.lit(0)), F.nullif("failed", F.lit(0)), F.col("succeeded"))
    return counts.withColumn("kind", kind).withColumn("text", F.when(n > 9, "9+").otherwise(n.cast("string")))


def keyset_page(rows: DataFrame, size: int, after: tuple | None = None, keys: tuple[str, str] = ("created_at", "job_id")) -> DataFrame:
    """The next ``size`` rows newest first; ``after`` is the last row's keys."""
    a, b = keys
    if after is not None:
        t, i = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.filter((F.col(a) < t) | ((F.col(a) == t) & (F.col(b) < i)))
    return rows.orderBy(F.desc(a), F.desc(b)).limit(size)


def capped(rows: DataFrame, order: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """(at most ``cap`` rows, whether there were more): the probe asks for one row beyond the cap."""
    probe = rows.orderBy(*order).limit(cap + 1)
    return probe.limit(cap), probe.agg((F.count(F.lit(1)) > cap).alias("truncated"))


def activity_rank(state: Column) -> Column:
    return F.when(state == "running", 0).when(state == "queued", 1).when(state == "waiting", 2).when(state == "failed", 3).otherwise(4)


def log_rows(logs: DataFrame, *, since: str | None = None, until: str | None = None, level: str | None = None, type_prefix: str | None = None) -> DataFrame:
    found = logs
    if since:
        found = found.filter(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        found = found.filter(F.col("timestamp") <= F.lit(until).cast("timestamp_ntz"))
    if level:
        found = found.filter(F.col("level") == level)
    return found.filter(F.col("type").startswith(type_prefix)) if type_prefix else found


def regressions(records: DataFrame, env: list[str], *, time_ratio: float = 1.2, keep: int = 40) -> DataFrame:
    """Each environment's newest record against the median of its ``keep`` records before."""
    w = Window.partitionBy(*env).orderBy(F.desc("at"), F.desc("id"))
    ranked = records.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep + 1)
    base = ranked.groupBy(*env).agg(F.max(F.when(F.col("n") == 1, F.col("ms"))).alias("latest"), F.expr("percentile_cont(0.5) within group (order by case when n > 1 then ms end)").alias("baseline"))
    return base.withColumn("ratio", F.col("latest") / F.col("baseline")).withColumn("regressed", F.col("ratio") > time_ratio)


def sweep_verdicts(candidates: DataFrame, *, scope: str, now: str, ttl_seconds: int, title: str) -> DataFrame:
    """``candidates`` (name, scope, run_id, ...) with a verdict: the first gate that fails, or ``sweep``.

    ``title`` is a pattern whose first group is the time of making in seconds. What is exactly as old as the
    time to live is still protected; a missing scope or owner fails its gate.
    """
    made = F.regexp_extract("name", title, 1).try_cast("long")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - made
    verdict = (
        F.when(~F.col("scope").eqNullSafe(F.lit(scope)), "wrong-scope").when(made.isNull(), "name-mismatch").when(F.trim(F.coalesce("run_id", F.lit(""))) == "", "no-marker")
        .when(age <= ttl_seconds, "within-ttl").otherwise("sweep")
    )
    return candidates.withColumn("verdict", verdict)


def sweep_summary(verdicts: DataFrame, most: int) -> DataFrame:
    """One row: targets, skipped, and whether the breaker trips because there are more targets than ``most``."""
    targets = F.count_if(F.col("verdict") == "sweep")
    return verdicts.agg(targets.alias("targets"), F.count_if(F.col("verdict") != "sweep").alias("skipped"), (targets > most).alias("tripped"))
