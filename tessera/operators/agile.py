"""Sprint, velocity, burndown, scope and epic analytics, and time tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import leading_number, percent, round_half_up


def with_points(issues: DataFrame) -> DataFrame:
    return issues.withColumn("points", leading_number(F.col("points_raw")))


def sprint_metrics(issues: DataFrame, scope_changes: DataFrame | None = None) -> DataFrame:
    """Committed and completed points, counts and ratios by sprint; ``scope_changes`` has (sprint_id, added, removed)."""
    done = F.col("status_category") == "done"
    m = issues.groupBy("sprint_id").agg(
        F.sum("points").alias("committed"), F.sum(F.when(done, F.col("points")).otherwise(0.0)).alias("completed"),
        F.count(F.lit(1)).alias("total_issues"), F.count_if(done).alias("completed_issues"),
    )
    if scope_changes is not None:
        m = m.join(scope_changes, "sprint_id", "left")
    else:
        m = m.withColumns({"added": F.lit(0.0), "removed": F.lit(0.0)})
    m = m.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("added", "removed")})
    return m.select(
        "sprint_id", "committed", "completed", "total_issues", "completed_issues", (F.col("total_issues") - F.col("completed_issues")).alias("incomplete_issues"),
        "added", "removed", percent(F.col("added") + F.col("removed"), F.col("committed")).alias("scope_change_percent"), percent(F.col("completed"), F.col("committed")).alias("say_do"),
    )


def sprint_ids(text: Column) -> Column:
    """The ids of ``id=<n>`` marks in a change's text; names alone give none."""
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(r"id=(\d+)"), 1), F.array().cast("array<string>")), lambda x: x.cast("long"))


def scope_changes(changes: DataFrame, issues: DataFrame, sprints: DataFrame) -> DataFrame:
    """(sprint_id, added, removed): points of issues that entered or left a sprint between its start and end, both inclusive.

    Changes meet the sprints that they name by an equi-join on the named ids, not by comparing all with all.
    """
    sprint = changes.filter("field = 'Sprint'").select("issue_id", "created", sprint_ids(F.col("from_text")).alias("was"), sprint_ids(F.col("to_text")).alias("now"))
    added = sprint.select("issue_id", "created", F.explode(F.array_except("now", "was")).alias("sprint_id"), F.lit(1.0).alias("a"), F.lit(0.0).alias("r"))
    removed = sprint.select("issue_id", "created", F.explode(F.array_except("was", "now")).alias("sprint_id"), F.lit(0.0).alias("a"), F.lit(1.0).alias("r"))
    return (
        added.unionByName(removed).join(sprints, "sprint_id").filter("created >= start_at and created <= end_at")
        .join(issues.select("issue_id", "points"), "issue_id")
        .groupBy("sprint_id").agg(F.sum(F.col("a") * F.col("points")).alias("added"), F.sum(F.col("r") * F.col("points")).alias("removed"))
    )


def stability(scope_percent: Column) -> Column:
    return F.when(scope_percent <= 10, "stable").when(scope_percent <= 25, "moderate").otherwise("unstable")


def predictability(metrics: DataFrame) -> DataFrame:
    mean = round_half_up(F.avg("say_do")).cast("long")
    return metrics.agg(F.count(F.lit(1)).alias("sprints"), mean.alias("average_say_do")).withColumn(
        "band", F.when(F.col("average_say_do") >= 80, "high").when(F.col("average_say_do") >= 60, "moderate").otherwise("low")
    )


def velocity(metrics: DataFrame, order: str = "sprint_id") -> DataFrame:
    """Average completed points, and the trend of the second half against the first where there are four sprints or more.

    Sprints are few beside issues; ranking them is the only ordered step.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = metrics.select(F.row_number().over(Window.orderBy(order)).alias("place"), n.alias("n"), "completed")
    first = F.col("place") <= F.floor(F.col("n") / 2)
    sums = ranked.agg(
        F.count(F.lit(1)).alias("sprints"), F.avg("completed").alias("mean"),
        F.avg(F.when(first, F.col("completed"))).alias("first"), F.avg(F.when(~first, F.col("completed"))).alias("second"),
    )
    trend = F.when((F.col("sprints") >= 4) & (F.col("first") > 0), round_half_up((F.col("second") - F.col("first")) / F.col("first") * 100).cast("long"))
    return sums.select("sprints", round_half_up(F.coalesce("mean", F.lit(0.0))).cast("long").alias("average_velocity"), trend.alias("trend"))


def completion_times(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """issue_id, completed_at of done issues: the last status change in the change list's own order, else the resolution."""
    last = changes.filter("field = 'status'").groupBy("issue_id").agg(F.max_by("created", "pos").alias("status_at"))
    return (
        issues.filter("status_category = 'done'").join(last, "issue_id", "left")
        .select("issue_id", "points", F.coalesce(F.col("status_at").cast("timestamp"), F.col("resolved").cast("timestamp")).alias("completed_at"))
        .filter("completed_at is not null")
    )


def completion_timeline(completions: DataFrame) -> DataFrame:
    return completions.filter("points <> 0").groupBy(F.to_date("completed_at").alias("day")).agg(F.sum("points").alias("points"))


def burndown(timeline: DataFrame, committed: float, start: str, end: str) -> DataFrame:
    """Remaining and ideal points of each day from start to end; points before the first day never burn."""
    spark = timeline.sparkSession
    grid = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as day, datediff(date'{end}', date'{start}') as total")
    burnt = F.sum(F.coalesce("points", F.lit(0.0))).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    at = F.datediff("day", F.lit(start).cast("date"))
    ideal = F.when(F.col("total") > 0, F.lit(committed) - F.lit(committed) / F.col("total") * at)
    return grid.join(timeline, "day", "left").select("day", (F.lit(committed) - burnt).alias("remaining"), round_half_up(ideal, 1).alias("ideal"))


def epic_progress(issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("epic_id").agg(*(F.count_if(F.col("status_category") == c).alias(c) for c in ("done", "indeterminate", "new")), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("percent_done", percent(F.col("done"), F.col("total")))


def worklog_report(logs: DataFrame) -> DataFrame:
    """Totals, and the average of a working day: ceil(days * 5 / 7) of the inclusive span, 1 at least."""
    day = F.to_date(F.split_part("started", F.lit("T"), F.lit(1)))
    totals = logs.agg(F.sum("seconds").alias("total_seconds"), F.count(F.lit(1)).alias("entries"), F.count_distinct("issue_id").alias("issues"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    days = F.greatest(F.lit(1), F.ceil((F.datediff("last_day", "first_day") + 1) * 5 / 7))
    return totals.withColumn("average_seconds", round_half_up(F.col("total_seconds") / days).cast("long"))


def worklogs_by(logs: DataFrame, what: str) -> DataFrame:
    """Seconds and entries by ``issue`` or ``date`` (the author's own calendar day)."""
    key = F.col("issue_id") if what == "issue" else F.split_part("started", F.lit("T"), F.lit(1))
    return logs.groupBy(key.alias("key")).agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("entries"), F.max("started").alias("latest"))


def filter_worklogs(logs: DataFrame, since: str, until: str, who: str | None = None) -> DataFrame:
    """Entries of whole days, of a user id or of an author whose name contains a text."""
    day = F.split_part("started", F.lit("T"), F.lit(1))
    found = logs.filter((day >= since) & (day <= until))
    if who is None:
        return found
    return found.filter((F.col("author_id") == who) | F.contains(F.lower(F.coalesce("author_name", F.lit(""))), F.lit(who.lower())))
