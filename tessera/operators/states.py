"""Job state machine checks, replays, admission, critical paths, bins, stable routes, comment trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.texts import slug
from tessera.operators.ranks import saved, stored

#: The states a job may go to from each state.
TRANSITIONS = {
    "queued": ("running", "cancelled"), "running": ("waiting", "succeeded", "failed", "cancelled", "queued"),
    "waiting": ("queued", "running", "cancelled", "failed"), "failed": (), "cancelled": (), "succeeded": (),
}
RETRYABLE = ("failed", "cancelled")


def invalid_transitions(events: DataFrame) -> DataFrame:
    """(job_id, seq, was, state) of steps that the state machine does not allow."""
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("seq"))
    allowed = F.create_map(*[x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))])
    steps = events.withColumn("was", before).filter("was is not null and was <> state")
    return steps.filter(~F.array_contains(F.element_at(allowed, F.col("was")), F.col("state"))).select("job_id", "seq", "was", "state")


def replay_verdicts(requests: DataFrame) -> DataFrame:
    """Retries only of retryable states, reruns only of successes; a key used again must ask for the same."""
    first = F.first("payload").over(Window.partitionBy("action_key").orderBy("seq"))
    allowed = F.when(F.col("action") == "retry", F.col("state").isin(*RETRYABLE)).otherwise(F.col("state") == "succeeded")
    return requests.select("action_key", "seq", F.when(first != F.col("payload"), "conflict").when(~allowed, "refused").otherwise("accepted").alias("verdict"))


def shortfalls(needs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(id, resource, missing) of what a job needs beyond the limits."""
    long = needs.unpivot("id", list(limits), "resource", "needed")
    most = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("resource"))
    return long.select("id", "resource", (F.col("needed") - most).alias("missing")).filter("missing > 0")


def job_timings(jobs: DataFrame) -> DataFrame:
    """Wall and summed seconds of each run, and its class: cancelled before failed before green."""
    return jobs.groupBy("run_id").agg(
        (F.unix_timestamp(F.max("ended")) - F.unix_timestamp(F.min("created"))).alias("wall_s"), F.sum("seconds").alias("runner_s"),
        F.when(F.bool_or(F.col("state") == "cancelled"), "cancelled").when(F.bool_or(F.col("state") == "failed"), "failed").otherwise("green").alias("class"),
    )


def critical_path(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """(run_id, at, job): from each run's last job to end, back along the latest-ending job it needs, to the first."""
    last = jobs.groupBy("run_id").agg(F.max_by("job", F.struct("ended", "job")).alias("job")).withColumn("at", F.lit(0)).withColumn("path", F.array("job"))
    ends = jobs.select("run_id", F.col("job").alias("needs"), "ended")
    latest = saved(needs.join(ends, ["run_id", "needs"]).groupBy("run_id", "job").agg(F.max_by("needs", F.struct("ended", "needs")).alias("parent")))
    level = saved(last)
    out = []
    while not level.isEmpty():
        out.append(level.select("run_id", "at", "job"))
        level = saved(
            level.join(latest, ["run_id", "job"]).filter(~F.array_contains("path", F.col("parent")))
            .select("run_id", F.col("parent").alias("job"), (F.col("at") + 1).alias("at"), F.concat("path", F.array("parent")).alias("path"))
        )
    return reduce(DataFrame.unionByName, out, level.select("run_id", "at", "job"))


def stable_routes(previous: DataFrame, wanted: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(source_id, route, change) of previous routes (source_id, route and maybe state), wanted pages (source_id, base)
    and an operator's overrides (source_id, route).

    An override comes first; a page keeps its previous route (``kept``, or ``reactivated`` if it was a tombstone,
    or ``changed`` where an override differs); routes of pages that are no longer wanted become tombstones and
    stay taken. An override onto a route that another page has, or that another override asks for, is told as a
    ``collision`` and otherwise left out, so no route ever has two owners. New pages choose in the order of base
    route and id: the base, the base with the page's own suffix, then that with -2, -3, ...; routes compare without
    regard to case. All choose side by side: a route that several ask for goes to the first in that order, and the
    others ask for their next one, which gives each page what it would get in turn.
    """
    if "state" not in previous.columns:
        previous = previous.withColumn("state", F.lit("active"))
    if overrides is None:
        overrides = wanted.select("source_id", F.col("base").alias("route")).limit(0)
    asked_for = overrides.select("source_id", F.col("route").alias("custom")).join(wanted.select("source_id"), "source_id", "left_semi")
    owners = asked_for.select(F.lower("custom").alias("key"), "source_id").union(previous.select(F.lower("route"), "source_id")).distinct()
    shared = owners.groupBy("key").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1").select("key")
    collisions = saved(asked_for.join(shared, F.lower("custom") == F.col("key"), "left_semi"))
    custom = asked_for.join(collisions.select("source_id"), "source_id", "left_anti")
    held = wanted.join(previous, "source_id").join(custom, "source_id", "left")
    change = F.when(F.col("custom").isNotNull() & (F.col("custom") != F.col("route")), "changed").when(F.col("state") == "tombstone", "reactivated").otherwise("kept")
    kept = held.select("source_id", F.coalesce("custom", "route").alias("route"), change.alias("change"))
    given = wanted.select("source_id").join(custom, "source_id").join(previous.select("source_id"), "source_id", "left_anti").select("source_id", F.col("custom").alias("route"), F.lit("assigned").alias("change"))
    taken = saved(previous.select(F.lower("route").alias("key")).union(custom.select(F.lower("custom"))).distinct())

    new = wanted.join(previous.select("source_id"), "source_id", "left_anti").join(custom, "source_id", "left_anti")
    suffixed = F.concat("base", F.lit("-"), slug(F.col("source_id").cast("string")))
    route = F.when(F.col("n") == 0, F.col("base")).when(F.col("n") == 1, suffixed).otherwise(F.concat(suffixed, F.lit("-"), F.col("n").cast("string")))
    asking = new.select("source_id", "base", F.lit(0).alias("n"))
    while True:
        asked = asking.withColumn("route", route).withColumn("key", F.lower("route"))
        first = asked.groupBy("key").agg(F.min(F.struct("base", "source_id")).alias("first"))
        open_to = asked.join(first, "key").join(taken.withColumn("taken", F.lit(True)), "key", "left")
        won = F.col("taken").isNull() & (F.col("first") == F.struct("base", "source_id"))
        asking = saved(open_to.select("source_id", "base", "route", won.alias("won"), F.when(won, F.col("n")).otherwise(F.col("n") + 1).alias("n")))
        if asking.filter("not won").isEmpty():
            break
        asking = asking.select("source_id", "base", "n")
    placed = asking.select("source_id", "route", F.lit("assigned").alias("change"))
    gone = previous.join(wanted.select("source_id"), "source_id", "left_anti").filter("state <> 'tombstone'").select("source_id", "route", F.lit("tombstoned").alias("change"))
    told = collisions.select("source_id", F.col("custom").alias("route"), F.lit("collision").alias("change"))
    return kept.unionByName(given).unionByName(placed).unionByName(gone).unionByName(told)


def expand_includes(pages: DataFrame, steps: int = 4) -> DataFrame:
    """(page_id, include, depth): every page that a page includes, directly or through others, each once at its least depth.

    What lies within ``steps`` of each page is found one step after the other; from then on a round takes that many
    steps at once from the pairs that are farthest, so the pairs that are known meet the new ones in fewer rounds.
    """
    direct = saved(pages.select("page_id", F.explode("includes").alias("include")).filter("include <> page_id").distinct())
    onward = direct.select(F.col("page_id").alias("via"), "include", F.lit(1).alias("more"))
    parts, edge, depth, step = [stored(direct.withColumn("depth", F.lit(1)))], direct, 1, 1
    while True:
        known = reduce(DataFrame.unionByName, parts)
        if depth == steps > 1:
            onward, step = known.select(F.col("page_id").alias("via"), "include", F.col("depth").alias("more")), steps
        ahead = edge.select("page_id", F.col("include").alias("via")).join(onward, "via").filter("include <> page_id")
        found = ahead.groupBy("page_id", "include").agg((F.min("more") + depth).alias("depth"))
        part = stored(found.join(known.select("page_id", "include"), ["page_id", "include"], "left_anti").select("page_id", "include", "depth"))
        depth += step
        edge = part.filter(F.col("depth") == depth)
        if part.isEmpty():
            return known
        parts.append(part)


def least_loaded(units: DataFrame, bins: int) -> DataFrame:
    """(plan, unit, bin): units of a plan, heaviest first, each to the lightest bin, the first of equals.

    A task reads its plans' units in this order one after the other and holds the loads of one plan's bins only, so
    neither many plans nor a plan of any size is gathered.
    """

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, heap = None, []
        for frame in frames:
            out = []
            for plan, weight in zip(frame["plan"].tolist(), frame["weight"].tolist()):
                if plan != current:
                    current, heap = plan, [(0.0, i) for i in range(bins)]
                load, b = heap[0]
                heapq.heapreplace(heap, (load + weight, b))
                out.append(b)
            yield frame[["plan", "unit"]].assign(bin=out)

    ordered = units.select("plan", "unit", F.col("weight").cast("double").alias("weight")).repartition("plan").sortWithinPartitions("plan", F.desc("weight"), "unit")
    return ordered.mapInPandas(assign, "plan long, unit long, bin int")


def claim_next(jobs: DataFrame, last_group: int | None, order: DataFrame) -> DataFrame:
    """The next job in fair order, beginning after the group that was served last."""
    turn = F.when(F.lit(last_group).isNull() | (F.col("group_key") > F.lit(last_group)), 0).otherwise(1)
    first_round = order.filter("turn = 1").join(jobs.select("job_id", "group_key", "priority"), "job_id")
    return first_round.orderBy(F.when(F.col("priority") == "interactive", 0).otherwise(1), turn, "group_key", "job_id").limit(1).select("job_id", "group_key")
