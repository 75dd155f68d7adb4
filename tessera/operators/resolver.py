"""Resolution of requests by ordered stages, over tables of what was asked and answered.

Requests of one service and site share three things: a cache (the first request of a key is the call, the others
have its answer), a deadline, and a breaker that the first call that is turned away for its rate opens for the
service on that site. A block is rendered by the first of its stages that gives something; a stage that fails or
passes falls through to the next, and a block that no stage renders keeps its place.

Plan: what a request meets depends on the first request of its key and on the first refusal of its service and
site only, so both are aggregates (a row a task before they are shuffled) and equi-joins; no service is ever
gathered or sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the notes of blocks say.
RENDERED, DEGRADED, SKIPPED = "macro-rendered-via", "macro-degraded", "macro-skipped-by-config"


def answered(requests: DataFrame, deadline: int | None = None) -> DataFrame:
    """``requests`` (seq, at, service, site, key, answer: what a call would give) with status and given.

    status is ``deadline``, ``open`` (the breaker turned it away), ``called`` or ``cached``; given is the answer.
    """
    in_time = F.lit(True) if deadline is None else F.col("at") <= deadline
    firsts = requests.filter(in_time).groupBy("service", "site", "key").agg(F.min("seq").alias("first"), F.min_by("answer", "seq").alias("shared"))
    # ``opened`` is the first refusal of any request; only calls are refused, and before it each key's first is the call.
    open_ = requests.filter(in_time & (F.col("answer") == "rate-limited")).join(firsts.select("service", "site", "key", "first"), ["service", "site", "key"]).filter("seq = first").groupBy("service", "site").agg(F.min("seq").alias("opened"))
    met = requests.join(firsts, ["service", "site", "key"], "left").join(open_, ["service", "site"], "left")
    status = F.when(~in_time, "deadline").when(F.col("seq") > F.col("opened"), "open").when(F.col("seq") == F.col("first"), "called").otherwise("cached")
    given = F.when(F.col("status") == "deadline", "deadline").when(F.col("status") == "open", "rate-limited").otherwise(F.col("shared"))
    return met.withColumn("status", status).withColumn("given", given).drop("first", "shared", "opened")


def service_states(requests: DataFrame, deadline: int | None = None) -> DataFrame:
    """(service, site, calls, cached, turned_away, late, open): what each service did on each site."""
    met = answered(requests, deadline)
    of = lambda s: F.count_if(F.col("status") == s)
    return met.groupBy("service", "site").agg(
        of("called").alias("calls"), of("cached").alias("cached"), of("open").alias("turned_away"), of("deadline").alias("late"),
        F.bool_or((F.col("status") == "called") & (F.col("given") == "rate-limited")).alias("open"),
    )


def resolved(stages: DataFrame, live: bool = True) -> DataFrame:
    """(block, outcome, stage, code, notes) of each block from its stages (block, stage, given, needs_live).

    given is ``blocks``, ``skip``, ``deadline`` or an error. The first stage with blocks wins unless the deadline
    came before it; without live calls the stages that need them are passed over.
    """
    tried = F.lit(True) if live else ~F.col("needs_live")
    at = lambda wanted: F.min(F.when(tried & wanted, F.col("stage")))
    grouped = stages.groupBy("block").agg(
        at(F.col("given") == "blocks").alias("won"), at(F.col("given") == "deadline").alias("late"), F.bool_or(~tried).alias("passed_over"),
        F.collect_list(F.when(tried & ~F.col("given").isin("blocks", "skip", "deadline"), F.col("stage"))).alias("failed"),
    )
    ended = F.least("won", "late")
    rendered = F.col("won").isNotNull() & (F.col("late").isNull() | (F.col("won") < F.col("late")))
    code = F.when(rendered, RENDERED).when(F.col("late").isNotNull() | F.col("passed_over"), SKIPPED).otherwise(DEGRADED)
    notes = F.size(F.filter("failed", lambda s: ended.isNull() | (s < ended)))
    return grouped.select("block", F.when(rendered, "rendered").otherwise("kept").alias("outcome"), F.when(rendered, F.col("won")).alias("stage"), code.alias("code"), notes.alias("failures"))
