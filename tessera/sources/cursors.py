"""Answers that come page by page, each naming the next: the order of all that a cursor leads to, with a guard against loops.

Fetched pages are a table of (token, next_token). Following them one by one would be a job a page, and learning of all
pages those 1, 2, 4, 8, ... steps on would be a pass over the whole table for each doubling. So a long table is folded
first: in each round about a quarter of the pages, no two of them neighbours, are left out, and the page before each
leads to the one behind it, which leaves three quarters for the next round. What is left is read by doubling; then the
rounds are gone back, and each page that was left out has its place behind the one before it. All rounds together
read and write a few times the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import saved, stored

#: Links that are read by doubling, without folding.
FEW = 50_000


def drained(pages: DataFrame, start: str, few: int = FEW) -> DataFrame:
    """(token, place, state) of the pages from ``start`` on, each once, places from 0.

    state is ``loop`` where the next token is one that was read before (reading ends there), ``missing`` where it
    names no page, ``last`` where there is none, else ``more``. A token that comes twice counts once, with its
    least next token. An earlier place can be gone on from: give its next token as the start.
    """
    once = stored(pages.filter("token is not null").groupBy("token").agg(F.min("next_token").alias("next_token")))
    links = once.filter("token <> next_token").select("token", F.col("next_token").alias("to"), F.lit(1).cast("long").alias("steps"))
    folds: list[DataFrame] = []
    while links.count() > few:
        folds.append(_folded(links, start, len(folds)))
        links = folds[-1].select("token", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.col("further")).alias("steps")).filter("token <> to")
    parts = [stored(_walked(once.filter(F.col("token") == start).select("token", F.lit(0).cast("long").alias("place")), links))]
    for fold in reversed(folds):
        left_out = fold.filter("then is not null").select("token", F.col("to").alias("out"), "steps")
        met = reduce(DataFrame.unionByName, parts).join(left_out, "token").select(F.col("out").alias("token"), (F.col("place") + F.col("steps")).alias("place"))
        parts.append(stored(met.groupBy("token").agg(F.min("place").alias("place"))))
    reached = reduce(DataFrame.unionByName, parts)
    read = stored(reached.join(once, "token"))
    met = read.join(read.select(F.col("token").alias("next_token"), F.col("place").alias("next_place")), "next_token", "left")
    state = F.when(F.col("next_token").isNull(), "last").when(F.col("next_place").isNull(), "missing").when(F.col("next_place") <= F.col("place"), "loop").otherwise("more")
    return met.select("token", "place", state.alias("state"))


def _folded(links: DataFrame, start: str, turn: int) -> DataFrame:
    """The links that stay, with ``then`` and ``further`` where the page that they lead to is left out. A page is left
    out if its own coin shows tails and that of the page behind it heads; that of the start always shows heads."""
    def heads(token: str) -> Column:
        return (F.col(token) == F.lit(start)) | (F.xxhash64(F.col(token), F.lit(turn)).bitwiseAND(1) == 0)

    stays = links.filter(heads("token") | ~heads("to"))
    out = links.filter(~heads("token") & heads("to")).select(F.col("token").alias("to"), F.col("to").alias("then"), F.col("steps").alias("further"))
    bare = stays.filter(heads("to")).select("token", "to", "steps", F.lit(None).cast("string").alias("then"), F.lit(0).cast("long").alias("further"))
    led = stays.filter(~heads("to")).join(out, "to", "left").select("token", "to", "steps", "then", F.coalesce("further", F.lit(0)).alias("further"))
    return stored(bare.unionByName(led))


def _walked(reached: DataFrame, links: DataFrame) -> DataFrame:
    """(token, place) of what the links lead to from ``reached``: the pages that are known double with each round."""
    reached, jump = saved(reached), saved(links)
    while True:
        ahead = reached.join(jump, "token").select(F.col("to").alias("token"), (F.col("place") + F.col("steps")).alias("place"))
        fresh = saved(ahead.join(reached, "token", "left_anti").groupBy("token").agg(F.min("place").alias("place")))
        if fresh.isEmpty():
            return reached
        reached = saved(reached.unionByName(fresh))
        onward = jump.select(F.col("token").alias("to"), F.col("to").alias("then"), F.col("steps").alias("further"))
        jump = saved(jump.join(onward, "to").select("token", F.col("then").alias("to"), (F.col("steps") + F.col("further")).alias("steps")))


def repeats(pages: DataFrame) -> DataFrame:
    """(token, n) of the tokens that came more than once."""
    return pages.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
