"""Chat formatting: cumulative snapshots collapse to their longest conversation, which is rendered.

A logged conversation often is a prefix of a longer one. A rolling hash names each turn prefix of each
conversation; an anti-join drops the conversations whose whole hash is a proper prefix of another, and of
equal conversations the one with the least conv_id stays. DataFrame functions only.

Plan. A conversation of any length is never gathered in one task: turns are numbered and hashed in
chunks of a conversation (by turn number), chunk totals are summed along the conversation, and rendered
segments hold ``PART`` turns at most. Prefix hashes are made distinct before the anti-join, so a greeting
that opens a third of all conversations is one row a task.

Defined cases: turns are ordered by turn, then role, then text; repeated rows count once; a null turn
comes first; null role renders as ``unknown``, null text as the empty text, and both hash as different
from any present value; a null conv_id is a conversation of its own kind and is left out; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a chunk and of a rendered segment.
PART = 256
#: Fixed values of the rendered format.
START, END = "<|im_start|>", "<|im_end|>"
#: A prefix hash is two sums of this many bits each.
BITS = 40


def _hash(seed: int) -> Column:
    """A hash of a turn at its place; sums of it along a conversation are a prefix's rolling hash."""
    whole = F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return whole.bitwiseAND(F.lit((1 << BITS) - 1))


def numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place in the conversation and the hash of the prefix that they end."""
    rows = (
        turns.filter("conv_id is not null")
        .select("conv_id", "turn", "role", "text").distinct()
        .withColumn("chunk", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 40))))
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = (
        rows.withColumn("at", F.row_number().over(inside)).join(offsets, ["conv_id", "chunk"])
        .withColumn("pos", (F.col("offset") + F.col("at")).cast("long")).drop("offset", "at")
        .withColumn("h1", _hash(11)).withColumn("h2", _hash(12))
    )
    sums = placed.groupBy("conv_id", "chunk").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2")).select(
        "conv_id", "chunk", *(F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2))
    )
    along = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(sums, ["conv_id", "chunk"]).select(
        "conv_id", "pos", "role", "text", *((F.sum(f"h{i}").over(along) + F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2))
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no proper prefix of another, one of each equal kind."""
    ends = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    marked = prefixes.select("conv_id", "pos", "p1", "p2").join(ends, "conv_id")
    whole = (
        marked.filter("pos = n_turns").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    )
    inner = marked.filter("pos < n_turns").select("pos", "p1", "p2").distinct()
    return whole.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """One row for each segment of ``PART`` turns: conv_id, part and the rendered text."""
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END))
    part = F.floor((F.col("pos") - 1) / PART).cast("int")
    return (
        turns.groupBy("conv_id", part.alias("part"), "n_turns")
        .agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
        .select("conv_id", "part", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("rendered"))
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns and rendered text of each maximal conversation."""
    prefixes = numbered(turns)
    keep = maximal(prefixes)
    return render(prefixes.select("conv_id", "pos", "role", "text").join(keep, "conv_id"))


ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY pos) AS body FROM p GROUP BY conv_id
), k AS (
  SELECT c.conv_id, c.n_turns FROM c
  WHERE NOT EXISTS (
    SELECT 1 FROM c AS d
    WHERE (d.n_turns > c.n_turns OR d.n_turns = c.n_turns AND d.conv_id < c.conv_id)
      AND d.body[1] IS NOT DISTINCT FROM c.body[1]
      AND d.body[1:c.n_turns] = c.body
  )
)
SELECT k.conv_id, CAST((p.pos - 1) // 256 AS INTEGER) AS part, k.n_turns,
       string_agg('<|im_start|>' || coalesce(p.role, 'unknown') || chr(10) || coalesce(p.text, '') || '<|im_end|>',
                  chr(10) ORDER BY p.pos) AS rendered
FROM k JOIN p ON p.conv_id = k.conv_id
GROUP BY k.conv_id, (p.pos - 1) // 256, k.n_turns
"""
