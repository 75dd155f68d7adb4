"""Places and running sums over a whole table without gathering it in one task.

The table is range-partitioned by the order and sorted in its partitions; rows are ranked or summed inside a
partition, and one number a partition is carried from each to the next. The sorted rows are checkpointed once,
so that both steps see the same partitions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW = (1 << 33) - 1


def _folder(df: DataFrame) -> str:
    """The shared folder of checkpoints."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: later steps neither compute it again nor plan it again."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as Parquet: compressed, and read by column, but without the partitions of ``df``. For large tables."""
    path = f"{_folder(df)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in order, with ``_part`` and ``_row`` (from 0) of each row."""
    tagged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return tagged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit(_ROW))).drop("_at")


def _carried(parts: DataFrame, value: str) -> Column:
    """What all partitions before a row's own add up to; one row a partition is read."""
    pairs, total = [], 0
    for r in sorted(parts.collect(), key=lambda r: r["_part"]):
        pairs += [F.lit(r["_part"]), F.lit(total)]
        total += r[value] or 0
    return F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place from 1. The order must tell all rows apart."""
    rows = _sorted(df, [F.col(c) if isinstance(c, str) else c for c in order])
    before = _carried(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "n")
    return rows.withColumn(name, (before + F.col("_row") + 1).cast("long")).drop("_part", "_row")


def running_sum(df: DataFrame, value: str, *order: str | Column, name: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with each row."""
    rows = _sorted(df, [F.col(c) if isinstance(c, str) else c for c in order])
    before = _carried(rows.groupBy("_part").agg(F.sum(value).alias("n")), "n")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, before + inside).drop("_part", "_row")


def quantiles(df: DataFrame, value: str, **wanted: tuple[str, float]) -> DataFrame:
    """One row: exact ``cont`` (between two values) or ``disc`` (a value) quantiles of a column by name, and its ``most``.

    Equal values are counted first, and the counts are summed up in order: no task holds all values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, "_n", "_value", name="_upto")
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.max("_upto").alias("_all"))))  # one row
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_value")))
    found, out = [], []
    for name, (kind, p) in wanted.items():
        place = (F.col("_all") - 1) * F.lit(p) if kind == "cont" else F.greatest(F.col("_all") - F.floor(F.col("_all") - F.col("_all") * F.lit(p)), F.lit(1)) - 1
        found += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
        low, high, part = F.col(f"{name}_low"), F.col(f"{name}_high"), F.col(f"{name}_part")
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name) if kind == "cont" else low.alias(name))
    return ranked.agg(*found, F.max("_value").alias("most")).select(*out, "most")


def beside(rows: DataFrame, place: str, key: str) -> DataFrame:
    """(key, previous, next) by place: two equi-joins on neighbouring places."""
    at = rows.select(F.col(place).alias("p"), F.col(key).alias("k"))
    left = at.select((F.col("p") + 1).alias("p"), F.col("k").alias("previous"))
    right = at.select((F.col("p") - 1).alias("p"), F.col("k").alias("next"))
    return at.join(left, "p", "left").join(right, "p", "left").select(F.col("k").alias(key), "previous", "next")
