"""Mergeable sketches by day: distinct counts (HyperLogLog) and quantiles (KLL) of any range of days without its rows.

A day's sketches are a few kilobytes whatever it holds; they are written once, and a range merges the sketches of
its days. Bounds are stated with the size of a sketch: a distinct count of 2^12 registers has a standard error of
about 1.04 / sqrt(2^12) = 1.6 %, and a quantile of K = 200 is within 1.65 % of its rank for 99 of 100 sketches.

Defined cases: null values are in no sketch; days without rows have none; a range without days gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS, K = 12, 200
#: Three standard errors of a distinct count, and twice the stated error of a rank.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2), 2 * 0.0165


def daily(rows: DataFrame, day: str, item: str, value: str) -> DataFrame:
    """(day, n, items, values): the sketches of each day's items and values."""
    return rows.groupBy(F.to_date(day).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(item, REGISTERS).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("values")
    )


def over_ranges(sketches: DataFrame, ranges: DataFrame, quantile: float = 0.5) -> DataFrame:
    """(first_day, last_day, n, distinct_about, quantile_about) of each range; days meet the ranges that they lie in."""
    # A day meets a range by equality: ranges are spelled out in days.
    days = ranges.select("first_day", "last_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    merged = sketches.join(days, "day").groupBy("first_day", "last_day").agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))
    return merged.select("first_day", "last_day", "n", F.hll_sketch_estimate("items").alias("distinct_about"), F.kll_sketch_get_quantile_double("values", F.lit(quantile)).alias("quantile_about"))
