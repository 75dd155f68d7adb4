"""Reports over comments, exports and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import expand_levels

#: Exit codes of an export.
SUCCESS, STRICT_WARNINGS = 0, 2


def comment_counts(comments: DataFrame) -> DataFrame:
    """(page_id, footer, inline, total) of comments (id, page_id, kind, parent_id) with all replies below them.

    A reply counts for its thread's kind (``footer`` or ``inline``) and page. A reply whose parent is missing
    begins a thread; replies that only answer each other in a circle belong to none.
    """
    threads = comments.select(F.col("id").alias("root"), "page_id", "kind")
    inline = F.col("kind") == "inline"
    return (
        expand_levels(comments.select("id", "parent_id"), cycles=False).groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(threads, "root").groupBy("page_id")
        .agg(F.coalesce(F.sum(F.when(~inline, F.col("n"))), F.lit(0)).alias("footer"), F.coalesce(F.sum(F.when(inline, F.col("n"))), F.lit(0)).alias("inline"), F.sum("n").alias("total"))
    )


def export_reports(issues: DataFrame, strict: Column, top: int = 5, failure: Column | None = None) -> DataFrame:
    """(report, info, warning, error, exit_code, top_codes) of issues (report, severity, code, ...).

    ``strict`` and ``failure`` are columns that are the same in all rows of a report. A failure's own code comes
    first; a strict report with a warning or an error exits with 2; all else with 0. ``top_codes`` holds the
    most frequent codes with their counts, ties by code.
    """
    flagged = issues.select("report", "severity", "code", strict.alias("strict"), (F.lit(None).cast("int") if failure is None else failure.cast("int")).alias("failure"))
    counts = flagged.groupBy("report", "severity", "code").agg(F.count(F.lit(1)).alias("n"), F.max("strict").alias("strict"), F.max("failure").alias("failure"))
    of = lambda severity: F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("n"))), F.lit(0)).alias(severity)
    totals = counts.groupBy("report").agg(of("info"), of("warning"), of("error"), F.max("strict").alias("strict"), F.max("failure").alias("failure"))
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("n"), "code"))
    ranked = counts.groupBy("report", "code").agg(F.sum("n").alias("n")).withColumn("place", place).filter(F.col("place") <= top)
    codes = ranked.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("place", "code", "n"))).alias("top"))
    exit_code = F.coalesce("failure", F.when(F.col("strict") & (F.col("warning") + F.col("error") > 0), STRICT_WARNINGS).otherwise(SUCCESS))
    return totals.join(codes, "report").select(
        "report", "info", "warning", "error", exit_code.alias("exit_code"), F.transform("top", lambda x: F.struct(x["code"].alias("code"), x["n"].alias("n"))).alias("top_codes")
    )


def validation_totals(files: DataFrame, issues: DataFrame, by: str) -> DataFrame:
    """(by, files, errors, warnings, passed) of files (file, by) and issues (file, severity); warnings alone pass."""
    found = issues.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    totals = files.join(found, "file", "left").groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"))
    return totals.withColumn("passed", F.col("errors") == 0)
