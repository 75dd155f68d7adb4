"""Deletion of whole days of logged rows, in two steps: what would go, and its removal.

Days are folders (``day=2024-01-31``), so what goes is decided from the folder listing alone and no row is read.
The plan is made and looked at first; removal lists again, takes only what both lists have, and is safe to repeat:
a day that is gone already is told as such. Everything runs on the Hadoop file system of the path.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

PLAN = "day date, path string, files long, bytes long"


def _folders(spark: SparkSession, path: str) -> list[tuple[dt.date, str, int, int]]:
    """Day folders below ``path`` with their files and bytes: one entry a day, whatever they hold."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    out = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and (m := re.fullmatch(r"day=(\d{4}-\d{2}-\d{2})", name)):
            try:
                day = dt.date.fromisoformat(m[1])
            except ValueError:
                continue  # not a day: nobody's to delete
            held = files.getContentSummary(status.getPath())
            out.append((day, status.getPath().toString(), int(held.getFileCount()), int(held.getLength())))
    return sorted(out)


def clearing_plan(spark: SparkSession, path: str, before: str | dt.date | None = None) -> DataFrame:
    """(day, path, files, bytes) of the days before ``before`` (all days without it). A text that is no date is refused."""
    limit = dt.date.fromisoformat(before) if isinstance(before, str) else before
    return spark.createDataFrame([f for f in _folders(spark, path) if limit is None or f[0] < limit], PLAN)


def clear_days(spark: SparkSession, path: str, before: str | dt.date | None = None, *, confirm: bool = False) -> DataFrame:
    """Deletes what :func:`clearing_plan` names and returns (day, files, bytes, state): ``deleted``, ``gone`` or ``failed``.

    Without ``confirm`` nothing is touched and it raises. A folder that changed between the two listings stays
    (``changed``) for the next call.
    """
    if not confirm:
        raise ValueError("confirm the deletion of logs")
    planned = [tuple(r) for r in clearing_plan(spark, path, before).collect()]
    there = {f[1]: f for f in _folders(spark, path)}
    out = []
    for day, folder, n, size in planned:
        if folder not in there:
            state = "gone"
        elif there[folder][2:] != (n, size):
            state = "changed"
        else:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            state = "deleted" if p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) else "failed"
        out.append((day, n, size, state))
    return spark.createDataFrame(out, "day date, files long, bytes long, state string")
