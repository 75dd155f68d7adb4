"""Chart data: tables to series and back, points, label grids, shares, stacks, extents, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import localized_number

#: What a plan table's columns are told by.
TASK_COLUMNS = {"label": "task|name|activity|plan|actual", "start": "start|begin", "end": "end|finish|due", "progress": "progress|status|percent|complete", "dependencies": "depend|predecessor"}


def series_from_columns(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, series, value): each column is a series."""
    return rows.unpivot([label], columns, "series", "value").withColumnRenamed(label, "label")


def series_from_rows(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, series, value): each row is a series and each column a label."""
    return rows.unpivot([label], columns, "column", "value").select(F.col("column").alias("label"), F.col(label).cast("string").alias("series"), "value")


def points(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """(x, y) of the rows where both are numbers."""
    return rows.select(x.try_cast("double").alias("x"), y.try_cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


def label_grid(values: DataFrame) -> DataFrame:
    """Every label of every series; what is missing is 0 and marked."""
    labels, series = values.select("label").distinct(), values.select("series").distinct()
    # The grid is the wanted result, so its size is labels x series whatever their number; neither side is cut
    # and none is forced into a broadcast.
    grid = labels.crossJoin(series)
    return grid.join(values, ["label", "series"], "left").withColumn("missing", F.col("value").isNull()).withColumn("value", F.coalesce("value", F.lit(0.0)))


def shares(values: DataFrame, value: str = "value") -> DataFrame:
    """Shares of a pie: negatives count as 0, and a sum of 0 as 1."""
    positive = F.greatest(F.col(value), F.lit(0.0))
    total = F.sum(positive).over(Window.partitionBy())
    return values.withColumn("share", positive / F.when(total == 0, 1.0).otherwise(total))


def stacked(values: DataFrame) -> DataFrame:
    """(start, end) of each bar; values above and below zero are stacked apart."""
    w = Window.partitionBy("label", F.col("value") < 0).orderBy("series").rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("end", F.sum("value").over(w)).withColumn("start", F.col("end") - F.col("value"))


def extent(values: DataFrame, x: str) -> DataFrame:
    """Least, greatest and least gap of distinct values, and the ends padded by half a gap."""
    gaps = values.select(x).distinct().withColumn("gap", F.col(x) - F.lag(x).over(Window.orderBy(x)))
    e = gaps.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.min("gap").alias("gap"))
    half = F.coalesce(F.col("gap"), F.lit(1.0)) / 2
    return e.withColumn("padded_low", F.col("low") - half).withColumn("padded_high", F.col("high") + half)


def property_report(properties: DataFrame, keys: list[str]) -> DataFrame:
    """One row a page, one column a property; the first value of a repeated property counts."""
    first = properties.groupBy("page_id", F.lower("label").alias("label")).agg(F.min_by("value", "pos").alias("value"))
    return first.groupBy("page_id").pivot("label", keys).agg(F.first("value"))


def first_seen(properties: DataFrame) -> DataFrame:
    """(label, place): labels in the order in which they first appear."""
    seen = properties.groupBy("label").agg(F.min(F.struct("page_id", "pos")).alias("at"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy("at", "label"))).select("label", "place")


def gantt_dependencies(tasks: DataFrame) -> DataFrame:
    """(id, depends_on): names in ``after`` resolve by id, label or place; later aliases win."""
    alias = (
        tasks.select(F.col("place").cast("string").alias("name"), "id", F.struct(F.lit(0), "place").alias("rank"))
        .unionByName(tasks.select(F.lower("label").alias("name"), "id", F.struct(F.lit(1), "place").alias("rank")))
        .unionByName(tasks.select(F.lower("id").alias("name"), "id", F.struct(F.lit(2), "place").alias("rank")))
        .groupBy("name").agg(F.max_by("id", "rank").alias("depends_on"))
    )
    wanted = tasks.select("id", F.explode(F.transform(F.split("after", ","), lambda x: F.lower(F.trim(x)))).alias("name"))
    return wanted.join(alias, "name").select("id", "depends_on")


def gantt_tasks(rows: DataFrame, *, locale: str = "en", dates: tuple[str, ...] = ("yyyy-MM-dd",), selected: list[int] | None = None) -> DataFrame:
    """(table_id, row_no, label, start, end, progress, dependencies) of rows (table_id, row_no, header, cells).

    Columns are found by their headers, the first that fits; without a header for the label the first column is
    it. Of ``selected`` columns (from 0) alone are searched. A progress beyond 1 is a percentage, at most 1 in
    the end. Rows without a label or a date that can be read, and tables without both dates, have no task.
    """
    place = lambda pattern: F.array_position(
        F.transform("header", lambda h, i: F.coalesce(F.lower(h).rlike(pattern) & (F.lit(True) if selected is None else i.isin(selected)), F.lit(False))), True
    ).cast("int")
    cell = lambda name: F.get("cells", place(TASK_COLUMNS[name]) - 1)
    date = lambda name: F.coalesce(*(F.try_to_timestamp(F.trim(cell(name)), F.lit(f)) for f in dates))
    number = localized_number(cell("progress"), locale)
    parts = F.filter(F.transform(F.split(F.coalesce(cell("dependencies"), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    found = rows.select(
        "table_id", "row_no", F.coalesce(F.get("cells", F.greatest(place(TASK_COLUMNS["label"]) - 1, F.lit(0))), F.concat(F.lit("Task "), "row_no")).alias("label"), date("start").alias("start"), date("end").alias("end"),
        F.least(F.when(number > 1, number / 100).otherwise(number), F.when(number.isNotNull(), F.lit(1.0))).alias("progress"), parts.alias("dependencies"),
    )
    return found.filter((F.col("label") != "") & F.col("start").isNotNull() & F.col("end").isNotNull())


#: The limits of a chart.
ROWS, SERIES, POINTS, TASKS, TEXT = 2000, 64, 20_000, 5000, 10_000


def value_issues(values: DataFrame) -> DataFrame:
    """(chart, code, n) of charts of categories and points: rows of (chart, mode, series, label, value).

    Categories must all have each of the chart's labels once; every count is pre-aggregated, and no chart is gathered.
    """
    text = F.trim(F.coalesce(F.col("label").cast("string"), F.lit("")))
    bad = lambda what: F.count_if(what)
    by_series = values.groupBy("chart", "mode", "series").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), bad(text == "").alias("empty"), bad(F.char_length(text) > TEXT).alias("long"),
        bad(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("infinite"),
    )
    labels = values.groupBy("chart").agg(F.count_distinct("label").alias("all_labels"))
    category = F.col("mode") == "categories"
    found = by_series.join(labels, "chart").groupBy("chart", "mode").agg(
        F.count(F.lit(1)).alias("series"), F.sum("n").alias("n"), F.max("all_labels").alias("labels"), F.count_if(category & ((F.col("n") != F.col("all_labels")) | (F.col("labels") != F.col("all_labels")))).alias("uneven"),
        F.count_if(~category & (F.col("n") > ROWS)).alias("wide"), F.sum("empty").alias("empty"), F.sum("long").alias("long"), F.sum("infinite").alias("infinite"), F.count_if(F.trim(F.coalesce("series", F.lit(""))) == "").alias("nameless"),
    )
    over = lambda c, most: F.when(F.col(c) > most, F.col(c) - most).otherwise(0)
    codes = {
        "too-many-series": over("series", SERIES), "too-many-rows": F.when(category, over("labels", ROWS)).otherwise(F.col("wide")), "too-many-points": F.when(category, 0).otherwise(over("n", POINTS)), "uneven-series": F.col("uneven"),
        "empty-label": F.when(category, F.col("empty")).otherwise(0), "long-text": F.col("long"), "not-finite": F.col("infinite"), "nameless-series": F.col("nameless"),
    }
    told = found.select("chart", F.explode(F.array(*(F.struct(F.lit(k).alias("code"), c.cast("long").alias("n")) for k, c in codes.items()))).alias("x"))
    return told.select("chart", "x.code", "x.n").filter("n > 0")


def task_issues(tasks: DataFrame) -> DataFrame:
    """(chart, code, n) of charts of tasks: rows of (chart, id, label, start, end, progress); dates are ISO texts."""
    iso = r"^\d{4}-\d{2}-\d{2}(T\S+)?$"
    day = lambda c: F.when(F.col(c).rlike(iso), F.try_to_timestamp(c))
    told = tasks.withColumn("from", day("start")).withColumn("to", day("end"))
    sums = told.groupBy("chart").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.trim(F.coalesce("id", F.lit(""))) == "").alias("nameless"), F.count_if(F.col("from").isNull() | F.col("to").isNull()).alias("undated"),
        F.count_if(F.col("to") < F.col("from")).alias("reversed"), F.count_if(~F.col("progress").between(0, 1)).alias("beyond"),
    )
    codes = {"too-many-tasks": F.when(F.col("n") > TASKS, F.col("n") - TASKS).otherwise(0), "repeated-id": F.col("n") - F.col("ids") - F.col("nameless"), "nameless-task": F.col("nameless"), "no-date": F.col("undated"), "ends-before-start": F.col("reversed"), "progress-beyond": F.col("beyond")}
    return sums.select("chart", F.explode(F.array(*(F.struct(F.lit(k).alias("code"), c.cast("long").alias("n")) for k, c in codes.items()))).alias("x")).select("chart", "x.code", "x.n").filter("n > 0")
