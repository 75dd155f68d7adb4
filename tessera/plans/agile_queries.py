"""Queries of sprint analytics and time tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numbers, times
from tessera.operators import agile
from tessera.operators.ranks import quantiles
from tessera.plans import views as v
from tessera.plans.register import query


def _points(s, d):
    return agile.with_points(v.issues(s, d))


_METRICS = """SELECT sprint_id, sum(points) AS committed, sum(CASE WHEN status_category = 'done' THEN points ELSE 0 END) AS completed, count(*) AS total_issues,
  count(*) FILTER (status_category = 'done') AS completed_issues FROM v_points GROUP BY 1"""
_SAY_DO = f"SELECT *, CASE WHEN committed > 0 THEN CAST(floor(completed / committed * 100 + 0.5) AS BIGINT) ELSE 0 END AS say_do FROM ({_METRICS})"


@query("SELECT issue_id, points FROM v_points")
def mth01_story_points(s, d):
    return _points(s, d).select("issue_id", "points")


@query("SELECT x, CAST(floor(x + 0.5) AS BIGINT) AS whole, floor(x * 10 + 0.5) / 10 AS tenths FROM (SELECT l_discount * 37 - 1.5 AS x FROM lineitem)")
def mth02_rounding(s, d):
    x = v.table(s, d, "lineitem").select((F.col("l_discount") * 37 - 1.5).alias("x"))
    return x.select("x", numbers.round_half_up(F.col("x")).alias("whole"), numbers.round_half_up(F.col("x"), 1).alias("tenths"))


@query(f"SELECT sprint_id, committed, completed, total_issues, completed_issues, total_issues - completed_issues AS incomplete_issues, 0.0 AS added, 0.0 AS removed, 0 AS scope_change_percent, say_do FROM ({_SAY_DO})")
def agg05_sprint_metrics(s, d):
    return agile.sprint_metrics(_points(s, d))


_SCOPE = """WITH c AS (SELECT issue_id, created, list_transform(regexp_extract_all(coalesce(from_text, ''), 'id=(\\d+)', 1), lambda x: CAST(x AS BIGINT)) AS was,
    list_transform(regexp_extract_all(coalesce(to_text, ''), 'id=(\\d+)', 1), lambda x: CAST(x AS BIGINT)) AS now FROM v_changelog WHERE field = 'Sprint'),
  m AS (SELECT issue_id, created, unnest(list_distinct(list_filter(now, lambda x: NOT list_contains(was, x)))) AS sprint_id, 1 AS a, 0 AS r FROM c
    UNION ALL SELECT issue_id, created, unnest(list_distinct(list_filter(was, lambda x: NOT list_contains(now, x)))), 0, 1 FROM c)
  SELECT m.sprint_id, sum(a * points) AS added, sum(r * points) AS removed FROM m JOIN v_points p ON p.issue_id = m.issue_id
  WHERE m.created >= TIMESTAMP '2024-01-01' + to_days(CAST(m.sprint_id AS INTEGER)) AND m.created <= TIMESTAMP '2024-01-15' + to_days(CAST(m.sprint_id AS INTEGER)) GROUP BY 1"""


def _sprints(s):
    return s.range(0, 12).select(
        F.col("id").alias("sprint_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int))").alias("start_at"), F.expr("timestamp_ntz'2024-01-15' + make_dt_interval(cast(id as int))").alias("end_at"),
    )


@query(_SCOPE)
def agg06_scope_change(s, d):
    return agile.scope_changes(v.changelog(s, d), _points(s, d), _sprints(s))


@query(f"""WITH m AS ({_SAY_DO}), r AS (SELECT *, row_number() OVER (ORDER BY sprint_id) AS place, count(*) OVER () AS n FROM m),
  h AS (SELECT count(*) AS sprints, avg(completed) AS mean, avg(completed) FILTER (place <= n // 2) AS f, avg(completed) FILTER (place > n // 2) AS g FROM r)
  SELECT sprints, CAST(floor(mean + 0.5) AS BIGINT) AS average_velocity, CASE WHEN sprints >= 4 AND f > 0 THEN CAST(floor((g - f) / f * 100 + 0.5) AS BIGINT) END AS trend FROM h""")
def agg07_velocity(s, d):
    return agile.velocity(agile.sprint_metrics(_points(s, d)))


@query("""WITH m AS (SELECT *, row_number() OVER (ORDER BY sprint_id) AS place, count(*) OVER () AS n FROM (SELECT sprint_id FROM v_points GROUP BY 1)) SELECT sprint_id, CASE WHEN place <= n // 2 THEN 'first' ELSE 'second' END AS half FROM m""")
def win02_velocity_halves(s, d):
    from pyspark.sql import Window

    sprints = _points(s, d).select("sprint_id").distinct()
    place, n = F.row_number().over(Window.orderBy("sprint_id")), F.count(F.lit(1)).over(Window.partitionBy())
    return sprints.select("sprint_id", place.alias("place"), n.alias("n")).select("sprint_id", F.when(F.col("place") <= F.floor(F.col("n") / 2), "first").otherwise("second").alias("half"))


_DONE = """SELECT p.issue_id, p.points, coalesce(s.at_, p.resolved) AS completed_at FROM v_points p LEFT JOIN
  (SELECT issue_id, arg_max(created, pos) AS at_ FROM v_changelog WHERE field = 'status' GROUP BY 1) s USING (issue_id) WHERE p.status_category = 'done' AND coalesce(s.at_, p.resolved) IS NOT NULL"""


@query(f"SELECT CAST(CAST(completed_at AS DATE) AS VARCHAR) AS day, sum(points) AS points FROM ({_DONE}) WHERE points <> 0 GROUP BY 1")
def agg08_completion_timeline(s, d):
    return agile.completion_timeline(agile.completion_times(_points(s, d), v.changelog(s, d))).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT issue_id, completed_at FROM ({_DONE})")
def jn14_completion_dates(s, d):
    return agile.completion_times(_points(s, d), v.changelog(s, d)).select("issue_id", "completed_at")


@query(f"""WITH t AS (SELECT CAST(completed_at AS DATE) AS day, sum(points) AS points FROM ({_DONE}) WHERE points <> 0 GROUP BY 1),
  g AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-03-31', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT CAST(g.day AS VARCHAR) AS day, 5000.0 - sum(coalesce(points, 0)) OVER (ORDER BY g.day) AS remaining, floor((5000.0 - 5000.0 / 89 * (g.day - DATE '1997-01-01')) * 10 + 0.5) / 10 AS ideal FROM g LEFT JOIN t USING (day)""")
def win01_burndown(s, d):
    timeline = agile.completion_timeline(agile.completion_times(_points(s, d), v.changelog(s, d)))
    return agile.burndown(timeline, 5000.0, "1997-01-01", "1997-03-31").withColumn("day", F.col("day").cast("string"))


@query(f"SELECT sprint_id, say_do, CASE WHEN say_do <= 10 THEN 'stable' WHEN say_do <= 25 THEN 'moderate' ELSE 'unstable' END AS band FROM ({_SAY_DO})")
def agg09_stability_bands(s, d):
    return agile.sprint_metrics(_points(s, d)).select("sprint_id", "say_do", agile.stability(F.col("say_do")).alias("band"))


@query(f"SELECT count(*) AS sprints, CAST(floor(avg(say_do) + 0.5) AS BIGINT) AS average_say_do, CASE WHEN floor(avg(say_do) + 0.5) >= 80 THEN 'high' WHEN floor(avg(say_do) + 0.5) >= 60 THEN 'moderate' ELSE 'low' END AS band FROM ({_SAY_DO})")
def agg10_predictability(s, d):
    return agile.predictability(agile.sprint_metrics(_points(s, d)))


@query("""SELECT epic_id, count(*) FILTER (status_category = 'done') AS done, count(*) FILTER (status_category = 'indeterminate') AS indeterminate, count(*) FILTER (status_category = 'new') AS new, count(*) AS total,
  CAST(floor(count(*) FILTER (status_category = 'done') * 100.0 / count(*) + 0.5) AS BIGINT) AS percent_done FROM v_issues GROUP BY 1""")
def agg11_epic_progress(s, d):
    return agile.epic_progress(v.issues(s, d))


@query("""WITH t AS (SELECT CAST(sum(seconds) AS BIGINT) AS total_seconds, count(*) AS entries, count(DISTINCT issue_id) AS issues, min(CAST(split_part(started, 'T', 1) AS DATE)) AS first_day, max(CAST(split_part(started, 'T', 1) AS DATE)) AS last_day FROM v_worklogs)
  SELECT total_seconds, entries, issues, CAST(floor(total_seconds / greatest(1, ceil((last_day - first_day + 1) * 5 / 7)) + 0.5) AS BIGINT) AS average_seconds FROM t""")
def agg12_worklog_report(s, d):
    return agile.worklog_report(v.worklogs(s, d)).drop("first_day", "last_day")


@query("SELECT split_part(started, 'T', 1) AS key, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) AS entries, max(started) AS latest FROM v_worklogs GROUP BY 1")
def agg13_worklogs_by_date(s, d):
    return agile.worklogs_by(v.worklogs(s, d), "date")


@query("SELECT issue_id, author_id, started FROM v_worklogs WHERE split_part(started, 'T', 1) BETWEEN '1997-01-01' AND '1997-06-30' AND (author_id = 'author 7' OR contains(lower(coalesce(author_name, '')), 'author 7'))")
def prd10_worklog_filter(s, d):
    return agile.filter_worklogs(v.worklogs(s, d), "1997-01-01", "1997-06-30", "author 7").select("issue_id", "author_id", "started")


@query("SELECT i.issue_key, w.author_id, coalesce(w.author_name, 'Unknown') AS author, w.seconds FROM v_worklogs w JOIN v_issues i USING (issue_id)")
def prj02_worklogs_with_issues(s, d):
    return v.worklogs(s, d).join(v.issues(s, d), "issue_id").select("issue_key", "author_id", F.coalesce("author_name", F.lit("Unknown")).alias("author"), "seconds")


@query("SELECT issue_id, started FROM v_worklogs ORDER BY started DESC, issue_id")
def srt05_latest_worklogs(s, d):
    return v.worklogs(s, d).select("issue_id", "started").orderBy(F.desc("started"), "issue_id")


_D = "SELECT DISTINCT l_orderkey % 400 AS k FROM lineitem"


@query(f"""SELECT k, CASE k % 5 WHEN 0 THEN k // 60 * 3600 + k % 60 * 60 WHEN 1 THEN CAST(floor(k * 0.5 * 3600 + 0.5) AS BIGINT) WHEN 2 THEN k * 60 WHEN 3 THEN (k % 3) * 144000 + 2 * 28800 + (k % 7) * 3600 + 4 * 60 END AS seconds FROM ({_D})""")
def dat01_parse_durations(s, d):
    k = v.table(s, d, "lineitem").select((F.col("l_orderkey") % 400).alias("k")).distinct()
    text = F.expr("CASE k % 5 WHEN 0 THEN concat(k div 60, ':', lpad(cast(k % 60 as string), 2, '0')) WHEN 1 THEN concat(cast(k * 0.5 as double), 'h') WHEN 2 THEN concat(k, ' minutes') WHEN 3 THEN concat(k % 3, 'w 2d ', k % 7, 'h 4m') ELSE 'soon' END")
    return k.select("k", times.duration_seconds(text).alias("seconds"))


@query(f"""WITH x AS (SELECT k, k * 1931 AS t FROM ({_D})), y AS (SELECT k, t // 144000 AS w, t % 144000 // 28800 AS d, t % 28800 // 3600 AS h, t % 3600 // 60 AS m FROM x)
  SELECT k, CASE WHEN w + d + h + m = 0 THEN '0m' ELSE concat_ws(' ', CASE WHEN w > 0 THEN concat(w, 'w') END, CASE WHEN d > 0 THEN concat(d, 'd') END, CASE WHEN h > 0 THEN concat(h, 'h') END, CASE WHEN m > 0 THEN concat(m, 'm') END) END AS short FROM y""")
def dat02_compact_durations(s, d):
    k = v.table(s, d, "lineitem").select((F.col("l_orderkey") % 400).alias("k")).distinct()
    return k.select("k", times.compact_duration(F.col("k") * 1931).alias("short"))


@query(f"""WITH y AS (SELECT k, k * 47 // 3600 AS h, k * 47 % 3600 // 60 AS m FROM ({_D})) SELECT k, CASE WHEN h + m = 0 THEN '0 minutes' ELSE
  concat_ws(' ', CASE WHEN h > 0 THEN concat(h, ' hour', CASE WHEN h = 1 THEN '' ELSE 's' END) END, CASE WHEN m > 0 THEN concat(m, ' minute', CASE WHEN m = 1 THEN '' ELSE 's' END) END) END AS said FROM y""")
def dat03_spoken_durations(s, d):
    k = v.table(s, d, "lineitem").select((F.col("l_orderkey") % 400).alias("k")).distinct()
    return k.select("k", times.spoken_duration(F.col("k") * 47).alias("said"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(s / 900 + 0.5) * 900 AS BIGINT) AS nearest, CAST(ceil(s / 900) * 900 AS BIGINT) AS up, CAST(floor(s / 900) * 900 AS BIGINT) AS down FROM (SELECT l_orderkey, l_linenumber, l_quantity * 137 AS s FROM lineitem)")
def dat04_rounded_durations(s, d):
    x = F.col("l_quantity") * 137
    return v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(times.round_duration(x, 15, m).alias(m) for m in ("nearest", "up", "down")))


@query("SELECT event_id, ts - CASE event_id % 4 WHEN 0 THEN to_days(CAST(event_id % 30 AS INTEGER)) WHEN 1 THEN to_days(CAST(7 * (event_id % 5) AS INTEGER)) WHEN 2 THEN to_months(CAST(event_id % 6 AS INTEGER)) ELSE to_hours(event_id % 48) END AS since FROM events")
def dat06_relative_dates(s, d):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN concat(event_id % 30, 'd') WHEN 1 THEN concat(event_id % 5, 'w') WHEN 2 THEN concat(event_id % 6, 'm') ELSE concat(event_id % 48, 'h') END")
    return v.table(s, d, "events").select("event_id", times.relative_period(text, F.col("ts").cast("timestamp")).alias("since"))


@query("SELECT event_id, ts - to_minutes(event_id % 90) AS since FROM events")
def dat07_relative_log_times(s, d):
    return v.table(s, d, "events").select("event_id", times.relative_period(F.expr("concat(event_id % 90, 'm')"), F.col("ts").cast("timestamp"), minutes=True).alias("since"))


@query("SELECT o_orderkey, greatest(0, (2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate)) AS months FROM orders")
def dat08_calendar_months(s, d):
    return v.table(s, d, "orders").select("o_orderkey", times.months_between_calendar(F.col("o_orderdate"), F.lit(v.AS_OF).cast("timestamp")).alias("months"))


@query("""WITH x AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS n FROM orders)
  SELECT o_orderkey, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 30 THEN concat(n, ' days ago') WHEN n < 365 THEN concat(n // 30, ' month', CASE WHEN n // 30 = 1 THEN '' ELSE 's' END, ' ago')
  ELSE concat(n // 365, ' year', CASE WHEN n // 365 = 1 THEN '' ELSE 's' END, ' ago') END AS ago FROM x""")
def dat09_time_ago(s, d):
    return v.table(s, d, "orders").select("o_orderkey", times.time_ago(F.col("o_orderdate"), F.lit("1998-08-02").cast("timestamp")).alias("ago"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, concat(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '.000+0000') AS stamp FROM orders")
def dat10_formatted_dates(s, d):
    return v.table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'").alias("stamp"))


@query("SELECT DISTINCT started, regexp_extract(started, '^\\d{4}-\\d{2}-\\d{2}') AS day FROM v_worklogs")
def dat12_iso_days(s, d):
    day = F.regexp_extract("started", r"^\d{4}-\d{2}-\d{2}", 0)
    return v.worklogs(s, d).select("started").distinct().select("started", F.when(day != "", day).otherwise(F.col("started")).alias("day"))


@query("""SELECT k, CASE WHEN k % 3 = 0 THEN k * 1000 + 0.5 WHEN k % 3 = 1 THEN CAST(k AS DOUBLE) / 100 END AS value FROM (SELECT DISTINCT l_orderkey % 400 AS k FROM lineitem)""")
def mth03_localized_numbers(s, d):
    k = v.table(s, d, "lineitem").select((F.col("l_orderkey") % 400).alias("k")).distinct()
    text = F.expr("CASE k % 3 WHEN 0 THEN concat(k, CASE WHEN k > 0 THEN '.000' ELSE '' END, ',5') WHEN 1 THEN concat(k, '%') ELSE 'none' END")
    return k.select("k", numbers.localized_number(text, "de-DE").alias("value"))


@query("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS median, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95, max(l_extendedprice) AS most FROM lineitem")
def agg26_median_p95(s, d):
    return quantiles(v.table(s, d, "lineitem"), "l_extendedprice", median=("cont", 0.5), p95=("disc", 0.95))


@query("SELECT o_orderkey, concat(repeat('#', CAST(floor(p / 5 + 0.5) AS INTEGER)), repeat('.', CAST(20 - floor(p / 5 + 0.5) AS INTEGER))) AS bar FROM (SELECT o_orderkey, o_orderkey % 101 AS p FROM orders)")
def str21_progress_bars(s, d):
    full = numbers.round_half_up(F.col("o_orderkey") % 101 / 5).cast("int")
    return v.table(s, d, "orders").select("o_orderkey", F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), 20 - full)).alias("bar"))
