"""Registered access queries with their DuckDB statements."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window, functions as F

from turnstone import constants as K
from turnstone.catalog import query
from turnstone.functions import plates as P
from turnstone.operators import access as Q, joins as J, presence as S, sessions
from turnstone.operators.dedup import duplicate_ids
from turnstone.operators.reports import PresenceReport, in_period, report_period, request_periods
from turnstone.plans.access_sql import PLATE, sql
from turnstone.session import materialize
from turnstone.sources.access import AccessTables, plate_of

DAY = date(2024, 1, 15)
D = "DATE '2024-01-15'"
PLATE_8 = "00008-I-9"
NAME_8 = "Customer#000000008"
AS_OF = datetime(2024, 1, 31, 18, 0)

HEAD = """SELECT p.id, p.plate_number, p.entry_time, p.exit_time, p.status, e.full_name AS employee_name,
  e.department, v.owner_name, v.vehicle_type
FROM logs p LEFT JOIN employees e ON e.plate_number = p.plate_number
LEFT JOIN vehicles v ON v.plate_number = p.plate_number """
SHORT = HEAD.replace(" p.exit_time,", "")


def access(key: str, text: str | None = None, *more: str):
    """Registers ``fn(tables)``; the statement gets the derived tables as named sub-queries."""

    def add(fn):
        query(key, sql(text, *more) if text else None)(lambda spark, folder: fn(AccessTables(spark, folder)))
        return fn

    return add


# -- sources -----------------------------------------------------------------------------------------
access("src_vehicles", "SELECT * FROM vehicles WHERE status = 'AUTHORIZED'")(
    lambda t: t.vehicles.filter(F.col("status") == K.AUTHORIZED))
access("src_employees", "SELECT * FROM employees WHERE is_active")(lambda t: t.employees.filter("is_active"))
access("src_logs_range", f"SELECT * FROM logs WHERE entry_time >= {D} AND entry_time < DATE '2024-01-18'")(
    lambda t: t.logs_between(DAY, date(2024, 1, 17)).orderBy("entry_time", "id"))
access("src_unknown_range", f"SELECT * FROM unknown_detections WHERE detected_at >= {D} AND detected_at < DATE '2024-01-22'")(
    lambda t: t.unknown_between(DAY, date(2024, 1, 21)).orderBy("detected_at", "id"))
access("src_logs_recent", "SELECT * FROM logs WHERE status = 'AUTHORIZED' ORDER BY entry_time DESC, id LIMIT 50")(
    lambda t: Q.newest(t.logs.filter(F.col("status") == K.AUTHORIZED), 50))
access("src_access_logs", "SELECT * FROM access_logs")(lambda t: t.access_logs)

# -- filters -----------------------------------------------------------------------------------------
COLS = ("id", "plate_number", "entry_time", "status")
SEL = "SELECT id, plate_number, entry_time, status FROM logs WHERE "
for _key, _where, _days, _cond in [
    ("flt_on_date", f"entry_time::DATE = {D}", (DAY, DAY), lambda: Q.on_day("entry_time", DAY)),
    ("flt_date_range", f"entry_time::DATE BETWEEN {D} AND DATE '2024-01-17'", (DAY, date(2024, 1, 17)),
     lambda: Q.between_days("entry_time", DAY, date(2024, 1, 17))),
    ("flt_time_between", "entry_time::TIME BETWEEN TIME '08:00:00' AND TIME '09:30:00'", (None, None),
     lambda: Q.second_of_day(F.col("entry_time")).between(Q.seconds("08:00:00"), Q.seconds("09:30:00"))),
    ("flt_after_cutoff", "entry_time::TIME > TIME '09:15:00'", (None, None),
     lambda: Q.second_of_day(F.col("entry_time")) > K.LATE_CUTOFF_MINUTES * 60),
    ("flt_status_in", "status IN ('BLACKLISTED', 'DENIED')", (None, None), lambda: F.col("status").isin(K.BLACKLISTED, K.DENIED)),
    ("flt_open", "exit_time IS NULL", (None, None), lambda: F.col("exit_time").isNull()),
]:
    access(_key, SEL + _where)(lambda t, c=_cond, d=_days: t.logs_between(*d).filter(c()).select(*COLS))

# Equality to the second needs whole-second times: order dates at midnight have them.
query("flt_time_equals", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate::TIME = TIME '00:00:00'")(
    lambda spark, d: AccessTables(spark, d).read("orders")
    .filter(Q.second_of_day(F.col("o_orderdate")) == 0).select("o_orderkey", "o_orderdate"))
access("flt_name_ci", "SELECT * FROM employees WHERE lower(full_name) = lower('CUSTOMER#000000011')")(
    lambda t: t.employees.filter(F.lower("full_name") == "CUSTOMER#000000011".lower()))
access("flt_access_search", f"""SELECT p.id, p.plate_number, p.entry_time, e.full_name AS employee_name
  FROM logs p LEFT JOIN employees e USING (plate_number)
  WHERE lower(regexp_replace(p.plate_number, '[\\s-]+', '', 'g')) = '00008i9' AND hour(p.entry_time) >= 8""")(
    lambda t: S.access_search(J.enrich(t.logs, t.employees), "00008 i-9", "8").select(
        "id", "plate_number", "entry_time", "employee_name"))

# -- joins -------------------------------------------------------------------------------------------
access("jn_log_enrich", HEAD)(lambda t: J.enrich(t.logs, t.employees, t.vehicles).select(*Q._HEAD))
access("jn_log_employee_inner", "SELECT p.id, p.plate_number, e.full_name, e.department FROM logs p JOIN employees e USING (plate_number)")(
    lambda t: t.logs.join(t.employees.drop("id"), "plate_number").select("id", "plate_number", "full_name", "department"))
access("jn_absent_anti", f"""SELECT full_name, department, plate_number FROM employees e WHERE is_active AND NOT EXISTS (
  SELECT 1 FROM logs p WHERE p.plate_number = e.plate_number AND p.entry_time::DATE = {D})""")(
    lambda t: Q.absent_on(t.logs_between(DAY, DAY), t.employees, DAY))
access("jn_latest_self", """SELECT l.* FROM access_logs l JOIN (SELECT plate_number, max(access_time) AS m FROM access_logs GROUP BY 1) x
  ON x.plate_number = l.plate_number AND x.m = l.access_time""")(
    lambda t: J.latest_rows(t.access_logs, "plate_number", "access_time"))
DIRECTORY = """directory AS (
  SELECT coalesce(e.plate_number, v.plate_number) AS plate_number, coalesce(e.full_name, v.owner_name) AS full_name,
    coalesce(e.department, v.vehicle_type) AS department, e.employee_code, coalesce(e.is_active, true) AS is_active
  FROM employees e FULL JOIN (SELECT * FROM vehicles WHERE status = 'AUTHORIZED') v ON v.plate_number = e.plate_number)"""
# Raw plate texts, as the readers wrote them, against the directory.
access("jn_tiered_plate", """SELECT r.event_id, d.full_name FROM (SELECT event_id, plate_number FROM det WHERE plate_number <> '') r
  LEFT JOIN directory d USING (plate_number)""", DIRECTORY)(
    lambda t: _tiered(t))
access("jn_vehicle_lookup", """SELECT x.event_id, v.plate_number AS matched_plate, v.owner_name
  FROM det x JOIN vehicles v ON v.plate_number = x.plate_number""")(
    lambda t: t.raw_detections.withColumnRenamed("plate_text", "plate_number").join(
        J.lookup_vehicle(t.raw_detections.select(F.col("plate_text").alias("plate_number")), t.vehicles),
        "plate_number").select("event_id", "matched_plate", "owner_name"))
access("jn_attach_name", """SELECT p.id, p.plate_number, coalesce(CASE WHEN p.id % 2 = 0 THEN 'given' END, e.full_name) AS employee_name
  FROM logs p LEFT JOIN employees e USING (plate_number)""")(
    lambda t: J.attach_names(t.logs.withColumn("employee_name", F.when(F.col("id") % 2 == 0, "given")), t.employees)
    .select("id", "plate_number", "employee_name"))
access("jn_directory_merge", "SELECT * FROM directory", DIRECTORY)(lambda t: J.directory(t.employees, t.vehicles))
access("jn_unknown_outside_directory", f"""SELECT plate_number, detected_at FROM unknown_detections
  WHERE plate_number NOT IN (SELECT plate_number FROM employees WHERE is_active)""")(
    lambda t: t.unknown.join(J.known_plates(t.unknown, J.active_directory(t.employees)), "plate_number", "left_anti")
    .select("plate_number", "detected_at"))
access("jn_plate_suggest", """SELECT DISTINCT r.plate_number, s.plate_number AS suggestion FROM
  (SELECT DISTINCT split_part(plate_number, '-', 1) || '-Z-' || split_part(plate_number, '-', 3) AS plate_number FROM det WHERE plate_number <> '') r
  JOIN (SELECT plate_number FROM employees UNION SELECT plate_number FROM vehicles) s
  ON split_part(s.plate_number, '-', 1) = split_part(r.plate_number, '-', 1) AND split_part(s.plate_number, '-', 3) = split_part(r.plate_number, '-', 3)""")(
    lambda t: J.suggest_plates(
        t.detections.filter("plate_number <> ''").select(
            F.regexp_replace("plate_number", "-[A-Z]-", "-Z-").alias("plate_number")), t.employees, t.vehicles))


def _tiered(t: AccessTables):
    seen = t.raw_detections.filter("plate_text <> ''").withColumnRenamed("plate_text", "plate_number")
    people = J.directory(t.employees, t.vehicles).withColumn("_n", F.lower(F.coalesce("full_name", F.lit(""))))
    match = J.match_plates(seen, people, ["_n"]).join(
        people.select(F.col("plate_number").alias("matched_plate"), "full_name"), "matched_plate")
    return seen.join(match, "plate_number", "left").select("event_id", "full_name")


# -- aggregates --------------------------------------------------------------------------------------
access("agg_denied_count", f"SELECT count(*) AS denied_count FROM logs WHERE entry_time::DATE = {D} AND status IN ('BLACKLISTED','DENIED')")(
    lambda t: Q.denied_count(t.logs_between(DAY, DAY), DAY))
MOST = """SELECT plate_number, count(*) AS detections FROM logs WHERE entry_time::DATE BETWEEN {a} AND {b}
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
access("agg_most_detected", MOST.format(a="DATE '2024-01-01'", b="DATE '2024-01-31'"))(
    lambda t: Q.most_detected(t.logs_between(date(2024, 1, 1), date(2024, 1, 31)), date(2024, 1, 1), date(2024, 1, 31)))
TOP = """SELECT p.plate_number, round(sum(epoch_us(coalesce(exit_time, TIMESTAMP '2024-01-31 18:00:00')) - epoch_us(entry_time)) / 6e7, 4) AS total_minutes,
  e.full_name AS employee_name, e.department FROM logs p LEFT JOIN employees e USING (plate_number)
  WHERE entry_time::DATE BETWEEN {a} AND {b} AND p.status = 'AUTHORIZED' GROUP BY ALL
  ORDER BY total_minutes DESC, plate_number LIMIT 5"""


def _top(t, a, b):
    return Q.top_presence(t.logs_between(a, b), t.employees, a, b, AS_OF).withColumn("total_minutes", F.round("total_minutes", 4))


access("agg_top_presence", TOP.format(a="DATE '2024-01-01'", b="DATE '2024-01-31'"))(
    lambda t: _top(t, date(2024, 1, 1), date(2024, 1, 31)))
STATS = f"""SELECT (SELECT count(*) FROM vehicles) AS total_vehicles,
  (SELECT count(*) FROM vehicles WHERE status = 'AUTHORIZED') AS authorized,
  (SELECT count(*) FROM vehicles WHERE status = 'BLACKLISTED') AS blacklisted,
  (SELECT count(*) FROM unknown_detections WHERE detected_at::DATE = {D}) AS unknown_today,
  (SELECT count(*) FROM logs WHERE entry_time::DATE = {D}) AS entries_today,
  (SELECT round(coalesce(avg((epoch_us(exit_time) - epoch_us(entry_time)) / 6e7), 0.0), 6) FROM logs WHERE exit_time IS NOT NULL AND entry_time::DATE = {D}) AS average_parking_minutes_today,
  (SELECT count(*) FROM logs WHERE exit_time IS NULL AND status = 'AUTHORIZED') AS currently_inside"""
for _key in ("agg_stats_snapshot", "q_stats_snapshot"):
    access(_key, STATS)(lambda t: S.stats_snapshot(t.logs, t.unknown, t.vehicles, DAY).withColumn(
        "average_parking_minutes_today", F.round("average_parking_minutes_today", 6)))
LATE_TOP = """SELECT e.full_name AS name, e.plate_number, e.department, count(*) AS late_count FROM access_logs l
  LEFT JOIN employees e ON e.plate_number = l.plate_number WHERE l.status = 'authorized' AND l.access_time::TIME > TIME '09:00:00'
  GROUP BY ALL ORDER BY late_count DESC, plate_number NULLS FIRST LIMIT 10"""
for _key in ("agg_late_arrivals", "q_access_late_top"):
    access(_key, LATE_TOP)(lambda t: Q.access_late_top(t.access_logs, t.employees))
EVER = """SELECT e.full_name AS name, l.plate_number, max(l.access_time) AS last_access, e.department FROM access_logs l
  LEFT JOIN employees e ON e.plate_number = l.plate_number GROUP BY l.plate_number, e.full_name, e.department
  HAVING max(CASE WHEN l.status = 'authorized' THEN 1 ELSE 0 END) = 1"""
for _key in ("agg_currently_present_having", "q_access_currently_having"):
    access(_key, EVER)(lambda t: Q.access_ever_authorised(t.access_logs, t.employees))
access("agg_distinct_departments", "SELECT DISTINCT department FROM employees WHERE department IS NOT NULL")(
    lambda t: t.employees.filter("department IS NOT NULL").select("department").distinct())
DEPT = f"""SELECT DISTINCT e.full_name AS employee_name, e.department, p.plate_number, p.entry_time FROM logs p
  JOIN employees e USING (plate_number) WHERE p.entry_time::DATE = {D} AND e.department = 'BUILDING'"""
for _key in ("agg_dept_present_distinct", "q_department_present"):
    access(_key, DEPT)(lambda t: Q.department_present(t.logs_between(DAY, DAY), t.employees, DAY, "BUILDING"))

# -- reports -----------------------------------------------------------------------------------------


def period_views(a: str, b: str) -> list[str]:
    """Sub-queries of one report; the kept entries come from a recursive walk."""
    return [DIRECTORY, f"""
plog AS (SELECT * FROM logs WHERE entry_time >= DATE '{a}' AND entry_time < DATE '{b}' + INTERVAL 1 DAY),
kept(plate_number, entry_time) AS (
  SELECT plate_number, min(entry_time) FROM plog GROUP BY 1
  UNION ALL
  SELECT l.plate_number, min(l.entry_time) FROM kept k JOIN plog l ON l.plate_number = k.plate_number
    AND l.entry_time > k.entry_time + INTERVAL 5 MINUTE GROUP BY l.plate_number, k.entry_time),
marked AS (
  SELECT p.*, k.plate_number IS NULL AS is_duplicate, d.plate_number IS NULL AS is_unknown
  FROM plog p LEFT JOIN (SELECT DISTINCT * FROM kept) k ON k.plate_number = p.plate_number AND k.entry_time = p.entry_time
  LEFT JOIN directory d ON d.plate_number = p.plate_number),
flagged AS (
  SELECT 'unknown_plates' AS kind, * FROM marked WHERE is_unknown
  UNION ALL SELECT 'blacklisted', * FROM marked WHERE status = 'BLACKLISTED'
  UNION ALL SELECT 'duplicates', * FROM marked WHERE is_duplicate
  UNION ALL SELECT 'entry_without_exit', * FROM marked WHERE NOT is_duplicate AND exit_time IS NULL
  UNION ALL SELECT 'incoherent', * FROM marked WHERE NOT is_duplicate AND exit_time < entry_time),
anomalies AS (
  SELECT kind, id, plate_number, entry_time, exit_time, status, NULL::TIMESTAMP AS detected_at FROM flagged
  UNION ALL SELECT 'unknown_plates', id, plate_number, NULL, NULL, NULL, detected_at FROM unknown_detections
  WHERE detected_at >= DATE '{a}' AND detected_at < DATE '{b}' + INTERVAL 1 DAY),
labels AS (
  SELECT plate_number, entry_time::DATE AS day,
    CASE kind WHEN 'unknown_plates' THEN 'unknown' WHEN 'duplicates' THEN 'duplicate' ELSE kind END AS label,
    count(*) AS n, min(entry_time) AS first_at FROM flagged GROUP BY 1, 2, 3),
daily AS (
  SELECT plate_number, entry_time::DATE AS day, min(entry_time) AS first_entry,
    max(exit_time) FILTER (exit_time >= entry_time) AS last_exit,
    coalesce(sum((epoch_us(exit_time) - epoch_us(entry_time)) / 6e7) FILTER (exit_time >= entry_time), 0.0) AS total_minutes,
    bool_or(exit_time IS NULL) AS incomplete, min(entry_time)::TIME > TIME '09:15:00' AS late
  FROM marked WHERE NOT is_duplicate GROUP BY 1, 2),
judged AS (
  SELECT d.*, CASE WHEN incomplete THEN 'incomplete' WHEN l.txt IS NOT NULL THEN 'anomalie' WHEN late THEN 'late' ELSE 'present' END AS status,
    l.txt FROM daily d LEFT JOIN (
      SELECT plate_number, day, string_agg(label, ',' ORDER BY label) AS txt FROM (
        SELECT DISTINCT plate_number, day, label FROM labels
        UNION SELECT plate_number, day, 'incomplete' FROM daily WHERE incomplete) GROUP BY 1, 2) l USING (plate_number, day)),
people AS (
  SELECT d.full_name, d.plate_number, d.department, d.employee_code, d.is_active, coalesce(j.dp, 0) AS days_present,
    (DATE '{b}' - DATE '{a}' + 1) - coalesce(j.dp, 0) AS days_absent, coalesce(j.lc, 0) AS late_count,
    round(coalesce(j.m, 0.0), 2) AS total_minutes, CASE WHEN j.dp > 0 THEN round(j.m / j.dp, 2) ELSE 0.0 END AS avg_minutes,
    coalesce(j.ac, 0) AS anomalies_count,
    CASE WHEN NOT is_active THEN 'inactive' WHEN coalesce(j.ac, 0) > 0 THEN 'anomalie' WHEN coalesce(j.lc, 0) > 0 THEN 'retard'
      WHEN coalesce(j.dp, 0) > 0 THEN 'present' ELSE 'absent' END AS status, j.fa AS first_arrival, j.le AS last_exit
  FROM directory d LEFT JOIN (SELECT plate_number, count(*) AS dp, count(*) FILTER (late) AS lc, sum(total_minutes) AS m,
    count(*) FILTER (status IN ('incomplete', 'anomalie')) AS ac, min(first_entry) AS fa, max(last_exit) AS le
    FROM judged GROUP BY 1) j USING (plate_number))""".strip()]


JAN = ("2024-01-01", "2024-01-31")


def report(t: AccessTables, a: date, b: date) -> PresenceReport:
    return PresenceReport(t.logs_between(a, b), t.unknown_between(a, b), t.employees, t.vehicles, a, b)


def january(t: AccessTables) -> PresenceReport:
    return report(t, date(2024, 1, 1), date(2024, 1, 31))


SUMMARY = """SELECT (SELECT count(*) FROM people) AS total_employees, (SELECT count(*) FROM people WHERE days_present > 0) AS employees_present,
  (SELECT count(*) FROM people WHERE days_present <= 0) AS employees_absent, (SELECT sum(days_present)::BIGINT FROM people) AS total_presences,
  (SELECT sum(late_count)::BIGINT FROM people) AS total_late, (SELECT round(sum(total_minutes), 2) FROM people) AS total_presence_minutes,
  (SELECT CASE WHEN sum(days_present) > 0 THEN round(sum(total_minutes) / sum(days_present), 2) ELSE 0.0 END FROM people) AS avg_presence_minutes,
  (SELECT min(first_arrival) FROM people) AS first_arrival,
  (SELECT full_name FROM people WHERE first_arrival IS NOT NULL ORDER BY first_arrival, lower(full_name), plate_number LIMIT 1) AS first_arrival_name,
  (SELECT max(last_exit) FROM people) AS last_exit,
  (SELECT full_name FROM people WHERE last_exit IS NOT NULL ORDER BY last_exit DESC, lower(full_name), plate_number LIMIT 1) AS last_exit_name,
  (SELECT count(*) FROM anomalies) AS total_anomalies"""
access("win_anchor_dedup", "SELECT id, plate_number, entry_time FROM marked WHERE is_duplicate", *period_views(*JAN))(
    lambda t: january(t).marked.filter("is_duplicate").select("id", "plate_number", "entry_time"))
DAILY = "SELECT plate_number, day, first_entry, last_exit, round(total_minutes, 4) AS total_minutes, incomplete, late FROM daily"
access("agg_daily_presence", DAILY, *period_views(*JAN))(
    lambda t: january(t).daily().withColumn("total_minutes", F.round("total_minutes", 4)))
access("agg_employee_days", """SELECT d.full_name, d.plate_number, c.day, j.first_entry, j.last_exit, round(coalesce(j.total_minutes, 0.0), 4) AS total_minutes,
  coalesce(j.late, false) AS late, coalesce(j.status, 'absent') AS status, coalesce(j.txt, '') AS anomalies
  FROM directory d CROSS JOIN (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day) c
  LEFT JOIN judged j ON j.plate_number = d.plate_number AND j.day = c.day""", *period_views(*JAN))(
    lambda t: january(t).employee_days().withColumn("total_minutes", F.round("total_minutes", 4)))
access("agg_employee_period", "SELECT * FROM people", *period_views(*JAN))(lambda t: january(t).employee_period())
access("agg_report_summary", SUMMARY, *period_views(*JAN))(lambda t: january(t).summary())
access("agg_anomaly_counts", "SELECT kind, count(*) AS n FROM anomalies GROUP BY 1", *period_views(*JAN))(
    lambda t: january(t).anomaly_counts())
DAY_LABELS = """SELECT plate_number, entry_time::DATE AS day,
  list(CASE kind WHEN 'unknown_plates' THEN 'unknown' WHEN 'duplicates' THEN 'duplicate' ELSE kind END ORDER BY entry_time, id,
    list_position(['unknown_plates', 'blacklisted', 'duplicates', 'entry_without_exit', 'incoherent'], kind)) AS labels
FROM flagged GROUP BY 1, 2"""
access("agg_day_anomaly_labels", DAY_LABELS, *period_views(*JAN))(lambda t: january(t).day_label_lists())
ANOMALIES = "SELECT * FROM anomalies"
for _key in ("set_anomalies", "q_report_anomalies"):
    access(_key, ANOMALIES, *period_views(*JAN))(lambda t: january(t).anomalies())
ACCESSES = """SELECT m.id, d.full_name AS employee_name, m.plate_number, m.entry_time, m.exit_time, m.status FROM marked m
  LEFT JOIN directory d USING (plate_number) WHERE NOT is_duplicate"""
for _key in ("ord_accesses_desc", "q_report_accesses"):
    access(_key, ACCESSES, *period_views(*JAN))(lambda t: january(t).accesses())
for _kind, _given, _a, _b in [
    ("daily", dict(date=DAY), "2024-01-15", "2024-01-15"),
    ("weekly", dict(year=2024, week=3), "2024-01-15", "2024-01-21"),
    ("monthly", dict(year=2024, month=1), *JAN),
    ("yearly", dict(year=2024), "2024-01-01", "2024-12-31"),
    ("custom", dict(start_date=date(2024, 1, 10), end_date=date(2024, 1, 20)), "2024-01-10", "2024-01-20"),
]:
    access(f"q_report_{_kind}", "SELECT * FROM people", *period_views(_a, _b))(
        lambda t, k=_kind, g=_given: report(t, *report_period(k, **g)).employee_period())

# Report requests derived from orders: one per row, kind by priority.
REQUESTS = """SELECT o_orderkey AS request_id, kind AS report_type, a AS period_start, b AS period_end FROM (
  SELECT o_orderkey, o_orderdate::DATE AS d, substr(o_orderpriority, 1, 1) AS p FROM orders) o, LATERAL (SELECT
    CASE p WHEN '1' THEN 'daily' WHEN '2' THEN 'weekly' WHEN '3' THEN 'monthly' WHEN '4' THEN 'yearly' ELSE 'custom' END AS kind,
    CASE p WHEN '1' THEN d WHEN '2' THEN date_trunc('week', d)::DATE WHEN '3' THEN date_trunc('month', d)::DATE WHEN '4' THEN date_trunc('year', d)::DATE ELSE d END AS a,
    CASE p WHEN '1' THEN d WHEN '2' THEN (date_trunc('week', d) + INTERVAL 6 DAY)::DATE WHEN '3' THEN last_day(d)
      WHEN '4' THEN make_date(year(d), 12, 31) ELSE d + 9 END AS b)"""


@query("fn_report_period", REQUESTS)
def _requests(spark, folder):
    day, p = F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    kind = F.when(p == "1", "daily").when(p == "2", "weekly").when(p == "3", "monthly").when(p == "4", "yearly").otherwise("custom")
    iso_year = F.year(F.date_add(F.date_trunc("week", day).cast("date"), 3))
    rows = AccessTables(spark, folder).read("orders").select(
        F.col("o_orderkey").alias("request_id"), kind.alias("report_type"), day.alias("date"),
        F.when(kind == "weekly", iso_year).otherwise(F.year(day)).alias("year"),
        F.month(day).alias("month"), F.weekofyear(day).alias("week"),
        F.when(kind == "custom", day).alias("start_date"), F.when(kind == "custom", F.date_add(day, 9)).alias("end_date"),
    )
    return request_periods(rows).select("request_id", "report_type", "period_start", "period_end")


OVERVIEW = f"""
act AS (SELECT * FROM employees WHERE is_active),
m AS (SELECT p.*, a.full_name AS employee_name, a.department FROM logs p JOIN act a USING (plate_number) WHERE p.entry_time::DATE = {D}),
acc AS (SELECT id, plate_number, entry_time, exit_time, CASE WHEN status IN ('UNKNOWN','BLACKLISTED') THEN 'AUTHORIZED' ELSE status END AS status, employee_name, department
  FROM m QUALIFY status NOT IN ('UNKNOWN','BLACKLISTED') OR row_number() OVER (PARTITION BY plate_number, status IN ('UNKNOWN','BLACKLISTED') ORDER BY entry_time DESC, id DESC) = 1),
fe AS (SELECT plate_number AS canonical, min(entry_time) AS first_entry, min(entry_time)::TIME > TIME '09:15:00' AS late FROM acc GROUP BY 1),
uo AS (SELECT * FROM unknown_detections WHERE detected_at::DATE = {D} AND plate_number NOT IN (SELECT plate_number FROM act))""".strip()
OV_SUM = """SELECT (SELECT count(*) FROM act) AS total_employees, (SELECT count(*) FROM fe) AS employees_present,
  (SELECT count(*) FROM act) - (SELECT count(*) FROM fe) AS employees_absent, (SELECT count(*) FROM fe WHERE late) AS total_late,
  (SELECT count(*) FROM uo) AS unknown_plates"""
for _key in ("agg_dashboard_summary", "q_presence_overview"):
    access(_key, OV_SUM, OVERVIEW)(lambda t: S.PresenceOverview(t.logs_between(DAY, DAY), t.unknown_between(DAY, DAY), t.employees, DAY).summary())
access("win_legacy_keep_latest", "SELECT * FROM acc", OVERVIEW)(
    lambda t: S.PresenceOverview(t.logs_between(DAY, DAY), t.unknown_between(DAY, DAY), t.employees, DAY).accesses().select(
        "id", "plate_number", "entry_time", "exit_time", "status", "employee_name", "department"))
access("win_first_entry_late", "SELECT * FROM fe", OVERVIEW)(
    lambda t: S.PresenceOverview(t.logs_between(DAY, DAY), t.unknown_between(DAY, DAY), t.employees, DAY).first_entries())

# -- ordered operators -------------------------------------------------------------------------------
access("win_pair_sessions", "SELECT * FROM logs")(lambda t: sessions.pair_sessions(materialize(t.detections, "detections")))
access("win_latest_open", """SELECT id, plate_number, entry_time, status FROM logs WHERE exit_time IS NULL
  QUALIFY row_number() OVER (PARTITION BY plate_number ORDER BY entry_time DESC, id DESC) = 1""")(
    lambda t: sessions.latest_open(t.logs).select("id", "plate_number", "entry_time", "status"))
SCANS = """chains AS (SELECT plate_number, sum(fresh) OVER (PARTITION BY plate_number ORDER BY entry_time, id) AS chain FROM (
    SELECT *, CASE WHEN entry_time - lag(entry_time) OVER (PARTITION BY plate_number ORDER BY entry_time, id) <= INTERVAL {m} MINUTE THEN 0 ELSE 1 END AS fresh
    FROM logs {where}))"""
SCAN_TOP = """SELECT plate_number, max(n) AS count FROM (SELECT plate_number, chain, count(*) AS n FROM chains GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 2"""
access("win_multi_scans", SCAN_TOP, SCANS.format(m=60, where=""))(lambda t: sessions.multi_scans(t.logs, 60))
access("ord_chain_desc", SCAN_TOP + " ORDER BY 2 DESC, 1", SCANS.format(m=240, where=""))(
    lambda t: sessions.multi_scans(t.logs, 240).orderBy(F.desc("count"), "plate_number"))
access("q_multi_scans", SCAN_TOP, SCANS.format(m=5, where=f"WHERE entry_time::DATE = {D}"))(
    lambda t: sessions.multi_scans(t.logs_between(DAY, DAY), 5))
access("win_manual_open", """SELECT l.id, l.plate_number, l.status, c.a AS entry_time, c.b AS exit_time, true AS manual_opened, c.b IS NOT NULL AS manual_exit_opened
  FROM logs l JOIN (SELECT plate_number, min(ts) FILTER (rn = 1) AS a, min(ts) FILTER (rn = 2) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY plate_number ORDER BY ts) AS rn FROM cmd) GROUP BY 1) c USING (plate_number)
  WHERE l.exit_time IS NULL AND l.status IN ('UNKNOWN', 'BLACKLISTED')""",
       f"cmd AS (SELECT {PLATE.format(k='user_id')} AS plate_number, ts FROM events WHERE event_type = 'signup')")(
    lambda t: S.manual_open(t.logs, t.read("events").filter("event_type = 'signup'").select(
        plate_of(F.col("user_id")).alias("plate_number"), F.col("ts").alias("opened_at"))))
access("win_close_session", """SELECT c.plate_number, c.exit_time, l.id IS NOT NULL AS closed, l.id AS log_id, c.n - (l.id IS NOT NULL)::INT AS not_found
  FROM (SELECT plate_number, min(ts) AS exit_time, count(*) AS n FROM cmd GROUP BY 1) c
  LEFT JOIN (SELECT * FROM logs WHERE exit_time IS NULL) l USING (plate_number)""",
       f"cmd AS (SELECT {PLATE.format(k='user_id')} AS plate_number, ts FROM events WHERE event_type = 'purchase')")(
    lambda t: S.close_sessions(t.logs, t.read("events").filter("event_type = 'purchase'").select(
        plate_of(F.col("user_id")).alias("plate_number"), F.col("ts").alias("exit_time"))))
access("win_change_signature", """SELECT id || '|' || strftime(entry_time, '%Y-%m-%dT%H:%M:%S.%f') || '|' || coalesce(strftime(exit_time, '%Y-%m-%dT%H:%M:%S.%f'), '') AS signature
  FROM logs ORDER BY entry_time DESC, id DESC LIMIT 1""")(lambda t: S.log_signature(t.logs))

# -- orders, sets ------------------------------------------------------------------------------------
LAST10 = HEAD + "ORDER BY p.entry_time DESC, p.id LIMIT 10"
for _key in ("ord_last_n", "q_last_access"):
    access(_key, LAST10)(lambda t: Q.last_access(t.logs, t.employees, t.vehicles, 10))
LAST1 = HEAD + f"WHERE p.plate_number = '{PLATE_8}' ORDER BY p.entry_time DESC, p.id LIMIT 1"
for _key in ("ord_last_entry", "q_plate_last_entry"):
    access(_key, LAST1)(lambda t: Q.plate_last_entry(t.logs, t.employees, t.vehicles, PLATE_8))
access("ord_blacklisted_recent", "SELECT * FROM vehicles WHERE status = 'BLACKLISTED' ORDER BY coalesce(blacklisted_at, created_at) DESC, id LIMIT 50")(
    lambda t: S.blacklisted_recent(t.vehicles, 50))
access("ord_directory", "SELECT * FROM directory ORDER BY lower(coalesce(full_name, '')), plate_number", DIRECTORY)(
    lambda t: J.directory(t.employees, t.vehicles).orderBy(F.lower(F.coalesce("full_name", F.lit(""))), "plate_number"))
access("set_union_plates", "SELECT plate_number FROM employees UNION SELECT plate_number FROM vehicles")(
    lambda t: J.all_plates(t.employees, t.vehicles))
ALERTS = """(SELECT 'blacklisted' AS kind, plate_number, coalesce(blacklisted_at, created_at) AS seen_at FROM vehicles WHERE status = 'BLACKLISTED' ORDER BY seen_at DESC, id LIMIT 50)
  UNION ALL (SELECT 'unknown', plate_number, detected_at FROM unknown_detections ORDER BY detected_at DESC, id LIMIT 50)"""
for _key in ("set_alerts", "q_alerts"):
    access(_key, ALERTS)(lambda t: S.alerts(t.vehicles, t.unknown, 50))

# -- questions ---------------------------------------------------------------------------------------
access("q_plate_history", HEAD + f"WHERE p.plate_number = '{PLATE_8}' AND p.entry_time::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")(
    lambda t: Q.plate_history(
        t.logs_between(date(2024, 1, 5), date(2024, 1, 25)), t.employees, t.vehicles, PLATE_8, span=(date(2024, 1, 5), date(2024, 1, 25))))
PRESENT = HEAD + f"WHERE p.entry_time::DATE = {D} AND p.status = 'AUTHORIZED'"
access("q_present_on", PRESENT)(lambda t: Q.present_on(t.logs_between(DAY, DAY), t.employees, t.vehicles, DAY))
access("q_currently_present", HEAD + "WHERE p.entry_time::DATE = DATE '2024-01-29' AND p.status = 'AUTHORIZED' AND p.exit_time IS NULL")(
    lambda t: Q.present_on(t.logs_between(date(2024, 1, 29), date(2024, 1, 29)), t.employees, t.vehicles, date(2024, 1, 29), currently=True))
access("q_absent_on", f"""SELECT full_name, department, plate_number FROM employees e WHERE is_active
  AND plate_number NOT IN (SELECT plate_number FROM logs WHERE entry_time::DATE = {D})""")(
    lambda t: Q.absent_on(t.logs_between(DAY, DAY), t.employees, DAY))
access("q_late_on", f"""SELECT p.id, e.full_name AS employee_name, e.department, p.plate_number, p.entry_time FROM logs p
  LEFT JOIN employees e USING (plate_number) WHERE p.entry_time::DATE = {D} AND p.status = 'AUTHORIZED' AND p.entry_time::TIME > TIME '09:15:00'""")(
    lambda t: Q.late_on(t.logs_between(DAY, DAY), t.employees, DAY))
access("q_access_between_times", HEAD + f"WHERE p.entry_time::DATE = {D} AND p.entry_time::TIME BETWEEN TIME '08:00:00' AND TIME '11:00:00'")(
    lambda t: Q.access_between_times(t.logs_between(DAY, DAY), t.employees, t.vehicles, DAY, "08:00:00", "11:00:00"))
access("q_access_at_time", HEAD + f"WHERE p.entry_time::DATE = {D} AND p.entry_time::TIME = TIME '08:30:00'")(
    lambda t: Q.access_at_time(t.logs_between(DAY, DAY), t.employees, t.vehicles, DAY, "08:30:00"))
access("q_denied_on", SHORT + "WHERE p.entry_time::DATE = DATE '2024-01-13' AND p.status IN ('BLACKLISTED', 'DENIED')")(
    lambda t: Q.denied_on(t.logs_between(date(2024, 1, 13), date(2024, 1, 13)), t.employees, t.vehicles, date(2024, 1, 13)))
access("q_denied_count", "SELECT count(*) AS denied_count FROM logs WHERE entry_time::DATE = DATE '2024-01-13' AND status IN ('BLACKLISTED', 'DENIED')")(
    lambda t: Q.denied_count(t.logs_between(date(2024, 1, 13), date(2024, 1, 13)), date(2024, 1, 13)))
access("q_unknown_on", f"SELECT id, plate_number, detected_at, image_path FROM unknown_detections WHERE detected_at::DATE = {D}")(
    lambda t: Q.unknown_on(t.unknown, DAY))
access("q_entry_without_exit", SHORT + "WHERE p.exit_time IS NULL")(
    lambda t: Q.entry_without_exit(t.logs, t.employees, t.vehicles))
access("q_most_detected", MOST.format(a=D, b="DATE '2024-01-21'"))(lambda t: Q.most_detected(t.logs_between(*Q.week_of(DAY)), *Q.week_of(DAY)))
access("q_top_presence", TOP.format(a=D, b="DATE '2024-01-21'"))(lambda t: _top(t, *Q.week_of(DAY)))
access("q_employee_history", f"""SELECT p.id, p.plate_number, p.entry_time, p.exit_time, p.status, e.full_name AS employee_name, e.department
  FROM logs p JOIN employees e USING (plate_number) WHERE lower(e.full_name) = lower('{NAME_8}')""")(
    lambda t: Q.employee_history(t.logs, t.employees, NAME_8))
access("q_employee_info", f"SELECT full_name, department, plate_number, employee_code, is_active FROM employees WHERE lower(full_name) = lower('{NAME_8}')")(
    lambda t: Q.employee_info(t.employees, NAME_8))
access("q_plate_owner", f"SELECT owner_name, vehicle_type, plate_number, status FROM vehicles WHERE plate_number = '{PLATE_8}'")(
    lambda t: Q.plate_owner(t.vehicles, PLATE_8))
access("q_plate_status", f"SELECT plate_number, status, owner_name, vehicle_type FROM vehicles WHERE plate_number = '{PLATE_8}'")(
    lambda t: Q.plate_status(t.vehicles, PLATE_8))
ACC = "FROM access_logs l LEFT JOIN employees e ON e.plate_number = l.plate_number "
ACC5 = "SELECT l.plate_number, l.access_time, l.status, e.full_name AS name, e.department " + ACC
ACC4 = ACC5.replace(" l.status,", "")
access("q_access_last10", ACC5 + "ORDER BY l.access_time DESC, l.plate_number LIMIT 10")(
    lambda t: Q.access_last(t.access_logs, t.employees))
access("q_access_denied", ACC5 + "WHERE l.status = 'denied' ORDER BY l.access_time DESC, l.plate_number LIMIT 20")(
    lambda t: Q.access_denied(t.access_logs, t.employees))
access("q_access_entered_today", ACC4 + f"WHERE l.access_time::DATE = {D} AND l.status = 'authorized'")(
    lambda t: Q.access_entered(t.accesses_between(DAY, DAY), t.employees, DAY))
access("q_access_since_time", ACC4 + "WHERE l.access_time >= TIMESTAMP '2024-01-15 08:30:00' AND l.status = 'authorized'")(
    lambda t: Q.access_since(t.accesses_between(DAY, None), t.employees, datetime(2024, 1, 15, 8, 30)))
access("q_access_present", ACC5 + """JOIN (SELECT plate_number, max(access_time) AS m FROM access_logs GROUP BY 1) x
  ON x.plate_number = l.plate_number AND x.m = l.access_time WHERE l.access_time::DATE = DATE '2024-01-29' AND l.status = 'authorized'""")(
    lambda t: Q.access_present(t.access_logs, t.employees, date(2024, 1, 29)))
access("q_access_authorised_list", "SELECT full_name AS name, plate_number, department FROM employees")(
    lambda t: Q.access_authorised_list(t.employees))

# -- decisions ---------------------------------------------------------------------------------------
access("dec_evaluate", """SELECT d.event_id, d.detected_at,
  CASE WHEN d.plate_number = '' THEN 'NO_PLATE' ELSE coalesce(v.status, 'UNKNOWN') END AS status,
  CASE WHEN d.plate_number = '' THEN 'No plate detected' WHEN v.status = 'AUTHORIZED' THEN 'Gate Opened' WHEN v.status = 'BLACKLISTED' THEN 'SECURITY ALERT' ELSE 'Capture stored' END AS action,
  CASE WHEN v.status = 'AUTHORIZED' THEN 'OPEN' ELSE 'CLOSED' END AS gate, v.owner_name, v.vehicle_type,
  CASE WHEN v.status = 'BLACKLISTED' THEN coalesce(v.blacklist_reason, 'Suspicious vehicle') END AS reason,
  v.plate_number AS matched_plate, d.plate_number FROM det d LEFT JOIN vehicles v ON v.plate_number = d.plate_number""")(
    lambda t: S.evaluate(t.raw_detections, t.vehicles))
access("dec_no_plate", "SELECT * FROM logs WHERE status = 'NO_PLATE'")(lambda t: sessions.no_plate_logs(t.detections))

# -- plate functions over every detection text ---------------------------------------------------------
access("fn_normalize_plate", "SELECT event_id, plate_number FROM det")(
    lambda t: t.raw_detections.select("event_id", P.normalize_plate(F.col("plate_text")).alias("plate_number")))
access("fn_plate_loose_key", """SELECT event_id, CASE WHEN plate_number = '' THEN '' ELSE split_part(plate_number, '-', 1) || '-*-' || split_part(plate_number, '-', 3) END AS loose_key FROM det""")(
    lambda t: t.raw_detections.select("event_id", P.loose_key(F.col("plate_text")).alias("loose_key")))
access("fn_plate_reorder", """SELECT event_id, plate_number AS reordered FROM det WHERE plate_number <> ''""")(
    lambda t: t.detections.filter("plate_number <> ''").select("event_id", P.reorder_plate(
        F.regexp_replace("plate_number", "^([0-9]+)-([A-Z])-([0-9]+)$", "$1-$3-$2")).alias("reordered")))
access("fn_plate_display", """SELECT event_id, chr(8294) || split_part(plate_number, '-', 1) || chr(8297) || ' - ' || chr(8295) || split_part(plate_number, '-', 2) || chr(8297)
  || ' - ' || chr(8294) || split_part(plate_number, '-', 3) || chr(8297) AS shown FROM det WHERE plate_number <> ''""")(
    lambda t: t.detections.filter("plate_number <> ''").select("event_id", P.display_plate(F.col("plate_number")).alias("shown")))
access("fn_plate_query_key", """SELECT event_id, lower(replace(plate_number, '-', '')) AS query_key FROM det""")(
    lambda t: t.detections.select("event_id", P.plate_query_key(F.col("plate_number")).alias("query_key")))
access("fn_plate_vote_key", """SELECT event_id, CASE WHEN value < 1 THEN '' ELSE %s END AS vote_key FROM events WHERE event_type <> 'signup'"""
       % PLATE.format(k="user_id"))(
    lambda t: t.read("events").filter("event_type <> 'signup'").select("event_id").join(t.raw_detections, "event_id").select(
        "event_id", P.plate_vote_key(F.col("plate_text")).alias("vote_key")))
access("fn_score_plate", """SELECT event_id, CASE WHEN plate_number = '' THEN 0.0 ELSE round(0.6 * least(length(replace(plate_number, '-', '')) / 7.0, 1.0) + 0.4, 6) END::DOUBLE AS score FROM det""")(
    lambda t: t.raw_detections.select("event_id", F.round(P.score_plate(F.col("plate_text")), 6).alias("score")))
access("fn_arabic_to_placeholder", """SELECT event_id, regexp_replace(plate_number, '[A-Z]', '?') AS masked FROM det""")(
    lambda t: t.detections.select("event_id", P.arabic_placeholder(
        F.regexp_replace("plate_number", "[A-Z]", "و")).alias("masked")))
access("fn_extract_plate", """SELECT event_id, CASE WHEN plate_number <> '' THEN plate_number END AS plate FROM det""")(
    lambda t: t.raw_detections.select("event_id", F.nullif(P.normalize_plate(P.extract_plate(
        F.concat(F.lit("Historique de la plaque "), "plate_text", F.lit(" ?")))), F.lit("")).alias("plate")))
access("fn_late_cutoff", """SELECT l_id AS id, strftime(TIMESTAMP '2000-01-01' + to_minutes((540 + l_id % 30)::INT), '%H:%M:%S') AS cutoff FROM (SELECT event_id AS l_id FROM events)""")(
    lambda t: t.read("events").select(F.col("event_id").alias("id"), F.date_format(
        F.lit("2000-01-01").cast("timestamp_ntz") + F.make_interval(mins=(F.lit(K.DAY_START_MINUTES) + F.col("event_id") % 30).cast("int")), "HH:mm:ss").alias("cutoff")))
access("fn_duration_minutes", "SELECT id, round((epoch_us(coalesce(exit_time, TIMESTAMP '2024-01-31 18:00:00')) - epoch_us(entry_time)) / 6e7, 6) AS minutes FROM logs")(
    lambda t: t.logs.select("id", F.round(Q.seconds_between(F.col("entry_time"), F.coalesce(
        "exit_time", F.lit(str(AS_OF)).cast("timestamp_ntz"))) / 60, 6).alias("minutes")))
