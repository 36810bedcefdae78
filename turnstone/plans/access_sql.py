"""DuckDB statements of the derived access tables, written independently of the Spark code."""

PLATE = (
    "printf('%05d', {k}) || '-' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast({k} % 26 + 1 as int), 1)"
    " || '-' || cast({k} % 9 + 1 as varchar)"
)
_P = PLATE.format(k="c_custkey")
_E = PLATE.format(k="user_id")

VIEWS = f"""
employees AS (
  SELECT c_custkey AS id, c_name AS full_name, {_P} AS plate_number, c_mktsegment AS department,
    'EMP-' || c_custkey AS employee_code, c_acctbal < 9000 AS is_active
  FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
vehicles AS (
  SELECT c_custkey AS id, {_P} AS plate_number, c_name AS owner_name, lower(c_mktsegment) AS vehicle_type,
    CASE WHEN c_acctbal < 0 THEN 'BLACKLISTED' ELSE 'AUTHORIZED' END AS status,
    CASE WHEN c_acctbal < -500 THEN 'unpaid' END AS blacklist_reason,
    CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-12' + to_minutes(cast(c_custkey % 1440 as int)) END AS blacklisted_at,
    TIMESTAMP '2023-06-01' + to_minutes(cast(c_custkey % 1440 as int)) AS created_at
  FROM customer WHERE c_acctbal < 9200),
det AS (
  SELECT event_id, CASE WHEN value < 1 THEN '' ELSE {_E} END AS plate_number, ts AS detected_at,
    'captures/' || event_id || '.jpg' AS image_path,
    CASE WHEN value < 1 THEN 'NO_PLATE' WHEN v.id IS NULL THEN 'UNKNOWN'
      WHEN v.status = 'BLACKLISTED' AND ts >= v.blacklisted_at THEN 'BLACKLISTED' ELSE 'AUTHORIZED' END AS status
  FROM events LEFT JOIN vehicles v ON v.id = user_id),
ranked AS (
  SELECT *, row_number() OVER w AS rn, lead(detected_at) OVER w AS nx,
    count(*) FILTER (status = 'AUTHORIZED') OVER (PARTITION BY plate_number) AS na
  FROM det WHERE plate_number <> ''
  WINDOW w AS (PARTITION BY plate_number ORDER BY detected_at, event_id)),
logs AS (
  SELECT event_id AS id, plate_number, detected_at AS entry_time, nx AS exit_time, status, image_path,
    true AS manual_opened, false AS manual_exit_opened
  FROM ranked WHERE status = 'AUTHORIZED' AND rn % 2 = 1
  UNION ALL
  SELECT event_id, plate_number, detected_at, NULL, status, image_path, false, false
  FROM ranked WHERE status <> 'AUTHORIZED' AND rn = na + 1 + na % 2
  UNION ALL
  SELECT event_id, 'NO_PLATE_' || strftime(detected_at, '%Y%m%d%H%M%S%f'), detected_at, NULL, 'NO_PLATE', image_path, false, false
  FROM det WHERE plate_number = ''),
unknown_detections AS (
  SELECT event_id AS id, plate_number, image_path, detected_at FROM det WHERE status = 'UNKNOWN'),
access_logs AS (
  SELECT plate_number, entry_time AS access_time,
    CASE WHEN status = 'AUTHORIZED' THEN 'authorized' ELSE 'denied' END AS status FROM logs)
"""


def sql(text: str, *more: str) -> str:
    """A statement over the derived tables; ``more`` are further named sub-queries."""
    return "WITH RECURSIVE " + ", ".join([VIEWS.strip(), *more]) + "\n" + text
