"""Lookups of plates, people and names.

No join carries a broadcast hint: the registry tables grow with the fleet, so Spark decides from
their size (``spark.sql.autoBroadcastJoinThreshold`` and adaptive execution) and falls back to a
shuffled join with skew splitting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone.constants import AUTHORIZED
from turnstone.functions.plates import loose_key, normalize_plate


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def merge_scalars(*frames: DataFrame) -> DataFrame:
    """One row out of several one-row frames, without a cross join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def enrich(logs: DataFrame, employees: DataFrame, vehicles: DataFrame | None = None) -> DataFrame:
    """Logs with the employee and vehicle of the same plate."""
    people = employees.select(
        "plate_number", F.col("full_name").alias("employee_name"), "department"
    )
    out = logs.join(people, "plate_number", "left")
    if vehicles is not None:
        out = out.join(vehicles.select("plate_number", "owner_name", "vehicle_type"), "plate_number", "left")
    return out


def directory(employees: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Employees merged with authorised vehicles by plate; employee values win, blanks filled."""
    left = employees.filter("plate_number <> ''").select(
        "plate_number", "full_name", "department", "employee_code", "is_active",
        F.lit(True).alias("is_employee"),
    )
    right = vehicles.filter((F.col("status") == AUTHORIZED) & (F.col("plate_number") != "")).select(
        "plate_number", "owner_name", "vehicle_type"
    )
    return left.join(right, "plate_number", "full_outer").select(
        "plate_number",
        F.coalesce(blank_to_null(F.col("full_name")), "owner_name").alias("full_name"),
        F.coalesce(blank_to_null(F.col("department")), "vehicle_type").alias("department"),
        "employee_code",
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )


def active_directory(employees: DataFrame) -> DataFrame:
    return employees.filter(F.col("is_active") & (F.col("plate_number") != "")).select(
        "plate_number", "full_name", "department"
    )


def plate_probes(df: DataFrame, plate: str = "plate_number") -> DataFrame:
    """One row per distinct plate and tier: 0 exact, 1 normalised, 2 loose."""
    col = F.col(plate)
    keys = F.array(
        F.struct(F.lit(0).alias("tier"), col.alias("probe")),
        F.struct(F.lit(1).alias("tier"), normalize_plate(col).alias("probe")),
        F.struct(F.lit(2).alias("tier"), loose_key(col).alias("probe")),
    )
    distinct = df.select(plate).filter(col != "").distinct()
    return distinct.select(plate, F.explode(keys).alias("k")).select(
        plate, "k.tier", "k.probe"
    ).filter("probe <> ''")


def match_plates(
    plates: DataFrame, people: DataFrame, order: list[str], one_index: bool = False
) -> DataFrame:
    """Best person per plate: exact key, then normalised, then loose; first registered per key.

    ``people`` needs ``plate_number``; ``order`` names the registration order. Exact and normalised
    keys share one index and the loose key has its own, unless ``one_index``.
    """
    own_loose = F.lit(not one_index)
    rank = F.struct(*order, "plate_number")
    own = people.select("*", F.explode(F.array(
        F.struct(F.lit(False).alias("loose"), F.col("plate_number").alias("probe")),
        F.struct(F.lit(False).alias("loose"), normalize_plate(F.col("plate_number")).alias("probe")),
        F.struct(own_loose.alias("loose"), loose_key(F.col("plate_number")).alias("probe")),
    )).alias("k"))
    index = own.filter("k.probe <> ''").groupBy("k.loose", "k.probe").agg(
        F.min(rank).getField("plate_number").alias("matched_plate")
    )
    probes = plate_probes(plates).withColumn("loose", (F.col("tier") == 2) & own_loose)
    hits = probes.join(index, ["loose", "probe"])
    return hits.groupBy("plate_number").agg(F.min_by("matched_plate", "tier").alias("matched_plate"))


def known_plates(plates: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct plates that share any of the three keys with any person."""
    keys = plate_probes(people).select("probe").distinct()
    return plate_probes(plates).join(keys, "probe", "left_semi").select("plate_number").distinct()


def lookup_vehicle(plates: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Registered vehicle per plate: exact text, exact normalised, then first by id on either key."""
    probes = plate_probes(plates)
    exact = probes.filter("tier < 2").join(
        vehicles.select(F.col("plate_number").alias("probe"), "id"), "probe"
    ).select("plate_number", "tier", "id")
    derived = vehicles.select(F.col("plate_number").alias("v_plate"), "id").select("id", F.explode(F.array(
        F.struct(F.lit(1).alias("tier"), normalize_plate(F.col("v_plate")).alias("probe")),
        F.struct(F.lit(2).alias("tier"), loose_key(F.col("v_plate")).alias("probe")),
    )).alias("k")).select("id", "k.tier", "k.probe")
    derived = derived.groupBy("tier", "probe").agg(F.min("id").alias("id"))
    scan = probes.join(derived, ["tier", "probe"]).select("plate_number", F.lit(2).alias("tier"), "id")
    best = exact.unionByName(scan).groupBy("plate_number").agg(
        F.min(F.struct("tier", "id")).getField("id").alias("id")
    )
    found = vehicles.select(
        "id", F.col("plate_number").alias("matched_plate"), "owner_name", "vehicle_type",
        F.col("status").alias("vehicle_status"), "blacklist_reason",
    )
    return best.join(found, "id").drop("id")


def attach_names(rows: DataFrame, employees: DataFrame) -> DataFrame:
    """Fills a missing ``employee_name`` by normalised plate; the last employee per key wins."""
    named = employees.filter("full_name <> '' AND plate_number <> ''")
    names = named.withColumn("_key", normalize_plate(F.col("plate_number"))).groupBy("_key").agg(
        F.max_by("full_name", "id").alias("_name")
    )
    keyed = rows.withColumn("_key", normalize_plate(F.col("plate_number")))
    return keyed.join(names, "_key", "left").withColumn(
        "employee_name", F.coalesce(blank_to_null(F.col("employee_name")), "_name")
    ).drop("_key", "_name")


def suggest_plates(targets: DataFrame, employees: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Registered plates that equal a target on the normalised or the loose key."""
    registered = all_plates(employees, vehicles).withColumnRenamed("plate_number", "suggestion")

    def keys(df: DataFrame, col: str) -> DataFrame:
        return df.select(col, F.explode(F.array(
            F.struct(F.lit(1).alias("tier"), normalize_plate(F.col(col)).alias("probe")),
            F.struct(F.lit(2).alias("tier"), loose_key(F.col(col)).alias("probe")),
        )).alias("k")).select(col, "k.tier", "k.probe")

    wanted = targets.select("plate_number").distinct()
    return keys(wanted, "plate_number").join(keys(registered, "suggestion"), ["tier", "probe"]).select(
        "plate_number", "suggestion"
    ).distinct()


def all_plates(employees: DataFrame, vehicles: DataFrame) -> DataFrame:
    return employees.select("plate_number").union(vehicles.select("plate_number")).distinct()


def latest_rows(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """All rows at the newest time of their key; ties stay. The maximum is pre-aggregated."""
    newest = rows.groupBy(key).agg(F.max(ts).alias(ts))
    return rows.join(newest, [key, ts], "left_semi")


def fill_names(rows: DataFrame, employees: DataFrame) -> DataFrame:
    """Employee name from the row, the owner, the registry, else ``Unknown``."""
    owner = F.col("owner_name") if "owner_name" in rows.columns else F.lit(None)
    rows = rows.withColumn("employee_name", F.coalesce(blank_to_null(F.col("employee_name")), owner))
    rows = attach_names(rows, employees)
    return rows.withColumn("employee_name", F.coalesce("employee_name", F.lit("Unknown"))).withColumn(
        "full_name", F.col("employee_name")
    )
