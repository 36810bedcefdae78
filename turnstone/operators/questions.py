"""French access questions as a table job: entities, intent, plate resolution, SQL audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstone.functions import dates as D
from turnstone.functions.plates import extract_plate, normalize_plate, reorder_plate
from turnstone.functions.text import norm_question
from turnstone.operators.joins import suggest_plates
from turnstone.operators.matching import contained_names
from turnstone.operators.shuffled import grown_join

# Trigger words of the model answer, status words, intent rules in order.
MODEL_TRIGGERS = ("pourquoi", "analyse", "statistique", "tendance", "le plus", "plus souvent", "souvent", "frequent", "frquent", "qui est le plus")
STATUS_WORDS = {"DENIED": ("refus", "blacklist", "bloque"), "AUTHORIZED": ("autorise",), "UNKNOWN": ("inconnu", "unknown")}
PLATE_RULES = (
    ("plate_history", 0.9, "plate + historique", ("historique", "logs", "journal")),
    ("plate_last_entry", 0.85, "plate + dernier", ("derniere", "last")),
    ("plate_auth_status", 0.85, "plate + statut", ("autorise", "statut")),
    ("plate_owner", 0.9, "plate + owner", ("appartient", "proprietaire", "owner", "qui a")),
    ("plate_owner", 0.7, "plate default", ("",)),
)
NAME_RULES = (
    ("employee_history", 0.85, "employee + historique", ("historique", "logs", "journal")),
    ("employee_late", 0.8, "employee + retard", ("retard",)),
    ("employee_presence", 0.75, "employee + presence", ("present",)),
    ("employee_info", 0.7, "employee default", ("",)),
)
SQL_TABLES = {
    "vehicles": ("id", "plate_number", "owner_name", "vehicle_type", "status", "created_at"),
    "employees": ("id", "full_name", "plate_number", "department", "employee_code", "is_active", "created_at"),
    "parking_logs": ("id", "plate_number", "entry_time", "exit_time", "status", "image_path"),
    "unknown_detections": ("id", "plate_number", "image_path", "detected_at"),
}
WRITE_WORDS = r"(?is)\b(insert|update|delete|drop|alter|create|truncate)\b"


def _any(norm: Column, words) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | norm.contains(word)
    return cond


def entities(questions: DataFrame, employees: DataFrame, today: Column) -> DataFrame:
    """Adds what a question names: plate, person, department, day, period, times, status."""
    rows = questions.withColumn("norm", norm_question(F.col("question")))
    texts = rows.select("question_id", "norm")
    people = contained_names(texts, employees.select(F.col("full_name").alias("name")), "question_id")
    parts = contained_names(texts, employees.select(F.col("department").alias("name")), "question_id")
    rows = grown_join(rows, people.withColumnRenamed("name", "employee_name"), "question_id", "left")
    rows = grown_join(rows, parts.withColumnRenamed("name", "known_department"), "question_id", "left")
    q, norm = F.col("question"), F.col("norm")
    named = F.nullif(F.upper(F.regexp_extract(norm, r"departement\s+([a-zA-Z0-9_-]{2,30})", 1)), F.lit(""))
    status = None
    for word, hints in STATUS_WORDS.items():
        status = (F if status is None else status).when(_any(norm, hints), word)
    rows = rows.withColumn("plate_raw", extract_plate(q)).withColumn("time_range", D.time_range(norm))
    return rows.select(
        "question_id", "question", "norm", "plate_raw", normalize_plate(F.col("plate_raw")).alias("_p"), "employee_name",
        F.coalesce("known_department", named).alias("department"), D.question_day(q, norm, today).alias("date_value"),
        D.question_span(q, norm, today).alias("date_range"), "time_range",
        F.when(F.col("time_range").isNull(), D.time_value(norm)).alias("time_value"), status.alias("status_keyword"),
    ).withColumn("plate", F.nullif("_p", F.lit(""))).drop("_p")


def intent(rows: DataFrame) -> DataFrame:
    """Adds ``intent``, ``confidence`` and ``reason``; the first rule that fits decides."""
    t = F.col("norm")
    result = lambda name, conf, why: F.struct(F.lit(name).alias("intent"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"))
    chain = []
    for name, conf, why, words in PLATE_RULES:
        chain.append((F.col("plate").isNotNull() & _any(t, words), result(name, conf, why)))
    for name, conf, why, words in NAME_RULES:
        chain.append((F.col("employee_name").isNotNull() & _any(t, words), result(name, conf, why)))
    add = lambda cond, name, conf, why="keywords": chain.append((cond, result(name, conf, why)))
    add(_any(t, ("10 derniers", "dix derniers", "derniers acces")), "last_n_access", 0.7)
    add(_any(t, ("entre", "de ")) & F.col("time_range").isNotNull(), "access_between_times", 0.7, "time range")
    add(F.col("time_value").isNotNull() & _any(t, ("entre", "entree", "access", "acces", "present", "presence", "arrive")), "access_at_time", 0.65, "time value")
    add(t.contains("retard"), "late_today", 0.7)
    add(t.contains("absent"), "absent_today", 0.7)
    add(_any(t, ("actuellement", "en ce moment")) & t.contains("present"), "currently_present", 0.7)
    add(t.contains("present") & (F.col("department").isNotNull() | t.contains("departement")), "dept_present_today", 0.75, "department present")
    add(t.contains("present"), "present_today", 0.65)
    denied = _any(t, ("refus", "blacklist"))
    add(denied & _any(t, ("combien", "nombre")), "count_denied_today", 0.75, "count denied")
    add(denied, "denied_today", 0.7)
    add(_any(t, ("inconnu", "unknown")), "unknown_plates_today", 0.7)
    add(_any(t, ("sans sortie", "sortie sans")), "entry_without_exit", 0.7)
    add(_any(t, ("scan", "doublon", "rapproch")), "multi_scans", 0.65)
    add(_any(t, ("plus souvent", "plus detect")), "most_detected_plate", 0.65)
    add(_any(t, ("plus de temps", "cumule")), "top_presence_time", 0.6)
    out = None
    for cond, value in chain:
        out = (F if out is None else out).when(cond, value)
    return rows.withColumn("_i", out.otherwise(result("unknown", 0.2, "no match"))).select("*", "_i.*").drop("_i")


def use_model(question: Column) -> Column:
    return _any(norm_question(question), MODEL_TRIGGERS)


def resolve_plates(rows: DataFrame, employees: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Owner per question ``(question_id, plate_raw)``.

    Candidates are the raw, normalised and reordered plate, first among employees, then a single
    suggestion, then among vehicles. Names and departments fill each other.
    """
    # Plates are resolved once, however many questions ask for them; questions meet the answers by plate.
    raw = F.col("plate_raw")
    plates = rows.select("plate_raw").distinct()
    candidates = F.array_distinct(F.array_compact(F.array(raw, reorder_plate(raw), F.nullif(normalize_plate(raw), F.lit("")))))
    asked = plates.select("plate_raw", F.posexplode(candidates).alias("pos", "probe"))
    hints = suggest_plates(plates.select(raw.alias("plate_number")), employees, vehicles)
    single = hints.groupBy("plate_number").agg(F.count("*").alias("n"), F.max("suggestion").alias("suggestion")).filter("n = 1")
    hinted = single.select(F.col("plate_number").alias("plate_raw"), F.col("suggestion").alias("probe"))
    people = employees.select(F.col("plate_number").alias("probe"), F.struct(
        "full_name", "department", F.col("full_name").alias("owner_name"), F.col("department").alias("vehicle_type"), F.lit("employees").alias("source")).alias("o"))
    cars = vehicles.select(F.col("plate_number").alias("probe"), F.struct(
        F.col("owner_name").alias("full_name"), F.col("vehicle_type").alias("department"), "owner_name", "vehicle_type", F.lit("vehicles").alias("source")).alias("o"))
    tier = lambda df, base, table, pos=F.lit(0): grown_join(df, table, "probe").select("plate_raw", (F.lit(base) + pos).alias("rank"), "probe", "o")
    found = tier(asked, 0, people, F.col("pos")).unionByName(tier(hinted, 10, people)).unionByName(tier(hinted, 11, cars)).unionByName(
        tier(asked, 20, cars, F.col("pos")))
    best = found.groupBy("plate_raw").agg(F.min(F.struct("rank", "probe", "o")).alias("b"))
    return rows.select("question_id", "plate_raw").join(best, "plate_raw", "left").select(
        "question_id", F.col("b.probe").alias("plate_number"), "b.o.*")


def audit_sql(statements: DataFrame) -> DataFrame:
    """Adds ``allowed`` to statements ``(sql_id, sql)``: SELECT only, known tables and columns."""
    text = F.trim(F.trim("sql"), F.lit(";"))
    refs = F.regexp_extract_all(text, F.lit(r"(?is)\b(?:from|join)\s+([a-zA-Z0-9_.]+(?:\s+as)?\s*[a-zA-Z0-9_]*)"), F.lit(1))
    rows = statements.withColumn("_refs", F.transform(refs, lambda r: F.split(F.lower(F.trim(r)), r"\s+(?:as\s+)?")))
    names = F.transform("_refs", lambda p: F.struct(
        F.substring_index(p[0], ".", -1).alias("table"), F.nullif(F.when(F.size(p) > 1, p[1]), F.lit("")).alias("alias")))
    rows = rows.withColumn("_names", names)
    tables = F.array(*[F.lit(t) for t in SQL_TABLES])
    catalog = F.create_map(*[x for t, cols in SQL_TABLES.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in cols]))])
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)"), F.lit(1)), lambda s: F.split(F.lower(s), r"\."))
    rows = rows.withColumn("_pairs", pairs)
    # The last use of an alias counts.
    owner = lambda a: F.coalesce(F.get(
        F.reverse(F.filter("_names", lambda n: n["alias"] == a)), F.lit(0))["table"], a)
    bad_column = F.exists("_pairs", lambda p: F.coalesce(~F.array_contains(F.try_element_at(catalog, owner(p[0])), p[1]), F.lit(False)))
    ok = (
        text.rlike(r"(?is)^select\s") & ~text.rlike(WRITE_WORDS)
        & ~F.exists("_names", lambda n: ~F.array_contains(tables, n["table"])) & ~bad_column
    )
    return rows.withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("_refs", "_names", "_pairs")


def context_pack(rows: DataFrame, order: list, limit: int = 25, max_chars: int = 4000) -> DataFrame:
    """JSON context of the first rows: 25, then half as many until the text fits."""
    total = rows.agg(F.count("*").alias("row_count"))
    top = rows.orderBy(*order).limit(limit)
    # At most 25 small rows are listed; the limit is the feature.
    listed = top.agg(F.collect_list(F.struct(*rows.columns)).alias("r"))
    packed = listed.withColumn("row_count", total.scalar())
    options = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    texts, n = [], limit
    while n > 0:
        texts.append(F.to_json(F.struct("row_count", F.slice("r", 1, n).alias("rows")), options))
        n = n // 2
    fits = [F.when(F.length(t) <= max_chars, t) for t in texts]
    return packed.select("row_count", F.coalesce(*fits, texts[-1]).alias("context"))
