"""Dates, periods and times in French questions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_TOKEN = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b"


def parse_date(token: Column) -> Column:
    """``yyyy-MM-dd`` or ``dd/MM/yyyy``; null otherwise."""
    iso = F.when(token.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(token, "yyyy-M-d"))
    french = F.when(token.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(token, "d/M/yyyy"))
    return F.coalesce(iso, french)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("date").alias("start_date"), end.cast("date").alias("end_date"))


def week_range(day: Column) -> Column:
    monday = F.date_trunc("week", day).cast("date")
    return _span(monday, F.date_add(monday, 6))


def month_range(day: Column) -> Column:
    return _span(F.trunc(day, "month"), F.last_day(day))


def year_range(day: Column) -> Column:
    return _span(F.trunc(day, "year"), F.make_date(F.year(day), F.lit(12), F.lit(31)))


def literal_date(question: Column) -> Column:
    tokens = F.regexp_extract_all(question, F.lit(f"({DATE_TOKEN})"), F.lit(1))
    dates = F.filter(F.transform(tokens, parse_date), lambda d: d.isNotNull())
    return F.get(dates, F.lit(0))


def question_day(question: Column, norm: Column, today: Column) -> Column:
    return F.coalesce(
        literal_date(question),
        F.when(norm.contains("aujourd"), today).when(norm.contains("hier"), F.date_sub(today, 1)),
    )


def question_span(question: Column, norm: Column, today: Column) -> Column:
    """Period named in the question; null where a single day is named first."""
    last_month = F.date_sub(F.trunc(today, "month"), 1)
    named = (
        F.when(norm.contains("semaine derniere"), week_range(F.date_sub(today, 7)))
        .when(norm.contains("cette semaine"), week_range(today))
        .when(norm.contains("mois dernier"), month_range(last_month))
        .when(norm.contains("ce mois") | norm.contains("mois-ci"), month_range(today))
        .when(norm.contains("annee derniere"), year_range(F.add_months(today, -12)))
        .when(norm.contains("cette annee"), year_range(today))
    )
    return F.when(question_day(question, norm, today).isNull(), named)


def _clock(raw: Column) -> Column:
    """``8h05`` or ``08:05`` as ``HH:MM:SS`` with a padded hour."""
    text = F.replace(raw, F.lit("h"), F.lit(":"))
    return F.when(raw != "", F.concat(F.lpad(text, 5, "0"), F.lit(":00")))


def time_range(norm: Column) -> Column:
    clock = r"(\d{1,2}[:h]\d{2})"
    first = rf"entre\s+{clock}\s+et\s+{clock}"
    second = rf"de\s+{clock}\s+a\s+{clock}"
    pick = lambda g: F.when(norm.rlike(first), F.regexp_extract(norm, first, g)).otherwise(
        F.regexp_extract(norm, second, g)
    )
    return F.when(pick(1) != "", F.struct(_clock(pick(1)).alias("start_time"), _clock(pick(2)).alias("end_time")))


def time_value(norm: Column) -> Column:
    return _clock(F.regexp_extract(norm, r"\ba\s*(\d{1,2}[:h]\d{2})", 1))
