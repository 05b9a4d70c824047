"""Dates written as text: absolute in many formats, day first, and relative to a reference time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats in order of trial, day first; each with the shape that a text must have to be tried.
FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{4,}-\d{1,2}-\d{4}$", "MMMM-d-yyyy"),
    (r"^[A-Za-z]{3}-\d{1,2}-\d{4}$", "MMM-d-yyyy"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([+-]\d{2}:?\d{2}|Z)?$", "iso"),
    (r"^\d{1,2}:\d{2} [APap][Mm] on \d{1,2} [A-Za-z]{4,}, \d{4}$", "h:mm a 'on' d MMMM, yyyy"),
    (r"^\d{1,2}:\d{2} [APap][Mm] on \d{1,2} [A-Za-z]{3}, \d{4}$", "h:mm a 'on' d MMM, yyyy"),
)
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def parsed(text: Column) -> Column:
    """The time, in UTC, of the first format that fits; null if none does."""
    clean = F.trim(text)
    # months are written with one capital, am and pm in capitals; May is short and long alike
    shaped = F.regexp_replace(F.initcap(F.regexp_replace(clean, "-", " - ")), " - ", "-")
    cased = F.regexp_replace(F.regexp_replace(F.regexp_replace(shaped, r"(?i)\b(a|p)m\b", "$1M"), r"\bOn\b", "on"), r"\b([ap])M\b", "$1M")
    cased = F.when(cased.rlike(r"(?i)^\d{1,2}:\d{2} [ap]m on"), F.concat(F.regexp_extract(cased, r"^(\S+ )", 1), F.upper(F.regexp_extract(cased, r"^\S+ (\S+)", 1)), F.regexp_extract(cased, r"^\S+ \S+( .*)$", 1))).otherwise(cased)
    cased = F.regexp_replace(cased, r"\bMay\b", "May")
    out = []
    for shape, form in FORMATS:
        if form == "iso":
            value = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(clean, " ", "T"), r"([+-]\d{2})(\d{2})$", "$1:$2"))
        else:
            value = F.try_to_timestamp(cased, F.lit(form))
            if "MMMM" in form:  # four letters and more, and three-letter names too
                shape = shape.replace("{4,}", "{3,}")
        out.append(F.when(clean.rlike(shape), value))
    return F.coalesce(*out)


def normal(text: Column) -> Column:
    """dd/MM/yyyy, or the text itself if it isn't a date."""
    return F.coalesce(F.date_format(parsed(text), "dd/MM/yyyy"), F.trim(text))


def resolved(text: Column, reference: Column) -> Column:
    """dd/MM/yyyy of an absolute or relative date (yesterday, 3 days ago, last month, next friday); else the text."""
    low = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    ref = reference.cast("date")
    n = lambda pattern: F.regexp_extract(low, pattern, 1).cast("int")
    out = (
        F.when(low == "yesterday", F.date_add(ref, -1)).when(low == "tomorrow", F.date_add(ref, 1)).when(low == "today", ref)
        .when(low == "last week", F.date_add(ref, -7)).when(low == "next week", F.date_add(ref, 7))
        .when(low == "last month", F.add_months(ref, -1)).when(low == "next month", F.add_months(ref, 1))
        .when(low.rlike(r"^\d+ days? ago$"), F.date_add(ref, -n(r"^(\d+)")))
        .when(low.rlike(r"^in \d+ days?$"), F.date_add(ref, n(r"^in (\d+)")))
        .when(low.rlike(r"^\d+ weeks? ago$"), F.date_add(ref, -7 * n(r"^(\d+)")))
    )
    day = F.array_position(F.array(*map(F.lit, DAYS)), F.regexp_extract(low, r"^(?:last|this|next) (\w+)$", 1)).cast("int") - 1
    ahead = F.pmod(day - F.weekday(ref), F.lit(7))
    behind = F.pmod(F.weekday(ref) - day, F.lit(7))
    week = lambda c: F.when(c == 0, 7).otherwise(c)
    shift = F.when(low.startswith("this"), ahead).when(low.startswith("next"), week(ahead)).otherwise(-week(behind))
    out = F.coalesce(out, F.when(day >= 0, F.date_add(ref, shift)))
    return F.coalesce(F.date_format(parsed(text), "dd/MM/yyyy"), F.date_format(out, "dd/MM/yyyy"), F.trim(text))
