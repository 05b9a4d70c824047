"""Text functions beyond SQL: Unicode normalisation, name likeness, tolerant spans. Arrow-batched pandas functions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _indel(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_indel(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def same_entity(name_a: Column, labels_a: Column, name_b: Column, labels_b: Column, least: float = 0.75) -> Column:
    """0.6 of the names' likeness and 0.4 of the labels' over `least`."""
    union = F.size(F.array_union(labels_a, labels_b))
    share = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(labels_a, labels_b)) / union)
    return 0.6 * indel_ratio(F.lower(name_a), F.lower(name_b)) + 0.4 * share > least


def _spelling(text: str | None) -> str | None:
    if text is None:
        return None
    flat = unicodedata.normalize("NFKD", html.unescape(unicodedata.normalize("NFKC", text)))
    return re.sub(r"^[\W_]+|[\W_]+$", "", "".join(c for c in flat if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def spelling(text: pd.Series) -> pd.Series:
    """One spelling: compatible characters, entities resolved, no accents, no junk at the ends."""
    return text.map(_spelling)


def _offset(span: str | None, text: str | None) -> int:
    if not span or not text:
        return -1
    at = text.find(span)
    if at < 0:
        m = re.search(r"\s+".join(map(re.escape, span.split())), text, re.I) if span.split() else None
        at = m.start() if m else -1
    return at


@F.pandas_udf(T.IntegerType())
def span_offset(span: pd.Series, text: pd.Series) -> pd.Series:
    """Where a span begins in a text: exactly, else with any white space and case; -1 if nowhere."""
    return pd.Series([_offset(s, t) for s, t in zip(span, text, strict=True)], dtype="int32")


def looks_like_sql(query: Column) -> Column:
    return query.rlike(r"(?i)\b(select\s.+\sfrom|insert\s+into|update\s.+\sset|delete\s+from|drop\s+table)\b")


def has_entities(query: Column) -> Column:
    return query.rlike(r"&(#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});")


def last_json(text: Column) -> Column:
    """The last JSON object of a text, as written; null if it doesn't parse."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), F.lit(0))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(F.try_parse_json(last).isNotNull(), last)


def extras(fields: dict[str, Column], reserved: tuple[str, ...] = ("id", "text")) -> Column:
    """A map of the fields that have a value and aren't reserved, as trimmed strings."""
    pairs = [x for k, c in fields.items() if k not in reserved for x in (F.lit(k), F.trim(c.cast("string")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def merged_extras(first: Column, second: Column) -> Column:
    """The second map over the first; its nulls don't count."""
    over = F.map_filter(second, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(over, k)), over)


def set_properties(have: Column, put: Column, drop: list[str]) -> Column:
    return F.map_filter(merged_extras(have, put), lambda k, _: ~k.isin(*drop) if drop else F.lit(True))
