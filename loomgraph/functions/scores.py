"""Scores, weights, decays and normalisations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Behaviour weights; unknown behaviours weigh UNKNOWN.
BEHAVIOUR = {"view": 0.2, "click": 0.2, "addtocart": 0.5, "cart": 0.5, "purchase": 1.0, "buy": 1.0, "purchased": 1.0, "bought": 1.0, "favorite": 0.7, "favourite": 0.7, "favorites": 0.7, "favourites": 0.7, "wishlist": 0.7, "addtofavorite": 0.7, "addtofavourite": 0.7, "addtowishlist": 0.7, "follow": 0.5, "flw": 0.5}
UNKNOWN = 0.2
DAY = 86_400.0


def behaviour_weight(name: Column, weights: dict[str, float] | None = None) -> Column:
    """The weight of a behaviour, its case, blanks, dashes and underscores aside."""
    compact = lambda s: s.replace("-", "").replace("_", "").replace(" ", "")
    key = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "-_ ", "")
    out = F.lit(UNKNOWN)
    for value in sorted(set((weights or BEHAVIOUR).values())):
        out = F.when(key.isin(*[compact(k) for k, v in (weights or BEHAVIOUR).items() if v == value]), value).otherwise(out)
    return out


def age_days(ts: Column, as_of: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0.0), (micros(as_of) - micros(ts)) / (DAY * 1e6))


def half_life(ts: Column, as_of: Column, days: float | None) -> Column:
    """0.5 ^ (age / days); 1 without a date or a positive half-life."""
    if not days or days <= 0:
        return F.lit(1.0)
    return F.coalesce(F.pow(F.lit(0.5), age_days(ts, as_of) / days), F.lit(1.0))


def recency(ts: Column, as_of: Column) -> Column:
    return F.coalesce(1.0 / (1.0 + age_days(ts, as_of)), F.lit(0.0))


def log_recency(ts: Column, as_of: Column) -> Column:
    return F.coalesce(1.0 / (1.0 + F.log1p(age_days(ts, as_of))), F.lit(0.0))


def damped(degree: Column) -> Column:
    return 1.0 / F.log2(2.0 + F.greatest(degree, F.lit(0)))


def okapi_idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def okapi_term(tf: Column, dl: Column, avgdl: Column, idf: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def min_max(value: Column, keys: list[str], constant: float = 1.0) -> Column:
    """Rescales to 0..1 within the keys; a list of one value becomes `constant`: 1 in fusion, 0 in personalisation."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNull(), None).when(high <= low, constant).otherwise((value - low) / (high - low))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def wsim(s: Column, w: float) -> Column:
    """s ^ (1 - w), negative similarities as 0."""
    return F.pow(F.greatest(s, F.lit(0.0)), F.lit(1.0 - w))


def association(node: Column, relation: Column, factor: Column) -> Column:
    return F.when((node == 0) | (relation == 0) | node.isNull() | relation.isNull(), 0.0).otherwise((node + relation) / 2 * factor)


def personal_share(text: Column) -> Column:
    """How far preferences count for a query: by its number of words; none with a digit or without words."""
    n = F.size(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.when(F.coalesce(text, F.lit("")).rlike("[0-9]"), 0.0).when(n == 0, 0.0).when(n == 1, 0.85).when(n == 2, 0.5).when(n == 3, 0.25).otherwise(0.1)


def relevance(distance: Column, mass: Column, complete: Column, recent: Column, topic: Column) -> Column:
    return 0.45 / (1.0 + distance) + 0.25 * mass + 0.20 * complete / 3.8 + 0.10 * recent + 0.08 * topic


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id from SHA-256 of the trimmed, lower-cased parts."""
    h = F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def vector_key(text: Column) -> Column:
    """First 8 bytes of SHA-256 modulo 2^63 as a number."""
    first = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(first, F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of b against c discordant pairs."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    # terms by their ratios: C(n, i + 1) = C(n, i) * (n - i) / (i + 1)
    tail = F.aggregate(F.sequence(F.lit(0), k), F.struct(F.pow(F.lit(0.5), n).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * (n - i) / (i + 1)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
