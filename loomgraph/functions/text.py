"""Text functions as column expressions: tokenisers, name scores, field extraction, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and field names that results depend on.
HYBRID_STOP = ("the", "and", "for", "with", "from", "this", "that", "are", "was")
GRAPH_STOP = ("the", "and", "for", "with", "from", "this", "that", "are", "was", "what", "which", "who", "how", "when", "where")
LABEL_JUNK = " -.,:;()[]{}'"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with repetitions: the `simple` analyser."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hybrid_tokens(text: Column) -> Column:
    """Distinct words of three or more letters that aren't stop words, in order."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= 3) & ~w.isin(*HYBRID_STOP)))


def graph_tokens(text: Column, most: int = 6) -> Column:
    """The first `most` distinct ASCII words of three or more letters, less stop words and the whole query."""
    whole = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    found = F.array_distinct(F.regexp_extract_all(whole, F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return F.slice(F.filter(found, lambda w: ~w.isin(*GRAPH_STOP) & (w != whole)), 1, most)


def overlap(tokens: Column, text: Column) -> Column:
    """How many of the tokens the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(tokens, lambda t: F.contains(low, t)))


def name_score(query: Column, tokens: Column, name: Column) -> Column:
    """5 for equality, else 3 for containment; 1 for each token contained, their share, and 0.75 for each pair of
    neighbouring tokens contained."""
    q, n = F.lower(F.trim(query)), F.lower(F.coalesce(name, F.lit("")))
    hits = F.size(F.filter(tokens, lambda t: F.contains(n, t)))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    near = F.size(F.filter(pairs, lambda p: F.contains(n, p)))
    base = F.when(q == n, 5.0).when((F.length(q) > 0) & F.contains(n, q), 3.0).otherwise(0.0)
    return base + hits + F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(0.0) + near * 0.75


def normal_label(label: Column) -> Column:
    return F.translate(F.upper(label), LABEL_JUNK, "_" * len(LABEL_JUNK))


def attribute_label(text: Column) -> Column:
    """Upper case, other characters runs of _, 40 at most; ATTR if nothing is left or a digit leads."""
    clean = F.substring(F.upper(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")), 1, 40)
    return F.when((clean == "") | clean.isNull(), "ATTR").when(clean.rlike("^[0-9]"), F.concat(F.lit("ATTR_"), clean)).otherwise(clean)


def camel_key(key: Column) -> Column:
    """Property keys: words joined, each but the first capitalised."""
    parts = F.filter(F.split(F.trim(key), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).otherwise(F.initcap(p))), "")


def field(text: Column, name: str) -> Column:
    """The value of a `Name: value` line, case-insensitive; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{name}\s*:\s*(.+)$", 1)), F.lit(""))


def hierarchy(path: Column) -> Column:
    """Parts between > / |, trimmed, distinct without regard to case, the first spelling kept."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), r"[>/|]"), lambda p: F.trim(p)), lambda p: p != "")
    low = F.transform(parts, lambda p: F.lower(p))
    return F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)


def feature_pairs(text: Column) -> Column:
    """`k : v | k : v` as an array of (key, value); parts without both are dropped."""
    pair = lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"^([^:]*):(.*)$", 1))).alias("key"), F.trim(F.regexp_extract(p, r"(?s)^([^:]*):(.*)$", 2)).alias("value"))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), pair), lambda x: (x["key"] != "") & (x["value"] != ""))


def marked_id(text: Column) -> Column:
    """What follows DOCID, without a closing full stop; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"DOCID\s+(\S+)", 1), r"\.+$", ""), F.lit(""))


def sessions(text: Column) -> Column:
    """Distinct session names in a text: session_<n>, and b<n>_t<m> as session_b<n>_t<m>."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"session_(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("session_"), n))
    turns = F.transform(F.regexp_extract_all(text, F.lit(r"\bb(\d+_t\d+)"), F.lit(1)), lambda n: F.concat(F.lit("session_b"), n))
    return F.array_distinct(F.concat(plain, turns))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def span_alignment(span: Column, text: Column) -> Column:
    """1 if the span stands in the text, white space and case aside; else the best Jaccard similarity of its tokens
    with a window of max(n + 4, 8) of the text's."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    s, t = F.filter(F.split(clean(span), " "), lambda w: w != ""), F.filter(F.split(clean(text), " "), lambda w: w != "")
    width = F.greatest(F.size(s) + 4, F.lit(8))
    starts = F.sequence(F.lit(1), F.greatest(F.size(t) - width + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda i: jaccard(F.array_distinct(s), F.array_distinct(F.slice(t, i, width)))))
    return F.when((clean(span) != "") & F.contains(clean(text), clean(span)), 1.0).when((F.size(s) == 0) | (F.size(t) == 0), 0.0).otherwise(best)


def snippet(text: Column, most: int = 240) -> Column:
    whole = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, most - 1)), F.lit("…")))


def chunks(text: Column, most: int = 6000) -> Column:
    """Greedy paragraph chunks: paragraphs are joined while they fit, longer ones go by line, longer lines are cut."""
    empty = F.array().cast("array<string>")
    cut = lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substr(p, i * most + 1, F.lit(most))))
    lines = lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.flatten(F.transform(F.split(p, "\n"), cut)))
    units = F.filter(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lines)), lambda u: F.trim(u) != "")

    def step(acc: Column, unit: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 2 + F.length(unit) <= most)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), unit)))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(unit)))

    return F.aggregate(units, empty, step)


def normal_answer(text: Column) -> Column:
    """Tokens of an answer: lower case, punctuation as space, articles dropped."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(parts, lambda w: ~w.isin("a", "an", "the", ""))


def product_text(fields: dict[str, Column]) -> Column:
    """`Title: … Brand: …` lines of the fields that have a value."""
    return F.concat_ws("\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in fields.items()])


def fact_text(actor: Column, leg1: Column, event: Column, leg2: Column, target: Column) -> Column:
    return F.concat(F.lit("Actor: "), actor, F.lit(" | "), leg1, F.lit(" | Event: "), event, F.lit(" | "), leg2, F.lit(" | Target/Context: "), target)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def entity_words(text: Column, stop: tuple[str, ...] = GRAPH_STOP) -> Column:
    """Distinct words of two letters or more that aren't stop words, capitalised."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))
    low = F.array_distinct(F.transform(runs, lambda w: F.lower(w)))
    return F.transform(F.filter(low, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))


def any_of(have: Column, need: list[str]) -> Column:
    """Label filter: upper-cased sets meet; an empty filter passes."""
    return F.lit(True) if not need else F.arrays_overlap(F.transform(have, lambda x: normal_label(x)), F.array(*[normal_label(F.lit(n)) for n in need]))


def all_of(have: Column, need: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(F.transform(have, lambda x: normal_label(x)), normal_label(F.lit(n))) for n in need], F.lit(True))


def fixed_slices(text: Column, most: int) -> Column:
    """Slices of `most` characters, the fallback of semantic chunking."""
    n = F.ceil(F.length(text) / most).cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * most + 1, F.lit(most))))


def unit_size(entities: Column, dense: int = 12, small: int = 1200, large: int = 6000) -> Column:
    """Chunk size by how many entities a unit has."""
    return F.when(entities >= dense, small).otherwise(large)
