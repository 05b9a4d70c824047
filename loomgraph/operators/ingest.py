"""Ingest: triples, merges, supersession, resolution, duplicates, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine, stable_uuid

# Reason codes of rejected triples and ranks of task states.
STATES = {"queued": 0, "started": 1, "persisted": 2, "consolidated": 3, "completed": 4, "failed": 4}


def merged_nodes(writes: DataFrame) -> DataFrame:
    """One node for each uuid from its writes (uuid, seq, name, description, labels, properties, aliases), in order of
    seq: properties later over earlier, descriptions joined unless contained, labels of the last that has any, aliases
    as an ordered set."""
    rows = writes.groupBy("uuid").agg(F.collect_list(F.struct("seq", "name", "description", "labels", "properties", "aliases")).alias("w"))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)  # noqa: E731  maps have no order
    rows = rows.withColumn("w", F.array_sort("w", by_seq))
    last = lambda k: F.element_at(F.filter(F.transform("w", lambda x: x[k]), lambda v: v.isNotNull()), -1)
    join = lambda acc, x: F.when(F.coalesce(x, F.lit("")) == "", acc).when(acc == "", x).when(F.contains(acc, x), acc).otherwise(F.concat(acc, F.lit(" | "), x))
    description = F.aggregate("w", F.lit("").cast("string"), lambda acc, x: join(acc, x["description"]))
    props = F.aggregate(F.transform("w", lambda x: F.coalesce(x["properties"], F.create_map().cast("map<string,string>"))), F.create_map().cast("map<string,string>"), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m))
    labels = F.element_at(F.filter(F.transform("w", lambda x: x["labels"]), lambda v: F.size(v) > 0), -1)
    aliases = F.array_distinct(F.flatten(F.transform("w", lambda x: F.coalesce(x["aliases"], F.array().cast("array<string>")))))
    return rows.select("uuid", last("name").alias("name"), F.nullif(description, F.lit("")).alias("description"), F.try_element_at(F.array(labels), F.lit(1)).alias("labels"), props.alias("properties"), aliases.alias("aliases"))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """uuids that edges name and nodes lack: they are created bare."""
    ends = edges.select(F.col("src").alias("uuid")).union(edges.select("dst")).distinct()
    return ends.join(nodes, "uuid", "left_anti")


def superseded(facts: DataFrame, subject: str = "subject", kind: str = "type", value: str = "object", order: tuple[str, ...] = ("valid_at", "uuid")) -> DataFrame:
    """Adds invalid_at: the time of the next fact of the same subject and type with another object; null while valid.
    Facts without a type never lapse."""
    w = Window.partitionBy(subject, kind).orderBy(*order)
    changed = F.lead(value).over(w) != F.col(value)
    # the first later fact with another value: carry the next change back over a run of equal ones
    step = F.when(changed, F.lead("valid_at").over(w))
    back = w.rowsBetween(0, Window.unboundedFollowing)
    rows = facts.withColumn("_step", step)
    return rows.withColumn("invalid_at", F.when(F.coalesce(F.col(kind), F.lit("")) != "", F.first("_step", ignorenulls=True).over(back))).drop("_step")


def resolved_events(new: DataFrame, anchors: DataFrame, known: DataFrame, links: DataFrame, least: float = 0.7, gap: float = 0.02) -> DataFrame:
    """key, match of new events (key, embedding, day) against known ones (uuid, embedding, day): those linked (anchor,
    uuid) with at least half of a new event's anchors (key, anchor), on the same day where both have one, and with names
    of a cosine of `least`; the nearest, unless the second is within `gap`."""
    held = anchors.select("key", "anchor").distinct()
    need = held.groupBy("key").agg(F.greatest(F.lit(1), F.floor((F.count("*") + 1) / 2)).alias("need"))
    shared = held.join(links.select("anchor", "uuid").distinct(), "anchor").groupBy("key", "uuid").agg(F.count("*").alias("n"))
    rows = shared.join(need, "key").filter("n >= need").join(new.select("key", F.col("embedding").alias("e1"), F.col("day").alias("d1")), "key").join(known.select("uuid", F.col("embedding").alias("e2"), F.col("day").alias("d2")), "uuid")
    rows = rows.filter(F.col("d1").isNull() | F.col("d2").isNull() | (F.col("d1") == F.col("d2"))).withColumn("sim", F.round(cosine(F.col("e1"), F.col("e2")), 6)).filter(F.col("sim") >= least)
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "uuid")
    first = rows.select("key", F.col("uuid").alias("match"), "sim", F.lead("sim").over(w).alias("second"), F.row_number().over(w).alias("r")).filter("r = 1")
    return first.filter(F.col("second").isNull() | (F.round(F.col("sim") - F.col("second"), 6) >= gap)).select("key", "match")


def resolved(new: DataFrame, known: DataFrame, near: DataFrame, least: float = 0.9, gap: float = 0.02, events: DataFrame | None = None) -> DataFrame:
    """new (key, uuid, name, type) against known (uuid, name, type): by uuid, then by name and type, then by the nearest
    of near (key, uuid, sim) of the same type at `least`, unless the second is within `gap`, then by events (key, match),
    as resolved_events gives them. match, how."""
    by_id = new.join(known.select(F.col("uuid").alias("m1")), F.col("uuid") == F.col("m1"), "left")
    names = known.groupBy(F.lower("name").alias("n"), F.lower("type").alias("t")).agg(F.min("uuid").alias("m2"))
    by_name = by_id.join(names, (F.lower("name") == F.col("n")) & (F.lower("type") == F.col("t")), "left").drop("n", "t")
    typed = near.join(known.select(F.col("uuid").alias("c"), F.col("type").alias("ct")), near["uuid"] == F.col("c")).join(new.select(F.col("key").alias("k"), F.col("type").alias("kt")), (near["key"] == F.col("k")) & (F.col("ct") == F.col("kt")))
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "c")
    first = typed.filter(F.col("sim") >= least).select("key", "c", "sim", F.lead("sim").over(w).alias("second"), F.row_number().over(w).alias("r")).filter("r = 1")
    first = first.filter(F.col("second").isNull() | (F.round(F.col("sim") - F.col("second"), 6) >= gap)).select("key", F.col("c").alias("m3"))
    rows = by_name.join(first, "key", "left")
    rows = rows.withColumn("m4", F.lit(None).cast("string")) if events is None else rows.join(events.select("key", F.col("match").alias("m4")), "key", "left")
    how = F.lit("new")
    for step, m in (("event", "m4"), ("vector", "m3"), ("name", "m2"), ("uuid", "m1")):
        how = F.when(F.col(m).isNotNull(), step).otherwise(how)
    return rows.select("key", F.coalesce("m1", "m2", "m3", "m4").alias("match"), how.alias("how"))


def without_known_edges(new: DataFrame, near: DataFrame, known: DataFrame, most: float = 0.1) -> DataFrame:
    """new (uuid, src, dst) less those whose nearest known edge (near: uuid, other, distance) is within `most` and has
    the same two ends, whatever their order."""
    pair = lambda a, b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    best = near.groupBy("uuid").agg(F.min(F.struct("distance", "other")).alias("b")).filter(F.col("b.distance") < most).select("uuid", F.col("b.other").alias("other"))
    same = best.join(new.select("uuid", pair("src", "dst").alias("p")), "uuid").join(known.select(F.col("uuid").alias("other"), pair("src", "dst").alias("q")), "other").filter("p = q")
    return new.join(same.select("uuid"), "uuid", "left_anti")


def relationships_of(triples: DataFrame) -> DataFrame:
    """Edges of triples (id, subject, subj_event, event, event_obj, object; all names but id): two legs of one flow key
    over the event, or one direct edge."""
    flow = stable_uuid(F.lit("flow"), "id", "event")
    leg = lambda a, p, b, k: F.struct(F.col(a).alias("src_name"), F.col(p).alias("name"), F.col(b).alias("dst_name"), k.alias("flow_key"))
    legs = F.array(leg("subject", "subj_event", "event", flow), leg("event", "event_obj", "object", flow))
    direct = F.array(leg("subject", "subj_event", "object", F.lit(None).cast("string")))
    rows = triples.select("id", F.posexplode(F.when(F.col("event").isNotNull(), legs).otherwise(direct)).alias("leg", "e")).select("id", "leg", "e.*")
    return rows.filter("src_name is not null and dst_name is not null").withColumn("uuid", stable_uuid(F.lit("rel"), "src_name", "name", "dst_name", F.coalesce("flow_key", F.lit(""))))


def reason(least: float = 0.15, accept: float = 0.45) -> Column:
    """Why a triple (subject, subject_type, predicate, object, object_type, score) is rejected, doubtful or accepted."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank("subject") | blank("object"), "missing_name").when(blank("subject_type") | blank("object_type"), "missing_type").when(blank("predicate"), "missing_predicate")
        .when((F.lower("subject") == F.lower("object")) & (F.lower("subject_type") == F.lower("object_type")), "same_ends")
        .when(F.col("score") < least, "ungrounded").when(F.col("score") < accept, "ambiguous").otherwise("accepted")
    )


def catalog_triples(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """HAS triples of catalog rows (doc_id, …): doc_id, kind, hub (`hub:kind:value`), value; repeated values once."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in fields.items()])
    rows = docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.kind", F.trim("p.value").alias("value")).filter("coalesce(value, '') <> ''")
    slug = F.regexp_replace(F.lower("value"), "[^a-z0-9]+", "-")
    return rows.withColumn("hub", F.concat_ws(":", F.lit("hub"), "kind", slug)).dropDuplicates(["doc_id", "hub"])


def interaction_triples(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """MADE and TARGETED legs of interactions (user_id, item_id, behavior, ts): events are numbered within their user."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "item_id", "behavior"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower("behavior")), F.upper("behavior"))
    out = rows.withColumn("seq", seq).withColumn("event_name", kind)
    event = F.concat_ws(":", F.lit("evt"), "user_id", F.lower("event_name"), F.col("seq").cast("string"))
    legs = F.array(F.struct(F.lit("MADE").alias("name"), F.concat(F.lit("user:"), "user_id").alias("src"), event.alias("dst")), F.struct(F.lit("TARGETED").alias("name"), event.alias("src"), F.col("item_id").cast("string").alias("dst")))
    return out.select(event.alias("flow_key"), "event_name", "ts", F.explode(legs).alias("l")).select("flow_key", "event_name", "ts", "l.*")


def task_status(updates: DataFrame) -> DataFrame:
    """The furthest state of each task (task, state, seq): states never go back, ends stay; of ends the first counts."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("state")), F.lit(-1))
    return updates.groupBy("task").agg(F.max_by("state", F.struct(rank, -F.col("seq"))).alias("state"))


def longest_description(entities: DataFrame) -> DataFrame:
    """Entities of several chunks merged by name, type and date; the longest description stays, ties the least."""
    keys = [F.lower("name").alias("name_key"), F.lower("type").alias("type_key"), F.coalesce(F.col("happened_at"), F.lit("")).alias("at_key")]
    return entities.groupBy(*keys).agg(F.min("name").alias("name"), F.max_by("description", F.struct(F.length("description"), F.md5("description"))).alias("description"), F.count("*").alias("n"))


def bag_embedding(text: Column, buckets: int = 8) -> Column:
    """A model-free vector for tests: character codes added up by place modulo `buckets`, over the length."""
    chars = F.split(F.coalesce(text, F.lit("")), "")
    n = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    codes = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.struct((i % buckets).alias("b"), F.ascii(c).alias("v")))
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.aggregate(F.filter(codes, lambda x: x["b"] == b), F.lit(0.0), lambda s, x: s + x["v"]) / n)


def merged_edges(writes: DataFrame) -> DataFrame:
    """One edge for each uuid of writes (uuid, src, name, dst, seq, properties); without a uuid it is src-name-dst. Later
    properties go over earlier ones."""
    keyed = writes.withColumn("uuid", F.coalesce("uuid", F.concat_ws("-", "src", "name", "dst")))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    rows = keyed.groupBy("uuid").agg(F.max_by(F.struct("src", "name", "dst"), "seq").alias("e"), F.array_sort(F.collect_list(F.struct("seq", "properties")), by_seq).alias("w"))
    empty = F.create_map().cast("map<string,string>")
    props = F.aggregate("w", empty, lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(F.coalesce(x["properties"], empty), k)), F.coalesce(x["properties"], empty)))
    return rows.select("uuid", "e.src", "e.name", "e.dst", props.alias("properties"))


def deprecated(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges named in gone (uuid) are flagged, and stay."""
    marked = gone.select("uuid", F.lit(True).alias("_gone")).distinct()
    return edges.join(marked, "uuid", "left").withColumn("deprecated", F.coalesce("_gone", "deprecated", F.lit(False))).drop("_gone").select(*edges.columns)


def mentioned(units: DataFrame, entities: DataFrame) -> DataFrame:
    """unit, entity: the entities of each unit's document (unit, doc, text; doc, entity) whose names it contains, or all
    of them if it contains none."""
    pairs = units.join(entities, "doc").withColumn("hit", F.contains(F.lower("text"), F.lower("entity")))
    w = Window.partitionBy("unit")
    return pairs.withColumn("any", F.max(F.col("hit").cast("int")).over(w)).filter((F.col("any") == 0) | F.col("hit")).select("unit", "entity")


def ordered_features(pairs: DataFrame, priority: list[str], most: int = 16) -> DataFrame:
    """doc_id, key, value of pairs (doc_id, pos, key, value): keys by priority, then by first place; the first `most`
    distinct keys with all their values."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("key")), F.lit(0)), F.lit(len(priority) + 1))
    rows = pairs.withColumn("_at", F.struct(rank.alias("p"), F.min("pos").over(Window.partitionBy("doc_id", "key")).alias("f")))
    return rows.withColumn("_k", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_at"))).filter(F.col("_k") <= most).select("doc_id", "key", "value")
