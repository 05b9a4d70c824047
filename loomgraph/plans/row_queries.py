"""Row functions, checks and small tables of the graph over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..model import adjacency, currently_valid
from ..operators import bridges, channels, context, dense, graph, ingest, learn
from ..session import table
from ..sources import store
from .catalog import query
from .graph_queries import _PATHS, GRAPH, g
from .text_queries import TOKENS, passages, questions, vectors


@query("with" + GRAPH + " select 'node' kind, uuid, label as what from nodes union all select 'edge', uuid, name from edges")
def graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node and edge."""
    n, e = g(spark, sf_dir)
    return n.select(F.lit("node").alias("kind"), "uuid", F.element_at("labels", 1).alias("what")).unionByName(e.select(F.lit("edge").alias("kind"), "uuid", F.col("name").alias("what")))


@query("with" + GRAPH + " select pos, n.uuid, n.label, n.name from (select o_orderkey pos, 'user:' || o_custkey uuid from orders union all select -1, 'user:none') w join nodes n using (uuid)")
def nodes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes named in a list, in its order; missing ones are skipped, repeated ones come again."""
    n, _ = g(spark, sf_dir)
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("pos"), F.concat(F.lit("user:"), "o_custkey").alias("uuid"))
    wanted = wanted.union(spark.createDataFrame([(-1, "user:none")], "pos long, uuid string"))
    return graph.by_uuids(n, wanted).select("pos", "uuid", F.element_at("labels", 1).alias("label"), "name")


@query("with" + GRAPH + """, flow as (select src origin, dst nbr, uuid edge, flow_key, valid from edges where flow_key is not null union all select dst, src, uuid, flow_key, valid from edges where flow_key is not null),
p as (select a.origin n, a.valid and b.valid cur from flow a join flow b on a.nbr = b.origin and a.flow_key = b.flow_key and a.edge <> b.edge where a.origin like 'user:%')
select n, count(*) facts, count(*) filter (cur) valid_facts from p group by 1""")
def fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts of every user with those that are no longer valid, and without."""
    n, e = g(spark, sf_dir)
    rows = graph.event_paths(e, starts=graph.entities(n, labels=["USER"]).select("uuid"), history=True)
    return rows.groupBy("n").agg(F.count("*").alias("facts"), F.count_if("current").alias("valid_facts"))


@query("with" + GRAPH + "," + _PATHS + """, c as (select a.vec_id qid, b.vec_id id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id % 50 = 0 and b.vec_id in (select p_partkey from part)),
s as (select qid, 'part:' || id uuid from c qualify row_number() over (partition by qid order by score desc, id) <= 5)
select qid, n, r, m, r2, b from s join paths on n = s.uuid""")
def semantic_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts about the five parts whose vectors are nearest to a query's; a part's vector is that of its number."""
    n, e = g(spark, sf_dir)
    v = vectors(spark, sf_dir)
    goods = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    near = dense.nearest(v.join(goods, "id", "left_semi").select("id", "embedding"), v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), 5)
    return graph.tuples_of(e, near.select("qid", F.concat(F.lit("part:"), "id").alias("uuid"))).select("qid", "n", "r", "m", "r2", "b")


_NEAR = """, q as (select p_partkey qid, p_name as body from part where p_partkey % 50 = 0),
c as (select a.vec_id qid, b.vec_id id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id in (select qid from q) and b.vec_id in (select p_partkey from part)),
near as (select qid, id from c qualify row_number() over (partition by qid order by score desc, id) <= 5)"""


@query("with" + GRAPH + _NEAR + """ select qid, 'text' how, 'part:' || p_partkey id, null edge, null nbr from q join part on contains(lower(p_name || ' ' || p_type), lower(body))
union all select qid, 'vector', 'part:' || id, null, null from near
union all select distinct qid, 'node', 'part:' || id, edge, nbr from near join adj on origin = 'part:' || id and name = 'HAS' join nodes on uuid = nbr and label = 'BRAND'""")
def legacy_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that contain a part's name or whose vectors are near to its own, and the brands of these parts."""
    n, e = g(spark, sf_dir)
    p, v = table(spark, sf_dir, "part"), vectors(spark, sf_dir).select("id", "embedding")
    cards = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    asked = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").cast("long").alias("qid"), F.col("p_name").alias("text"))
    goods = p.select(F.col("p_partkey").cast("long").alias("id"))
    near = dense.nearest(v.join(goods, "id", "left_semi"), v.withColumnRenamed("id", "qid").join(asked, "qid", "left_semi"), 5).select("qid", F.concat(F.lit("part:"), "id").alias("id"))
    triples = near.select("qid", F.col("id").alias("node"), F.lit("HAS").alias("name"))
    data, related = context.retrieved(asked, cards, near, triples, n, adjacency(e), ["brand"])
    none = F.lit(None).cast("string")
    return data.select("qid", "how", "id", none.alias("edge"), none.alias("nbr")).unionByName(related.select("qid", F.lit("node").alias("how"), F.col("node").alias("id"), "edge", "nbr"))


@query("""with t as (select event_id, case when event_id % 11 = 0 then ' ' else 'user ' || user_id end s, case when event_id % 7 = 0 then null else 'USER' end st, case when event_id % 13 = 0 then '' else event_type end p, case when event_id % 17 = 0 then 'USER ' || user_id else 'k ' || (props->>'k') end o, case when event_id % 17 = 0 then 'user' else 'KEY' end ot, value / 100 score from events)
select event_id, case when trim(s) = '' or trim(o) = '' then 'missing_name' when coalesce(st, '') = '' or ot = '' then 'missing_type' when p = '' then 'missing_predicate' when lower(s) = lower(o) and lower(st) = lower(ot) then 'same_ends' when score < 0.15 then 'ungrounded' when score < 0.45 then 'ambiguous' else 'accepted' end reason from t""")
def triple_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why triples of events are rejected, doubtful or accepted."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 11 == 0, " ").otherwise(F.concat(F.lit("user "), "user_id")).alias("subject"), F.when(e % 7 != 0, "USER").alias("subject_type"), F.when(e % 13 == 0, "").otherwise(F.col("event_type")).alias("predicate"),
        F.when(e % 17 == 0, F.concat(F.lit("USER "), "user_id")).otherwise(F.concat(F.lit("k "), F.get_json_object("props", "$.k"))).alias("object"), F.when(e % 17 == 0, "user").otherwise("KEY").alias("object_type"), (F.col("value") / 100).alias("score"),
    )
    return rows.select("event_id", ingest.reason().alias("reason"))


@query("with" + GRAPH + """ select name, case when regexp_matches(name, 'OCCURRED|WITHIN') then 'context' when regexp_matches(name, 'TARGETED|AFFECTED|RESULTED') then 'spine' else 'other' end kind, regexp_matches(name, 'MADE|INITIATED|PERFORMED|EXPERIENCED|COVERED') actor, count(*) n from edges group by all""")
def leg_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges by the class of their names."""
    _, e = g(spark, sf_dir)
    return e.groupBy("name", bridges.leg_kind(F.col("name")).alias("kind"), bridges.of_class(F.col("name"), bridges.SPINE_ACTOR).alias("actor")).agg(F.count("*").alias("n"))


@query("""with p as (select p_partkey doc_id, unnest([1, 2, 3, 4, 5]) pos, unnest(['size', 'brand', 'type', 'brand', 'price']) k, unnest([p_size::varchar, p_brand, p_type, 'No ' || p_brand, null]) v from part),
r as (select *, dense_rank() over (partition by doc_id order by case k when 'type' then 1 when 'brand' then 2 else 3 end, k) kk from p where v is not null) select doc_id, k as "key", v as "value" from r where kk <= 2""")
def feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's features from their text, keys by priority, the first two keys with all of their values."""
    packed = F.concat(F.lit("Size : "), "p_size", F.lit(" | BRAND : "), "p_brand", F.lit(" | type: "), "p_type", F.lit(" | brand : No "), "p_brand", F.lit(" | price : | : x"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(text.feature_pairs(packed)).alias("pos", "f")).select("doc_id", "pos", "f.*")
    return ingest.ordered_features(rows, ["type", "brand"], 2)


@query("""select conv_id, turn, list_distinct(['session_' || x for x in regexp_extract_all('in session_' || conv_id || ' and b' || turn || '_t3, session_' || conv_id || ' again', 'session_([0-9]+)', 1)] || ['session_b' || turn || '_t3']).list_sort() sessions from conversations""")
def session_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that chunks name."""
    body = F.concat(F.lit("in session_"), "conv_id", F.lit(" and b"), "turn", F.lit("_t3, session_"), "conv_id", F.lit(" again"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(text.sessions(body)).alias("sessions"))


@query(r"""with t as (select p_partkey id, list_distinct(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) a, list_distinct(regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+')) b from part)
select id, round(case when len(list_distinct(a || b)) = 0 then 0 else len([x for x in a if list_contains(b, x)])::double / len(list_distinct(a || b)) end::double, 6) score from t""")
def name_type_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of a part's name and type."""
    words = lambda c: F.array_distinct(text.words(F.col(c)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(text.jaccard(words("p_name"), words("p_type")), 6).alias("score"))


@query("with" + TOKENS + " select term, df::bigint df, round(i.idf, 6) idf, round(i.idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 100 / avgdl)), 6) part from idf i join df using (term), stats")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Okapi weights of every term, and what three occurrences in a hundred add."""
    from ..operators import lexical

    held, stats = lexical.postings(passages(spark, sf_dir)), F.broadcast(lexical.collection(passages(spark, sf_dir)))  # one row
    rows = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats).withColumn("idf", scores.okapi_idf(F.col("n"), F.col("df")))
    return rows.select("term", "df", F.round("idf", 6).alias("idf"), F.round(scores.okapi_term(F.lit(3), F.lit(100), F.col("avgdl"), F.col("idf")), 6).alias("part"))


@query("""with c as (select p_partkey id, length(p_name) n, unnest(range(length(p_name))) i, p_name from part), b as (select id, n, i % 8 b, sum(ord(p_name[i + 1])) s from c group by all),
e as (select id, n, unnest(range(8)) b from (select distinct id, n from c)) select e.id, e.b as bucket, round(coalesce(s, 0) / e.n::double, 6) as "value" from e left join b using (id, b)""")
def fallback_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16, E5: model-free vectors of part names."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(ingest.bag_embedding(F.col("p_name"))).alias("bucket", "value"))
    return rows.select("id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


@query(r"""select item_id qid, regexp_matches(text, '(?i)\b(order(?:ing|ed)?|chronolog|sequence|walk me through|contradict|conflict(?:ing)?|inconsisten|previously|originally|before (?:the |that )?(?:update|change|extension)|first (?:said|stated|mentioned|sprint|deadline)|how many (?:weeks|days)|between .+ and |have i|did i)\b') history,
  length(text) < 80 or (len(w) > 0 and len([x for x in w if contains(lower(text), x)])::double / greatest(len(w), 1) < 0.35) lacking
from (select *, [x for x in list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) if length(x) > 3 and x not in ('the','and','for','with','from','this','that','are','was')] w from benchmark)""")
def question_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a question asks for the past, and whether its own text would do as its context."""
    q = F.col("text")
    return questions(spark, sf_dir).select("qid", channels.wants_history(q).alias("history"), channels.insufficient(q, q).alias("lacking"))


@query("""with p as (select event_id, case when value > 60 then 'Positive' when value < 20 then ' negative ' else event_type end a, case when (props->>'k')::int % 2 = 0 then 'positive' else 'NEGATIVE' end b from events),
c as (select event_id, case when lower(trim(a)) in ('positive', 'negative') then lower(trim(a)) else 'neutral' end a, lower(b) b from p) select event_id, a = b same, a <> b and a <> 'neutral' opposite from c""")
def polarity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: polarities that are the same, or opposite."""
    a = F.when(F.col("value") > 60, "Positive").when(F.col("value") < 20, " negative ").otherwise(F.col("event_type"))
    b = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "positive").otherwise("NEGATIVE")
    return table(spark, sf_dir, "events").select("event_id", channels.same_polarity(a, b, "same").alias("same"), channels.same_polarity(a, b, "opposite").alias("opposite"))


@query("""with p as (select doc_id id, quality, toxic, (doc_id % 10) / 10.0::double x from labels) select id, round(x * 1.0 + (1 - x) * 0.1 + quality * 0.01 * 0.5, 6) score, row_number() over (order by round(x * 1.0 + (1 - x) * 0.1 + quality * 0.01 * 0.5, 6) desc, id)::int rk from p qualify rk <= 50""")
def gain_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the expected gain of their classes' probabilities."""
    from ..operators import ranked

    x = (F.col("doc_id") % 10) / 10.0
    rows = table(spark, sf_dir, "labels").select(F.lit(0).alias("qid"), F.col("doc_id").alias("id"), F.array(x, 1 - x, F.col("quality") * 0.01).alias("p"))
    scored = rows.select("qid", "id", F.round(learn.class_gain(F.col("p"), [1.0, 0.1, 0.5]), 6).alias("score"))
    return ranked.top(scored, 50, ["qid"]).select("id", "score", "rk")


@query("with" + GRAPH + " select uuid, name, not valid or uuid in (select 'made:' || o_orderkey from orders where o_orderstatus = 'F') gone from edges where name <> 'HAS'")
def deprecated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of finished orders are flagged and stay; with those that have ended they aren't valid any more."""
    _, e = g(spark, sf_dir)
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("made:"), "o_orderkey").alias("uuid"))
    return ingest.deprecated(e.filter("name <> 'HAS'"), finished).select("uuid", "name", (~currently_valid()).alias("gone"))


@query("""with b as (select distinct p_brand entity, lower(p_brand) e from part), u as (select p_partkey unit, lower(p_name || ' by ' || case when p_partkey % 3 = 0 then 'nobody' else p_brand end) t from part),
x as (select unit, entity, contains(t, e) hit, max(contains(t, e)::int) over (partition by unit) as any_hit from u, b) select unit, entity from x where hit or any_hit = 0""")
def mentioned_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that a part's card names, or all of them if it names none."""
    p = table(spark, sf_dir, "part")
    card = F.concat_ws(" ", "p_name", F.lit("by"), F.when(F.col("p_partkey") % 3 == 0, "nobody").otherwise(F.col("p_brand")))
    units = p.select(F.col("p_partkey").alias("unit"), F.lit(0).alias("doc"), card.alias("text"))
    return ingest.mentioned(units, p.select(F.lit(0).alias("doc"), F.col("p_brand").alias("entity")).distinct())


@query("select 'doc' kind, 'd' || doc_id id, md5(text) digest from documents where text is not null union all select 'query', 'q' || item_id, md5(text) from benchmark")
def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and questions written as one JSON lines file and split again."""
    docs = passages(spark, sf_dir).filter("text is not null").select(F.lit("doc").alias("type"), F.concat(F.lit("d"), "id").alias("doc_id"), "text", F.lit(None).cast("string").alias("qid"), F.lit(None).cast("string").alias("query"))
    asked = questions(spark, sf_dir).select(F.lit("query").alias("type"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("q"), "qid").alias("qid"), F.col("text").alias("query"))
    path = store.shared_path(spark, "corpus")
    docs.unionByName(asked).write.json(path)
    found, queries = store.corpus(spark, path)
    return found.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.md5("text").alias("digest")).unionByName(queries.select(F.lit("query").alias("kind"), F.col("qid").alias("id"), F.md5("query").alias("digest")))
