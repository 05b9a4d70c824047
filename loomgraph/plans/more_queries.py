"""Context facts, entity views, learning to rank and further functions over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import names as nm
from ..functions import scores, text
from ..operators import bridges, context, graph, learn, lexical, pagerank, ranked, synergy
from ..operators.recommend import mmr
from ..session import table
from ..sources import store
from .catalog import query
from .graph_queries import GRAPH, _PATHS, g
from .ingest_queries import _members
from .search_queries import _NAMED, _vector_graph, name_matches
from .search_queries import names as _names
from .text_queries import BM25, OVERLAP, TOKENS, bm25_lists, gains, overlap_lists, passages, questions, vectors

_FACTS = "with" + GRAPH + "," + _PATHS + "," + _NAMED + """,
seeds as (select qid, id, round(1 / (1 + round(score::double, 6)), 3) dist from (select *, row_number() over (partition by qid order by round(score::double, 6) desc, id) rk from s where hits > 0 or score > 0) where rk <= 5),
c as (select qid, r, m, r2, n, p.b, dist, happened_at from seeds join paths p on p.b = seeds.id join nodes h on h.uuid = p.m where p.n like 'user:%'),
v as (select *, round(0.45 / (1 + dist) + 0.20 * 3.65 / 3.8 + 0.10 / (1 + greatest(0, epoch_us(timestamp '2024-06-30') - epoch_us(happened_at)) / 86400e6), 6) relevance from c)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, n, r, m, r2, b, dist, relevance: facts about the five best products of each query."""
    n, e = g(spark, sf_dir)
    seeds = name_matches(spark, sf_dir).filter("rk <= 5").select("qid", F.col("id").alias("b"), F.round(1 / (1 + F.col("score")), 3).alias("dist"))
    paths = graph.event_paths(e, starts=graph.entities(n, labels=["USER"]).select("uuid"))
    dated = n.select(F.col("uuid").alias("m"), "happened_at", F.array_contains("labels", "EVENT").alias("is_event"))
    rows = paths.join(seeds, "b").join(dated, "m")
    return rows.select("qid", "n", "r", "m", "r2", "b", "dist", F.round(_relevance(F.col("r_name")), 6).alias("relevance"), "r2_name")


def _relevance(leg: Column) -> Column:
    """Of rows with dist, is_event, r2_name and happened_at, without walked mass and topic."""
    whole = bridges.completeness(F.col("is_event"), leg, F.col("r2_name"), F.lit(True), F.col("happened_at").isNotNull())
    return scores.relevance(F.col("dist"), F.lit(0.0), whole, scores.recency(F.col("happened_at"), F.lit("2024-06-30").cast("timestamp")), F.lit(0.0))


@query(_FACTS + " select qid, r, r2, m, relevance, row_number() over (partition by qid order by relevance desc, dist, m, r, r2)::int rk from v qualify rk <= 20")
def fact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts ranked by relevance."""
    w = Window.partitionBy("qid").orderBy(F.desc("relevance"), "dist", "m", "r", "r2")
    return facts(spark, sf_dir).withColumn("rk", F.row_number().over(w)).filter("rk <= 20").select("qid", "r", "r2", "m", "relevance", "rk")


@query()
def context_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by distance, walked mass, completeness and age, joined by facts of hubs that share an
    entity with the query's nearest hubs, and chosen so that hubs and users vary."""
    return bridges.diversified(_context_pool(spark, sf_dir), 8)


def _context_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, id, score, hub, sessions, kind, bridge."""
    own = facts(spark, sf_dir).withColumn("id", F.concat_ws("|", "r", "r2"))
    own = store.written(own.withColumns({"w1": bridges.leg_weight(F.lit("MADE")), "w2": bridges.leg_weight(F.col("r2_name")), "seed": F.col("b")}))
    mass = pagerank.fact_masses(own.select("qid", "id", "n", "m", "b", "w1", "w2", "seed", "dist"), store.written)
    scored = own.join(mass, ["qid", "id"], "left").withColumn("score", F.round(F.col("relevance") + 0.25 * F.coalesce("mass", F.lit(0.0)), 6))
    shape = lambda rows, bridge: rows.select("qid", "id", "score", F.col("m").alias("hub"), F.array("n").alias("sessions"), bridges.leg_kind(F.col("r2_name")).alias("kind"), F.lit(bridge).alias("bridge"))
    # the twelve nearest hubs of a query, their neighbours through customers or parts, and what happened there
    hubs = own.groupBy("qid", F.col("m").alias("hub")).agg(F.min("dist").alias("dist"))
    hubs = store.written(ranked.top(hubs.withColumn("near", -F.col("dist")), 12, ["qid"], score="near", tie="hub").select("qid", "hub", "dist", F.col("rk").alias("at")))
    members = _members(spark, sf_dir)
    shared = members.join(hubs.select(F.col("hub").alias("event")).distinct(), "event").select(F.col("event").alias("hub"), "entity")
    nbrs = shared.join(members.select("entity", F.col("event").alias("nbr")), "entity").filter("hub <> nbr").groupBy("hub", "nbr").agg(F.min("entity").alias("entity"))
    n, e = g(spark, sf_dir)
    known = store.written(graph.event_paths(e, starts=graph.entities(n, labels=["USER"]).select("uuid")).select("n", "m", "r", "r2", "b", "r2_name"))
    users = known.groupBy(F.col("m").alias("nbr")).agg(F.array_sort(F.collect_set("n")).alias("sessions"))
    pool = hubs.join(nbrs, "hub").join(users, "nbr").select("qid", "at", "hub", "nbr", F.lit(1.0).alias("weight"), "sessions")
    chosen = bridges.novel_neighbours(pool)
    there = known.select(F.col("m").alias("hub"), F.concat_ws("|", "r", "r2").alias("id"))
    found = bridges.bridge_facts(chosen, hubs.select("qid", "hub", "dist"), there, own.select("qid", "id"))
    dated = n.select(F.col("uuid").alias("m"), "happened_at", F.array_contains("labels", "EVENT").alias("is_event"))
    more = found.select("qid", "id", F.col("score").alias("dist")).join(known.withColumn("id", F.concat_ws("|", "r", "r2")), "id").join(dated, "m")
    more = more.withColumn("score", F.round(_relevance(F.lit("MADE")), 6))
    return shape(scored, False).unionByName(shape(more, True))


@query("with" + BM25.replace("rk <= 10", "rk <= 24") + """, t as (select qid, id, rk, greatest(1, length(coalesce(text, '')) // 4)::bigint tokens from bm join documents d on d.doc_id = bm.id),
u as (select *, sum(tokens) over (partition by qid order by rk, id rows unbounded preceding)::bigint used from t)
select qid, id, rk, tokens, used from u where rk <= 16 and (used <= 4000 or rk = 1)""")
def context_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's best passages under a budget of tokens."""
    hits = bm25_lists(spark, sf_dir, k=24).join(passages(spark, sf_dir).select("id", text.token_estimate(F.col("text")).alias("tokens")), "id")
    return context.packed(hits.select("qid", "id", "rk", "tokens"), 4000).withColumn("used", F.col("used").cast("long"))


@query()
def context_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R23, R24, A17, G-PATH, G-TSEL, F26: contexts of product names: passages from product cards and documents under a
    budget, asked again where they don't suffice, with facts, topics, conflicts and paths; tests hold the passes against
    plain Python."""
    p = table(spark, sf_dir, "part")
    cards = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), text.product_text({"Title": F.col("p_name"), "Brand": F.col("p_brand"), "Type": F.col("p_type")}).alias("text"))
    texts = cards.unionByName(passages(spark, sf_dir).select(F.concat(F.lit("doc:"), "id").alias("id"), "text"))
    index = lexical.Index(texts, store.shared_path(spark, "index"), "english")
    w = Window.partitionBy("qid").orderBy(F.desc("relevance"), "dist", "m", "r", "r2")
    best = facts(spark, sf_dir).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= context.FACTS)
    dated = best.join(g(spark, sf_dir)[0].select(F.col("uuid").alias("m"), "happened_at"), "m")
    lines = dated.select("qid", "rk", F.concat_ws(" ", "n", F.lit("MADE"), "m", "r2_name", "b").alias("text"), F.col("m").alias("hub"), F.array("n", "b").alias("entities"), F.col("b").alias("entity"), F.col("happened_at").alias("at"))
    members = p.select(F.concat(F.lit("topic:"), "p_brand").alias("topic"), F.concat_ws(" ", "p_brand", "p_name").alias("label"), F.concat(F.lit("part:"), "p_partkey").alias("session"))
    asked = _names(spark, sf_dir)
    seeds = lines.groupBy("qid", F.col("entity").alias("session")).agg(F.min("rk").alias("rk"))
    topics = bridges.select_topics(asked, members, seeds, 3).select("qid", F.col("topic").alias("label"), "rk")
    search = lambda queries: lexical.bm25(index, queries, 24)
    rows = context.assembled(asked, search, texts, lines, topics, 2000)
    return rows.withColumn("context_md5", F.md5("context")).withColumn("length", F.length("context").cast("long")).drop("context")


@query(_FACTS + ", x as (select distinct qid, m from v) select qid, count(*) hubs, min(m) first_hub from x group by 1")
def fact_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs of each query's facts."""
    return facts(spark, sf_dir).groupBy("qid").agg(F.countDistinct("m").alias("hubs"), F.min("m").alias("first_hub"))


@query("with" + GRAPH + ", r as (select n.uuid, count(a.edge) relations, count(distinct a.name) kinds from nodes n left join adj a on a.origin = n.uuid where n.label = 'PRODUCT' group by 1), o as (select 'part:' || l_partkey uuid, count(*) seen from lineitem where l_returnflag = 'A' group by 1) select uuid, relations, kinds, coalesce(seen, 0) observations from r left join o using (uuid)")
def entity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product with its relations and observations, those without any too."""
    n, e = g(spark, sf_dir)
    own = model.adjacency(e).groupBy(F.col("origin").alias("uuid")).agg(F.count("*").alias("relations"), F.countDistinct("name").alias("kinds"))
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").groupBy(F.concat(F.lit("part:"), "l_partkey").alias("uuid")).agg(F.count("*").alias("observations"))
    rows = graph.entities(n, labels=["PRODUCT"]).select("uuid").join(own, "uuid", "left").join(seen, "uuid", "left")
    return rows.na.fill(0).select("uuid", "relations", "kinds", "observations")


@query("with recursive walk(region, nation, depth) as (select r_regionkey, -1, 0 from region union all select w.region, n_nationkey, w.depth + 1 from walk w join nation n on n.n_regionkey = w.region where w.depth < 1) select region, depth, count(*) n from walk group by 1, 2")
def recursive_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive query as read-only SQL."""
    sql = store.ReadOnlySql(spark, {n: table(spark, sf_dir, n) for n in ("region", "nation")})
    return sql.run("with recursive walk(region, nation, depth) as (select r_regionkey, -1, 0 from region union all select w.region, n_nationkey, w.depth + 1 from walk w join nation n on n.n_regionkey = w.region where w.depth < 1) select region, depth, count(*) n from walk group by 1, 2")[0]


@query("with" + GRAPH + ", h as (select a.origin, m.label, m.uuid from adj a join nodes n on n.uuid = a.origin join nodes m on m.uuid = a.nbr where n.label = 'PRODUCT' and a.valid and m.label <> 'EVENT'), c as (select origin, label, count(*) n, min(uuid) medoid from h group by 1, 2) select origin, label, medoid, row_number() over (partition by origin order by n desc, label)::int rk from c qualify rk <= 3")
def interest_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours grouped by label, the largest groups' first members."""
    n, e = g(spark, sf_dir)
    end = n.select(F.col("uuid").alias("nbr"), F.element_at("labels", 1).alias("label"))
    rows = model.adjacency(e).filter("valid").join(graph.entities(n, labels=["PRODUCT"]).select(F.col("uuid").alias("origin")), "origin").join(end, "nbr").filter("label <> 'EVENT'")
    groups = rows.groupBy("origin", "label").agg(F.count("*").alias("n"), F.min("nbr").alias("medoid"))
    w = Window.partitionBy("origin").orderBy(F.desc("n"), "label")
    return groups.withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("origin", "label", "medoid", "rk")


@query("""select event_id, list_sort(map_keys(x)) keys, x['k'] k from (select event_id, map_from_entries([(k, v) for k, v in zip(['event_type', 'k', 'value'], [event_type, props->>'k', null])]) x from events)""".replace("map_from_entries([(k, v) for k, v in zip(['event_type', 'k', 'value'], [event_type, props->>'k', null])])", "map(['event_type', 'k'], [event_type, props->>'k'])"))
def extras_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extras without nulls, JSON values merged over them."""
    own = nm.extras({"id": F.col("event_id"), "event_type": F.col("event_type"), "value": F.lit(None).cast("string")})
    more = F.from_json("props", "map<string,string>")
    merged = nm.merged_extras(own, more)
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(F.map_keys(merged)).alias("keys"), F.element_at(merged, "k").alias("k"))


@query("select event_id, event_type from events where event_type in ('error', 'signup') and contains(props, '7') and json_valid(props)")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of given types by text in their JSON; malformed rows are passed over."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup")).filter(F.try_parse_json("props").isNotNull())
    return store.listing(rows, ["props"], "7").select("event_id", "event_type")


@query("select vec_id, label, count(*) over () total from embeddings order by vec_id limit 25 offset 50")
def vector_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by page, without their values."""
    return ranked.page(vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), "label"), [F.asc("vec_id")], 50, 25)


@query("""select c_mktsegment as label, list_sort(list(distinct n_name)) names, count(distinct r_name) regions from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1""")
def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct descriptions around an entity."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("label")).agg(F.array_sort(F.collect_set("n_name")).alias("names"), F.countDistinct("r_name").alias("regions"))


@query("with" + BM25 + "," + OVERLAP + """ select coalesce(b.qid, o.qid) qid, coalesce(b.id, o.id) id, coalesce(1.0::double / b.rk, 0) bm25_rr, coalesce(b.score, 0) bm25_score, coalesce(1.0::double / o.rk, 0) overlap_rr, coalesce(o.score, 0)::double overlap_score, (b.id is not null)::int + (o.id is not null)::int lists from bm b full join ov o on b.qid = o.qid and b.id = o.id""")
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each hit from the lists that hold it."""
    return learn.features({"bm25": bm25_lists(spark, sf_dir), "overlap": overlap_lists(spark, sf_dir)})


@query()
def learned_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise model in five folds."""
    rows = rank_features(spark, sf_dir).join(gains(spark, sf_dir), "id", "left").na.fill(0.0, ["gain"])
    return ranked.top(learn.ranknet(rows, ["bm25_rr", "bm25_score", "overlap_rr", "overlap_score", "lists"]), 10, ["qid"])


@query()
def reduced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label without near-duplicates."""
    return learn.reduced(vectors(spark, sf_dir).select(F.col("label").alias("key"), "id", "embedding"), 0.6)


@query("""select qid, id, round(s, 6) score from (select q.label qid, d.vec_id id, sum(list_cosine_similarity(q.embedding::double[], d.embedding::double[])) s from (select * from embeddings where vec_id in (select min(vec_id) from embeddings group by label)) q, embeddings d group by 1, 2)""")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim of each label's first vector, as a query of one token, against all vectors."""
    v = vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min_by("embedding", "id").alias("embedding")).select(F.col("label").alias("qid"), "embedding")
    return learn.maxsim(first, v.select("id", "embedding"))


@query("""with t as (select vec_id // 5 id, vec_id token, embedding::double[] v from embeddings),
s as (select q.id qid, q.token, d.id, max(list_cosine_similarity(q.v, d.v)) m from t q join t d on q.id % 10 = 0 group by 1, 2, 3), d as (select qid, id, round(sum(m), 6) score from s group by 1, 2)
select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from d qualify rk <= 5""")
def late_interaction_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents by MaxSim, each of five tokens, for every tenth document; bounds from lists, no cross join."""
    tokens = vectors(spark, sf_dir).select(F.expr("id div 5").alias("id"), "embedding")
    return learn.late_interaction(tokens.filter("id % 10 = 0").withColumnRenamed("id", "qid"), tokens, 5)


@query()
def best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams of three hops in the nearest-vector graph, worth by cosine."""
    v, adj = _vector_graph(spark, sf_dir)
    ids = adj.select(F.col("origin").cast("string").alias("origin"), F.col("nbr").cast("string").alias("nbr")).withColumn("edge", F.concat_ws("-", F.least("origin", "nbr"), F.greatest("origin", "nbr")))
    vec = v.select(F.col("id").cast("string").alias("v"), "embedding")
    worth = ids.join(vec.withColumnsRenamed({"v": "origin", "embedding": "a"}), "origin").join(vec.withColumnsRenamed({"v": "nbr", "embedding": "b"}), "nbr").select("edge", F.round(scores.cosine(F.col("a"), F.col("b")), 6).alias("s")).distinct()
    return synergy.best_paths(v.select(F.col("id").cast("string").alias("uuid")), ids, worth, store.written)


@query()
def diverse_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R22, G-REC: each market segment's parts, chosen so that brands and types vary."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = rows.groupBy(F.col("c_mktsegment").alias("seed"), F.col("p_partkey").cast("string").alias("id"), F.array("p_brand", "p_type").alias("labels")).agg(F.round(F.sum("l_quantity"), 6).alias("q"))
    return mmr(sums.withColumn("score", scores.min_max(F.col("q"), ["seed"])), 10)


@query(r"""select item_id qid, regexp_matches(text, '(?i)\b(select\s.+\sfrom|insert\s+into|update\s.+\sset|delete\s+from|drop\s+table)\b') looks_sql, regexp_matches(text, '&(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});') has_entities, length(text) < 80 short from benchmark""")
def query_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What queries look like."""
    return questions(spark, sf_dir).select("qid", nm.looks_like_sql(F.col("text")).alias("looks_sql"), nm.has_entities(F.col("text")).alias("has_entities"), (F.length("text") < 80).alias("short"))


@query("with" + BM25 + "," + TOKENS.strip().split("\n")[0].replace("tok as", "tk as").rstrip(",") + """, g as (select qid, list_distinct([w for w in regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}]+') if length(w) > 2]) ws, d.text from bm join benchmark b on item_id = qid join documents d on d.doc_id = id where rk = 1)
select qid, len([w for w in ws if contains(lower(text), w)]) >= 0.5 * len(ws) grounded from g""".replace("\\\\p", "\\p"))
def gold_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether half of a question's longer words stand in its first hit."""
    hits = bm25_lists(spark, sf_dir).filter("rk = 1").select("qid", "id").join(passages(spark, sf_dir).select("id", F.col("text").alias("body")), "id")
    rows = hits.join(questions(spark, sf_dir), "qid").withColumn("w", F.array_distinct(F.filter(text.words(F.col("text")), lambda w: F.length(w) > 2)))
    return rows.select("qid", (text.overlap(F.col("w"), F.col("body")) >= 0.5 * F.size("w")).alias("grounded"))


@query("with" + BM25 + "," + OVERLAP + ", a as (select qid, list_sort(list(distinct source)) s from bm join documents on doc_id = id group by 1), b as (select qid, list_sort(list(distinct source)) s from ov join documents on doc_id = id group by 1) select count(*) n, count(*) filter (a.s = b.s) same, round(avg((a.s = b.s)::int), 6) agreement from a join b using (qid)")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two runs give the same groups."""
    groups = lambda rows, name: rows.join(passages(spark, sf_dir).select("id", "source"), "id").groupBy("qid").agg(F.array_sort(F.collect_set("source")).alias(name))
    both = groups(bm25_lists(spark, sf_dir), "a").join(groups(overlap_lists(spark, sf_dir), "b"), "qid")
    same = (F.col("a") == F.col("b")).cast("int")
    return both.agg(F.count("*").alias("n"), F.sum(same).alias("same"), F.round(F.avg(same), 6).alias("agreement"))


@query("""with c as (select doc_id id, quality gain, row_number() over (order by doc_id) pos from labels), p as (select item_id qid, id, pos, gain from benchmark, c), q as (select item_id qid from benchmark order by 1 limit 10),
r as (select qid, id, gain, row_number() over (partition by qid order by pos, id) r from p where qid in (select qid from q) qualify r <= 20), f as (select *, (row_number() over (partition by id order by qid, r) = 1)::int fresh from r),
k as (select *, sum(fresh) over (order by qid, r rows unbounded preceding) docs from f) select qid, id from k where docs <= 500 and qid in (select qid from k where docs <= 500 and gain > 0)""")
def catalog_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: a sample of queries and candidates under caps, as a feature."""
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("gain"), F.col("doc_id").alias("pos"))
    return learn.sampled_catalog(questions(spark, sf_dir).select("qid"), judged, 10, 20, 500)


@query("with" + TOKENS + r""", one as (select item_id qid, unnest(list_distinct([x for x in regexp_extract_all(lower(text), '[\p{L}\p{N}]+') if length(x) >= 3 and x not in ('the','and','for','with','from','this','that','are','was')])) term from benchmark),
h as (select qid, term, p.id, row_number() over (partition by qid, term order by p.id desc) r from one join post p using (term) qualify r <= 5), n as (select qid, id, count(*) score from h group by 1, 2) select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from n qualify rk <= 10""")
def literal_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest passages of each token, ranked by how many tokens they hold."""
    terms = questions(spark, sf_dir).select("qid", F.explode(text.hybrid_tokens(F.col("text"))).alias("term"))
    held = passages(spark, sf_dir).select("id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    w = Window.partitionBy("qid", "term").orderBy(F.desc("id"))
    newest = held.join(terms, "term").withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return ranked.top(newest.groupBy("qid", "id").agg(F.count("*").alias("score")), 10, ["qid"])


@query("""select event_type name_key, count(*) n, max(length(props)) longest from events group by 1""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of several chunks merged, the longest description kept."""
    from ..operators import ingest

    rows = table(spark, sf_dir, "events").select(F.upper("event_type").alias("name"), F.lit("KIND").alias("type"), F.lit(None).cast("string").alias("happened_at"), F.col("props").alias("description"))
    return ingest.longest_description(rows).select("name_key", "n", F.length("description").cast("long").alias("longest"))


_VECTOR_GRAPH = """with pairs as (select a.vec_id a, b.vec_id b, b.label lb, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) s from embeddings a, embeddings b where a.vec_id <> b.vec_id),
k as (select a, b, row_number() over (partition by a order by s desc, b) r from pairs qualify r <= 3), adj as (select a, b from k union select b, a from k)"""


@query(_VECTOR_GRAPH + """, sim as (select a, b from pairs where s >= 0.3 qualify row_number() over (partition by a order by s desc, b) <= 5), kinds as (select distinct adj.a main, label from adj join embeddings on vec_id = adj.b),
far as (select distinct adj.a main, x.b id from adj join sim on sim.a = adj.b join adj x on x.a = sim.b where x.b <> adj.a)
select main, id from far join embeddings on vec_id = id where (main, label) in (select (main, label) from kinds)""")
def neighbours_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of what is similar to an entity's neighbours, of the kinds of its own."""
    from ..operators import dense

    v, adj = _vector_graph(spark, sf_dir)
    similar = dense.nearest(v.select("id", "embedding"), v.select(F.col("id").alias("qid"), "embedding"), 5, least=0.3, skip_self=True).select(F.col("qid").alias("near"), F.col("id").alias("like"))
    one = adj.select(F.col("origin").alias("main"), F.col("nbr").alias("near"))
    kinds = one.join(v.select(F.col("id").alias("near"), "label"), "near").select("main", "label").distinct()
    far = one.join(similar, "near").join(adj.select(F.col("origin").alias("like"), F.col("nbr").alias("id")), "like").filter("main <> id").select("main", "id").distinct()
    return far.join(v.select("id", "label"), "id").join(kinds, ["main", "label"], "left_semi").select("main", "id")


@query("""with w as (select 'user:' || o_custkey src, 'part:' || l_partkey dst, o_orderkey seq, o_orderstatus st from orders join lineitem on l_orderkey = o_orderkey), k as (select src || '-BOUGHT-' || dst uuid, src, dst, max(seq) seq from w group by all)
select uuid, src, dst, seq::varchar last_order from k""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without an id merged by their ends, the last properties kept."""
    from ..operators import ingest

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    writes = rows.select(F.lit(None).cast("string").alias("uuid"), F.concat(F.lit("user:"), "o_custkey").alias("src"), F.lit("BOUGHT").alias("name"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.col("o_orderkey").alias("seq"), F.create_map(F.lit("order"), F.col("o_orderkey").cast("string")).alias("properties"))
    return ingest.merged_edges(writes).select("uuid", "src", "dst", F.element_at("properties", "order").alias("last_order"))


@query(r"""with m as (select conv_id::varchar as session, 'role ' || min(text) label from conversations group by 1), q as (select item_id qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) q from benchmark),
sd as (select item_id qid, item_id::varchar as session from benchmark where item_id in (select conv_id from conversations)),
p as (select qid, session topic, round((0.7 * len([w for w in q if list_contains(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]{3,}')), w)]) / greatest(len(q), 1) + case when (qid, session) in (select (qid, session) from sd) then 0.3 else 0 end)::double, 6) score, exists (select 1 from sd where sd.qid = q.qid) seeded from q, m),
r as (select *, row_number() over (partition by qid order by score desc, topic)::int rk from p qualify rk <= 10) select qid, topic, score, rk from r where score > 0 or seeded""")
def topic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-TSEL: topics by words in their labels and by seed sessions; each conversation is a topic of its own here."""
    c = table(spark, sf_dir, "conversations")
    members = c.groupBy(F.col("conv_id").cast("string").alias("session")).agg(F.concat(F.lit("role "), F.min("text")).alias("label")).withColumn("topic", F.col("session"))
    seeds = questions(spark, sf_dir).join(c.select(F.col("conv_id").alias("qid")).distinct(), "qid").select("qid", F.col("qid").cast("string").alias("session"), F.lit(1).alias("rk"))
    return bridges.select_topics(questions(spark, sf_dir), members, seeds)
