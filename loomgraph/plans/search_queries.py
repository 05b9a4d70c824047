"""Channels, assembled searches, synergies, evaluation and streams' batch forms over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import scores, text
from ..operators import channels, dense, graph, lexical, ranked, synergy
from ..session import table
from .catalog import query
from .graph_queries import GRAPH, g
from .text_queries import BM25, OVERLAP, TOKENS, _RRF, bm25_lists, overlap_lists, passages, questions, vectors


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name as a query."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    return p.select(F.col("text").alias("qid"), "text")


_NAMED = """
q as (select distinct p_name qid, [t for t in list_distinct(regexp_extract_all(lower(trim(p_name)), '[a-z0-9]{3,}')) if t <> lower(trim(p_name))] toks from part),
s as (select qid, 'part:' || p_partkey id, p_type, p_retailprice,
  case when lower(p_name) = qid then 5.0 when contains(lower(p_name), qid) then 3.0 else 0 end + len([t for t in toks if contains(lower(p_name), t)])
  + case when len(toks) > 0 then len([t for t in toks if contains(lower(p_name), t)])::double / len(toks) else 0 end
  + case when len(toks) = 2 and contains(lower(p_name), qid) then 0.75 else 0 end score,
  len([t for t in toks if contains(lower(p_name), t)]) hits from q, part)"""


@query("with" + _NAMED + " select qid, id, round(score::double, 6) score, row_number() over (partition by qid order by round(score::double, 6) desc, id)::int rk from s where hits > 0 or score > 0 qualify rk <= 10")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by the likeness of their names."""
    asked = names(spark, sf_dir).select("qid", text.graph_tokens(F.col("text")).alias("tokens"))
    goods = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), "p_name")
    needles = asked.select("qid", F.explode(F.concat(F.array("qid"), "tokens")).alias("needle"))
    rows = lexical.holding(goods.withColumnRenamed("p_name", "text"), needles).join(goods, "id").join(asked, "qid")
    return ranked.top(rows.select("qid", "id", F.round(text.name_score(F.col("qid"), F.col("tokens"), F.col("p_name")), 6).alias("score")), 10, ["qid"])


@query()
def entity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, token and BM25 branches, the best score of each node."""
    n, _ = g(spark, sf_dir)
    return channels.entities(n, names(spark, sf_dir), 10, ["PRODUCT"])


@query()
def community_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of hubs that match a brand's or category's name."""
    n, e = g(spark, sf_dir)
    hubs = graph.entities(n, labels=["BRAND", "CATEGORY"]).select(F.col("name").alias("qid"), F.col("name").alias("text"))
    return channels.communities(n, e, model.adjacency(e), hubs, ["BRAND", "CATEGORY"], 10)


@query("with" + GRAPH + """, d as (select origin uuid, count(*) degree from adj group by 1),
s as (select 'part:' || p_partkey id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r, p_brand qid, 'part:' || p_partkey seed, p_retailprice from part),
hop as (select s.qid, s.seed, a.nbr, m.label from s join adj a on a.origin = s.seed and a.valid join nodes m on m.uuid = a.nbr where r = 1),
ways as (select qid, seed, nbr, 1 way from hop where label <> 'EVENT' union all select qid, seed, a.nbr, 0 from hop h join adj a on a.origin = h.nbr and a.valid join nodes m on m.uuid = a.nbr where h.label = 'EVENT' and m.label <> 'EVENT'),
f as (select qid, seed, nbr, min(way) way from ways where seed <> nbr group by 1, 2, 3), c as (select *, row_number() over (partition by seed order by way, nbr) k from f qualify k <= 50),
b as (select qid, nbr id, round(max(p_retailprice / log2(2 + degree)), 6) score from c join s using (qid, seed) join d on d.uuid = seed group by 1, 2)
select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from b qualify rk <= 10""")
def expansion_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each brand's dearest product."""
    n, e = g(spark, sf_dir)
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    best = table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).filter("r = 1")
    seeds = best.select(F.col("p_brand").alias("qid"), F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return channels.expansion(n, e, model.adjacency(e), seeds, 10)


@query("with" + BM25 + "," + OVERLAP + "," + _RRF + """, rkd as (select qid, id, row_number() over (partition by qid order by score desc, pos, id)::int rk from fused)
select r.qid, r.id, r.rk, list_sort(list_filter([case when b.rk is not null then 'bm25' end, case when o.rk is not null then 'overlap' end], lambda x: x is not null)) channels
from rkd r left join bm b on b.qid = r.qid and b.id = r.id left join ov o on o.qid = r.qid and o.id = r.id where r.rk <= 8""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with the channels that found them."""
    return channels.assembled({"bm25": bm25_lists(spark, sf_dir), "overlap": overlap_lists(spark, sf_dir)}, 8)


@query("with" + BM25 + """, pref as (select b.qid, b.id, count(*)::double pref from bm b join documents d on d.doc_id = b.id join labels l on l.doc_id = d.doc_id where quality = 1 group by 1, 2),
sh as (select item_id qid, 0.4::double s from benchmark), m as (select b.*, coalesce(pref, 0) pref, s from bm b left join pref using (qid, id) join sh using (qid)),
x as (select qid, id, rk, s, max(pref) over w <= 0 off, round((1 - s) * case when max(score) over w <= min(score) over w then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end + s * case when max(pref) over w <= min(pref) over w then 0 else (pref - min(pref) over w) / (max(pref) over w - min(pref) over w) end, 6) blend from m window w as (partition by qid))
select qid, id, rk, row_number() over (partition by qid order by case when off then 0 else blend end desc, rk)::int new_rk, blend from x""")
def personalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference for labelled quality blended in; hits are reordered, never dropped."""
    hits = bm25_lists(spark, sf_dir)
    liked = table(spark, sf_dir, "labels").filter("quality = 1").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").cast("double").alias("pref"))
    share = questions(spark, sf_dir).select("qid", F.lit(0.4).alias("s"))
    return ranked.blend(hits, hits.select("qid", "id").join(liked, "id").select("qid", "id", "pref"), share)


@query(r"select item_id qid, case when regexp_matches(text, '[0-9]') then 0.0 when n = 0 then 0.0 when n = 1 then 0.85 when n = 2 then 0.5 when n = 3 then 0.25 else 0.1 end::double share from (select *, len(regexp_extract_all(lower(text), '[a-z0-9]+')) n from benchmark)")
def personal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far preferences count for a query."""
    return questions(spark, sf_dir).select("qid", scores.personal_share(F.col("text")).alias("share"))


@query()
def context_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of query variants, fused."""
    return channels.passages_by_variants(passages(spark, sf_dir), questions(spark, sf_dir), 10)


@query("""with pairs as (select a.vec_id a, b.vec_id b, a.label la, b.label lb, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) s from embeddings a, embeddings b where a.vec_id <> b.vec_id),
k as (select a, b, s, row_number() over (partition by a order by s desc, b) r from pairs qualify r <= 3), adj as (select a, b from k union select b, a from k),
c as (select embedding::double[] v, vec_id from embeddings), s1 as (select x.a qid, x.b id, 1 hops from adj x), s2 as (select s1.qid, y.b id, 2 hops from s1 join adj y on y.a = s1.id),
f as (select qid, id, min(hops)::int hops from (select * from s1 union all select * from s2) where id <> qid group by 1, 2)
select qid, id, hops, round(list_cosine_similarity(q.v, e.v), 6) score from f join c q on q.vec_id = qid join c e on e.vec_id = id where round(list_cosine_similarity(q.v, e.v), 6) >= 0.1""")
def second_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of neighbours in the nearest-vector graph, pruned by cosine."""
    v, adj = _vector_graph(spark, sf_dir)
    seeds = v.select(F.col("id").alias("qid"), "id")
    return synergy.second_degree(seeds, adj, v.select("id", "embedding"), 0.1)


def _vector_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    near = dense.nearest(v.select("id", "embedding"), v.select(F.col("id").alias("qid"), "embedding"), 3, skip_self=True)
    links = near.select(F.col("qid").alias("origin"), F.col("id").alias("nbr"))
    return v, links.union(links.select("nbr", "origin")).distinct()


@query()
def synergies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-SYN, M11, M12: siblings over shared seeds in the nearest-vector graph."""
    v, adj = _vector_graph(spark, sf_dir)
    targets = v.select(F.col("id").alias("target"))
    similar = dense.nearest(v.select("id", "embedding"), v.select(F.col("id").alias("qid"), "embedding"), 2, least=0.3, skip_self=True).select(F.col("qid").alias("seed"), F.col("id").alias("like"))
    return synergy.synergies(targets, adj, v.select("id", "embedding"), similar, 10)


# -- evaluation


@query("with" + BM25 + "," + OVERLAP + """, a as (select item_id qid, coalesce((select count(*) from bm join labels on doc_id = id and quality = 1 where qid = item_id), 0) > 2 a, coalesce((select count(*) from ov join labels on doc_id = id and quality = 1 where qid = item_id), 0) > 2 b from benchmark)
select count(*) n, count(*) filter (a) right_a, count(*) filter (b) right_b, count(*) filter (a and not b) lost, count(*) filter (b and not a) won from a""")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms over common questions, and their flips."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    arm = lambda rows, name: rows.join(good, "id").groupBy("qid").agg((F.count("*") > 2).alias(name))
    rows = questions(spark, sf_dir).select("qid").join(arm(bm25_lists(spark, sf_dir), "a"), "qid", "left").join(arm(overlap_lists(spark, sf_dir), "b"), "qid", "left").na.fill(False)
    c = F.count_if
    return rows.agg(F.count("*").alias("n"), c("a").alias("right_a"), c("b").alias("right_b"), c(F.col("a") & ~F.col("b")).alias("lost"), c(F.col("b") & ~F.col("a")).alias("won"))


@query("with" + BM25 + """, need as (select qid, list(distinct source) ss from bm join documents on doc_id = id join labels using (doc_id) where quality = 1 group by 1), got as (select qid, list(distinct source) gs from bm join documents on doc_id = id where rk <= 5 group by 1)
select qid, case when len(ss) = len(list_intersect(ss, coalesce(gs, []))) then 'full' when len(list_intersect(ss, coalesce(gs, []))) > 0 then 'partial' else 'none' end coverage from need left join got using (qid)""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needed groups against those retrieved."""
    rows = bm25_lists(spark, sf_dir).join(passages(spark, sf_dir).select("id", "source"), "id")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    need = rows.join(good, "id", "left_semi").groupBy("qid").agg(F.collect_set("source").alias("need"))
    got = rows.filter("rk <= 5").groupBy("qid").agg(F.collect_set("source").alias("got"))
    both = need.join(got, "qid", "left")
    n = F.size(F.array_intersect("need", F.coalesce("got", F.array().cast("array<string>"))))
    return both.select("qid", F.when(n == F.size("need"), "full").when(n > 0, "partial").otherwise("none").alias("coverage"))


@query("""with a as (select lang ability, source, avg(quality) m from labels join documents using (doc_id) group by 1, 2) select ability, round(avg(m), 6) mean from a group by rollup (ability)""")
def ability_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of means."""
    rows = table(spark, sf_dir, "labels").join(passages(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("lang").alias("ability"), "source"), "doc_id")
    return rows.groupBy("ability", "source").agg(F.avg("quality").alias("m")).rollup("ability").agg(F.round(F.avg("m"), 6).alias("mean"))


@query("""with r as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) x, value y from events), p as (select a.user_id, sum(sign(b.x - a.x) * sign(b.y - a.y)) s, sum(case when a.y = b.y then 1 else 0 end) ty, count(*) n from r a join r b on a.user_id = b.user_id and a.x < b.x group by 1)
select user_id, round((s / sqrt(n::double * (n - ty)) + 1) / 2, 6) score from p where n > ty""")
def ordering_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of two orders, rescaled to 0..1, by counts of inversions."""
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("user_id").alias("key"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("x"), F.col("value").alias("y"))
    return ranked.kendall(r).filter("tau is not null").select(F.col("key").alias("user_id"), F.round((F.col("tau") + 1) / 2, 6).alias("score"))


@query("""select window_start, event_type, count(*) n, round(sum(value), 6) total from (select time_bucket(interval 1 day, ts) window_start, event_type, value from events) group by 1, 2""")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z2 in batch: tumbling windows by behaviour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""with l as (select l_orderkey o, list(distinct p_brand) bs, count(distinct p_type) types from lineitem join part on p_partkey = l_partkey group by 1) select l_orderkey as list_id, round(avg(1 - (case when a.p_brand = b.p_brand then 1 else 0 end + case when a.p_type = b.p_type then 1 else 0 end)::double / (4 - (case when a.p_brand = b.p_brand then 1 else 0 end + case when a.p_type = b.p_type then 1 else 0 end))), 6) diversity
from (select distinct l_orderkey, p_partkey, p_brand, p_type from lineitem join part on p_partkey = l_partkey) a join (select distinct l_orderkey, p_partkey, p_brand, p_type from lineitem join part on p_partkey = l_partkey) b using (l_orderkey) where a.p_partkey < b.p_partkey group by 1""")
def list_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29, G-SYNM: mean distance of the items of each order's list."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("list_id"), "p_partkey", F.array("p_brand", "p_type").alias("labels")).distinct()
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.list_id") == F.col("b.list_id")) & (F.col("a.p_partkey") < F.col("b.p_partkey")))
    return pairs.groupBy(F.col("a.list_id").alias("list_id")).agg(F.round(F.avg(1 - text.jaccard(F.col("a.labels"), F.col("b.labels"))), 6).alias("diversity"))
