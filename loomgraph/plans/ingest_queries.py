"""Ingest, temporal truth, bridges, topics, dates and text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, scores, text
from ..operators import bridges, dense, ingest, ranked
from ..session import table
from ..sources import store
from .catalog import query
from .graph_queries import GRAPH
from .text_queries import passages, vectors


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


END = "2024-01-31"


@query(f"""with w as (select user_id, event_type, case event_type when 'purchase' then 1.0 else 0.2 end * 0.5 ** (greatest(0, epoch_us(timestamp '{END}') - epoch_us(ts)) / 86400e6 / 14) w from events)
select user_id, event_type, count(*) n, round(sum(w), 6) weight from w group by 1, 2""")
def behaviour_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M9, A10: decayed behaviour weights by user."""
    w = scores.behaviour_weight(F.col("event_type")) * scores.half_life(F.col("ts"), F.lit(END).cast("timestamp"), 14.0)
    return events(spark, sf_dir).withColumn("w", w).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))


@query(f"""select event_id, round(1 / (1 + greatest(0, epoch_us(timestamp '{END}') - epoch_us(ts)) / 86400e6), 6) recent, round(1 / (1 + ln(1 + greatest(0, epoch_us(timestamp '{END}') - epoch_us(ts)) / 86400e6)), 6) log_recent from events""")
def recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: both recency scores."""
    as_of = F.lit(END).cast("timestamp")
    return events(spark, sf_dir).select("event_id", F.round(scores.recency(F.col("ts"), as_of), 6).alias("recent"), F.round(scores.log_recency(F.col("ts"), as_of), 6).alias("log_recent"))


@query("""with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 21600e6 then 0 else 1 end fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) no from g)
select user_id, min(ts) started, count(*) n, round(sum(value), 6) total from s group by user_id, no""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3 in batch: sessions of a user's events, six hours apart."""
    rows = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", "total")


@query("""with r as (select user_id, event_type, event_id, ts, (props->>'k')::int k, lead((props->>'k')::int) over w nk, lead(ts) over w nt from events window w as (partition by user_id, event_type order by ts, event_id)),
c as (select *, case when nk <> k then nt end step from r)
select event_id, k, first_value(step ignore nulls) over (partition by user_id, event_type order by ts, event_id rows between current row and unbounded following) invalid_at from c""")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact lapses when the same subject and type get another value."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("int").alias("object"), F.col("ts").alias("valid_at"), F.col("event_id").alias("uuid"))
    return ingest.superseded(rows).select("event_id", F.col("object").alias("k"), "invalid_at")


@query("""with w as (select p_brand uuid, p_partkey seq, p_type d from part), k as (select uuid, d, min(seq) seq from w group by 1, 2)
select uuid, (select count(*) from w x where x.uuid = k.uuid)::bigint writes, count(*)::bigint kinds from k group by 1""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's writes merged; its aliases are the kinds it was written with, in order."""
    p = table(spark, sf_dir, "part")
    none = F.create_map().cast("map<string,string>")
    writes = p.select(F.col("p_brand").alias("uuid"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("name"), F.lit("made by").alias("description"), F.array(F.lit("BRAND")).alias("labels"), none.alias("properties"), F.array("p_type").alias("aliases"))
    counts = p.groupBy(F.col("p_brand").alias("uuid")).agg(F.count("*").alias("writes"))
    return ingest.merged_nodes(writes).join(counts, "uuid").select("uuid", "writes", F.size("aliases").cast("long").alias("kinds"))


@query("""select o_custkey uuid, arg_max(o_orderkey, (o_orderstatus <> 'F', o_orderkey)) o_orderkey, arg_max(o_orderstatus, (o_orderstatus <> 'F', o_orderkey)) o_orderstatus from orders group by 1""")
def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are written to a table, then the others over them; the last writer wins."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uuid"), "o_orderkey", "o_orderstatus")
    sink = store.Sink(spark, store.shared_path(spark, "sink"))
    last = lambda old, new: store.upsert(old, new, "uuid", "o_orderkey")
    sink.write(rows.filter("o_orderstatus = 'F'"), last)
    return sink.write(rows.filter("o_orderstatus <> 'F'"), last)


@query("""select event_id::varchar item_id, user_id::varchar user_id, event_type behavior, value from events where event_type <> 'error'""")
def json_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions as JSON lines, written and read back; lines that lack a required field go."""
    path = store.shared_path(spark, "lines")
    rows = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("item_id"), F.col("user_id").cast("string").alias("user_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("behavior"), "value")
    rows.write.json(path)
    return store.json_lines(spark, path, "item_id string, user_id string, behavior string, value double", ["user_id", "item_id", "behavior"])


@query("""select o_custkey::varchar query, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int pos, o_orderkey::varchar wid, o_orderstatus label, 'p ' || replace(o_orderpriority, '-', ' ') terms from orders""")
def packed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated log with packed lists and terms, written and unpacked."""
    path = store.shared_path(spark, "log")
    one = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.replace(F.concat(F.lit("p\x18\x18"), F.replace("o_orderpriority", F.lit("-"), F.lit("\x18"))), F.lit("_"), F.lit("-")).alias("terms"))))
    join = lambda name: F.array_join(F.transform("r", lambda x: x[name].cast("string")), "_").alias
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("query")).agg(one.alias("r"))
    rows.select("query", join("o_orderkey")("wid"), join("o_orderstatus")("label"), join("terms")("terms")).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    log = store.tab_separated(spark, path, "query string, wid string, label string, terms string")
    return store.packed(log, ["wid", "label", "terms"]).withColumn("terms", store.packed_terms(F.col("terms")))


@query("""select o_custkey::varchar user_id, o_orderkey::varchar item_id, round(o_totalprice, 2) rating, epoch(o_orderdate)::bigint unix_s from orders""")
def rating_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating file without header, written and read as interactions."""
    path = store.shared_path(spark, "ratings")
    table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).write.option("sep", "\t").csv(path)
    return store.ratings(spark, path).select("user_id", "item_id", "rating", F.unix_timestamp("ts").alias("unix_s"))


@query("""with pairs as (select a.vec_id q, b.vec_id id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) s, a.label ql, b.label bl from embeddings a, embeddings b where a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by q order by s desc, id) rk from pairs qualify rk <= 5),
t as (select q, id, s, lead(s) over (partition by q order by s desc, id) s2, row_number() over (partition by q order by s desc, id) r from k where ql = bl and s >= 0.3)
select vec_id::varchar as key, case when id is not null then id::varchar end as match, case when id is not null then 'vector' else 'new' end how
from embeddings left join (select * from t where r = 1 and (s2 is null or round(s - s2, 6) >= 0.02)) on q = vec_id""")
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest entity of the same type, unless a second is as near."""
    v = vectors(spark, sf_dir)
    near = dense.nearest(v.select("id", "embedding"), v.select(F.col("id").alias("qid"), "embedding"), 5, skip_self=True)
    named = lambda k: v.select(F.col("id").cast("string").alias(k), F.concat(F.lit(f"{k} "), "id").alias("name"), F.col("label").cast("string").alias("type"))
    new = named("key").withColumn("uuid", F.concat(F.lit("new-"), "key"))
    return ingest.resolved(new, named("uuid"), near.select(F.col("qid").cast("string").alias("key"), F.col("id").cast("string").alias("uuid"), F.col("score").alias("sim")), least=0.3)


@query("""select p_partkey::varchar doc_id, kind, value, 'hub:' || kind || ':' || regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g') hub from part, unnest([{kind: 'brand', value: p_brand}, {kind: 'class', value: p_type}, {kind: 'size', value: p_size::varchar}]) t(x), unnest([x.kind]) k(kind), unnest([x.value]) v(value)""")
def catalog_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS triples of every part."""
    rows = table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey").cast("string"))
    return ingest.catalog_triples(rows, {"brand": F.col("p_brand"), "class": F.col("p_type"), "size": F.col("p_size")}).select("doc_id", "kind", "value", "hub")


@query("""with s as (select user_id, props, event_type, ts, row_number() over (partition by user_id order by ts, event_id::varchar, event_type) seq, event_id from events)
select 'evt:' || user_id || ':' || lower(e) || ':' || seq flow_key, e event_name, case l when 0 then 'MADE' else 'TARGETED' end as name, case l when 0 then 'user:' || user_id else 'evt:' || user_id || ':' || lower(e) || ':' || seq end src, case l when 0 then 'evt:' || user_id || ':' || lower(e) || ':' || seq else event_id::varchar end dst
from s, (select unnest([0, 1]) l), lateral (select case event_type when 'purchase' then 'PURCHASED' when 'click' then 'CLICKED' when 'view' then 'VIEWED' else upper(event_type) end e)""")
def interaction_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MADE and TARGETED legs of every event."""
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("string").alias("item_id"), F.col("event_type").alias("behavior"), "ts")
    return ingest.interaction_triples(rows, {"purchase": "PURCHASED", "click": "CLICKED", "view": "VIEWED"}).select("flow_key", "event_name", "name", "src", "dst")


_BRIDGE = GRAPH + """,
legs as (select dst event, src entity from edges where name = 'MADE' union all select src, dst from edges where name = 'TARGETED'),
mem as (select entity, event from legs group by 1, 2),
br as (select a.event event_a, b.event event_b, a.entity shared_entity from mem a join mem b on a.entity = b.entity and a.event < b.event)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import model

    n, e = model.tables_graph(spark, sf_dir)
    legs = e.filter("name in ('MADE', 'TARGETED')").select(F.when(F.col("name") == "MADE", F.col("dst")).otherwise(F.col("src")).alias("event"), F.when(F.col("name") == "MADE", F.col("src")).otherwise(F.col("dst")).alias("entity"), F.lit("").alias("entity_name"), F.col("name").alias("rel_name"))
    return bridges.memberships(legs)


@query("with" + _BRIDGE + " select event_a, event_b, shared_entity, 1.0::double weight from br")
def hub_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-BRIDGE, J16, A19: pairs of orders that share a customer or a part."""
    return bridges.bridges(_members(spark, sf_dir)).drop("name")


@query("with" + _BRIDGE + """, ends as (select event_a hub, event_b nbr, shared_entity from br union all select event_b, event_a, shared_entity from br)
select hub, count(distinct nbr) neighbours, min(shared_entity) first_shared from ends group by 1""")
def bridge_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours of every order, each by its best bridge, counted."""
    pool = bridges.neighbour_pool(_members(spark, sf_dir))
    return pool.groupBy("hub").agg(F.count("*").alias("neighbours"), F.min("shared_entity").alias("first_shared"))


@query("""with f as (select l_partkey entity, o_orderkey hub, o_orderdate::date at_day from lineitem join orders on o_orderkey = l_orderkey)
select entity, count(distinct at_day) times, count(distinct hub) hubs from f group by 1 having times >= 2 and hubs >= 2""")
def temporal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with several times and hubs."""
    facts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("entity"), F.col("o_orderkey").alias("hub"), F.col("o_orderdate").cast("date").alias("at"))
    return bridges.conflicts(facts).select("entity", F.size("times").cast("long").alias("times"), "hubs")


@query(r"""with w as (select conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) t from conversations) select conv_id::varchar as session, list_sort(list(distinct t)) tokens from w group by 1""")
def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each conversation."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("text").alias("entity_name"))
    return bridges.session_tokens(rows)


@query()
def topic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-TOPIC: conversations clustered in order by shared words; tests compare it with plain Python."""
    rows = session_tokens(spark, sf_dir).withColumn("tenant", F.lit("all"))
    return bridges.topics(rows).select("topic", "label", "session")


@query("""with e as (select user_id, epoch_us(ts) a, epoch_us(ts) + 3600000000 * (1 + (props->>'k')::int % 5) b from events),
m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) pb from e),
i as (select *, sum(case when pb is null or a > pb then 1 else 0 end) over (partition by user_id order by a, b) island from m),
u as (select user_id, island, min(a) a, max(b) b from i group by 1, 2)
select user_id, count(*) islands, sum(b - a)::bigint busy_us from u group by 1""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of overlapping spans, by user."""
    a = F.unix_micros("ts")
    rows = events(spark, sf_dir).select("user_id", a.alias("a"), (a + 3_600_000_000 * (1 + F.get_json_object("props", "$.k").cast("int") % 5)).alias("b"))
    w = Window.partitionBy("user_id").orderBy("a", "b")
    seen = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(seen.isNull() | (F.col("a") > seen), 1).otherwise(0))
    isles = fresh.withColumn("island", F.sum("fresh").over(w)).groupBy("user_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return isles.groupBy("user_id").agg(F.count("*").alias("islands"), F.sum(F.col("b") - F.col("a")).alias("busy_us"))


@query("""select event_type stage, count(*) calls, round(sum(value), 6) total, round(max(value), 6) most, round(sum(value) / sum(sum(value)) over (), 6) share from events group by 1""")
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, maxima and shares by stage."""
    rows = events(spark, sf_dir).groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum("value").alias("t"), F.max("value").alias("m"))
    whole = F.broadcast(rows.agg(F.sum("t").alias("whole")))
    return rows.crossJoin(whole).select("stage", "calls", F.round("t", 6).alias("total"), F.round("m", 6).alias("most"), F.round(F.col("t") / F.col("whole"), 6).alias("share"))


@query("""select k.key, k.value, count(*) n from documents, unnest([{key: 'lang', value: lang}, {key: 'source', value: source}]) t(k) where k.value is not null group by 1, 2""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each value of each extra."""
    rows = passages(spark, sf_dir).withColumn("extras", F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), lambda _, v: v.isNotNull()))
    return ranked.facets(rows)


@query("""select doc_id id from documents where lower(trim(lang)) = 'en' and lower(trim(source)) = 'src3'""")
def extras_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of metadata entries, blanks and case aside."""
    rows = passages(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return store.listing(rows, ["text"], equal={"lang": " EN ", "source": "SRC3"}).select("id")


@query("""select doc_id id, count(*) over () total from documents where contains(lower(text), 'license') order by doc_id desc limit 10 offset 5""")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of passages by text, with the total."""
    return ranked.page(store.listing(passages(spark, sf_dir), ["text"], "LICENSE").select("id"), [F.desc("id")], 5, 10)


@query(r"""select doc_id id, list_distinct([x for x in regexp_extract_all(lower(text), '[\p{L}\p{N}]+') if length(x) >= 3 and x not in ('the','and','for','with','from','this','that','are','was')]).len()::bigint tokens from documents""")
def hybrid_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct query tokens of each text."""
    return passages(spark, sf_dir).select("id", F.size(text.hybrid_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("""select doc_id id, case when length(trim(text)) <= 240 then trim(text) else rtrim(substr(trim(text), 1, 239)) || '…' end snippet from documents""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trimmed snippets."""
    return passages(spark, sf_dir).select("id", text.snippet(F.col("text")).alias("snippet"))


@query()
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy paragraph chunks; tests compare it with plain Python."""
    return passages(spark, sf_dir).select("id", F.posexplode(text.chunks(F.col("text"), 1200)).alias("pos", "chunk"))


@query("""select o_orderkey id, strftime(o_orderdate, '%d/%m/%Y') day_first, strftime(o_orderdate, '%d/%m/%Y') iso, strftime(o_orderdate, '%d/%m/%Y') month_name, strftime(o_orderdate - interval 1 day, '%d/%m/%Y') yesterday, strftime(o_orderdate - interval 3 week, '%d/%m/%Y') weeks_ago, strftime(o_orderdate + interval 1 month, '%d/%m/%Y') next_month from orders""")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M4: dates in several spellings, and relative ones."""
    d = F.col("o_orderdate").cast("timestamp")
    rel = lambda s: dates.resolved(F.lit(s), d)
    spelt = lambda f: dates.normal(F.date_format(d, f))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), spelt("dd/MM/yyyy").alias("day_first"), spelt("yyyy-MM-dd'T'HH:mm:ss").alias("iso"), spelt("MMMM d, yyyy").alias("month_name"), rel("yesterday").alias("yesterday"), rel("3 weeks ago").alias("weeks_ago"), rel("next month").alias("next_month"))


@query("""select c_custkey id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) uuid, 'topic:' || substr(sha1(c_name), 1, 12) topic from (select *, sha256(lower(trim(c_name)) || '|' || lower(c_mktsegment)) h from customer)""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from hashes of names."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scores.stable_uuid(F.col("c_name"), F.col("c_mktsegment")).alias("uuid"), F.concat(F.lit("topic:"), F.substring(F.sha1("c_name"), 1, 12)).alias("topic"))


@query("""with w as (select *, min(p_retailprice) over (partition by p_brand) lo, max(p_retailprice) over (partition by p_brand) hi from part)
select p_partkey id, round(case when hi <= lo then 0 else (p_retailprice - lo) / (hi - lo) end, 6) scaled, p_size < 10 small, case when p_size <= 15 then 'tail' when p_size <= 35 then 'torso' else 'head' end stratum from w""")
def scaled_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescaling by key, and strata."""
    p = table(spark, sf_dir, "part").withColumn("s", scores.min_max(F.col("p_retailprice"), ["p_brand"], 0.0))
    return p.select(F.col("p_partkey").alias("id"), F.round("s", 6).alias("scaled"), (F.col("p_size") < 10).alias("small"), F.when(F.col("p_size") <= 15, "tail").when(F.col("p_size") <= 35, "torso").otherwise("head").alias("stratum"))


@query("""with a as (select l.doc_id, quality, toxic, d.lang from labels l join documents d using (doc_id)), s as (select lang, count(*)::double n, sum(quality)::double h, sum((quality = 1 and toxic = 0)::int) b, sum((quality = 0 and toxic = 1)::int) c from a group by 1)
select lang, n::bigint n, round(h / n, 6) rate, round(greatest(0, (h / n + 1.96 ** 2 / (2 * n)) / (1 + 1.96 ** 2 / n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 ** 2 / (4 * n * n)) / (1 + 1.96 ** 2 / n)), 6) low,
  round(least(1, (h / n + 1.96 ** 2 / (2 * n)) / (1 + 1.96 ** 2 / n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 ** 2 / (4 * n * n)) / (1 + 1.96 ** 2 / n)), 6) high from s""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate's interval by slice."""
    rows = table(spark, sf_dir, "labels").join(passages(spark, sf_dir).select(F.col("id").alias("doc_id"), "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("h"))
    low, high = scores.wilson(F.col("h"), F.col("n"))
    return rows.select("lang", "n", F.round(F.col("h") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(r"""with a as (select conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') t from conversations where role = 'assistant'), u as (select conv_id, turn + 1 turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') t from conversations where role = 'user'),
x as (select conv_id, turn, [w for w in a.t if w not in ('a', 'an', 'the')] a, [w for w in u.t if w not in ('a', 'an', 'the')] u from a join u using (conv_id, turn)),
ta as (select conv_id, turn, w, count(*) n from (select conv_id, turn, unnest(a) w from x) group by all), tu as (select conv_id, turn, w, count(*) n from (select conv_id, turn, unnest(u) w from x) group by all),
c as (select conv_id, turn, sum(least(ta.n, tu.n)) c from ta join tu using (conv_id, turn, w) group by all)
select conv_id, turn, round(coalesce(2.0 * c / (len(a) + len(u)), 0)::double, 6) f1, round(coalesce(c / nullif(len(u), 0) * case when len(u) >= len(a) then 1 else exp(1 - len(a)::double / len(u)) end, 0)::double, 6) bleu1 from x left join c using (conv_id, turn)""")
def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 and BLEU-1 of a turn against the answer that follows it."""
    c = table(spark, sf_dir, "conversations")
    toks = lambda role, shift, name: c.filter(F.col("role") == role).select("conv_id", (F.col("turn") + shift).alias("turn"), text.normal_answer(F.col("text")).alias(name))
    pairs = toks("assistant", 0, "a").join(toks("user", 1, "u"), ["conv_id", "turn"])
    distinct = F.array_distinct("u")
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    shared = F.aggregate(distinct, F.lit(0), lambda s, w: s + F.least(count(F.col("a"), w), count(F.col("u"), w)))
    rows = pairs.withColumn("c", shared.cast("double"))
    na, nu = F.size("a"), F.size("u")
    f1 = F.when(na + nu > 0, 2 * F.col("c") / (na + nu)).otherwise(0.0)
    brief = F.when(nu >= na, 1.0).otherwise(F.exp(1 - na / nu))
    return rows.select("conv_id", "turn", F.round(f1, 6).alias("f1"), F.round(F.when(nu > 0, F.col("c") / nu * brief).otherwise(0.0), 6).alias("bleu1"))


@query("""select conv_id, count(*) turns, coalesce(sum(greatest(1, length(text) // 4)), 0)::bigint estimate from conversations group by 1""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens by conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(text.token_estimate(F.col("text"))).alias("estimate"))


@query("""select c_custkey id, 'Title: ' || c_name || chr(10) || 'Class: ' || c_mktsegment as body, upper(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '_', 'g')) label from customer""")
def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field lines and attribute labels."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.product_text({"Title": F.col("c_name"), "Class": F.col("c_mktsegment")}).alias("body"), text.attribute_label(F.col("c_mktsegment")).alias("label"))


@query("""with recursive w(user_id, n, t) as (select user_id, 0, 0.0::double from events group by 1) select user_id, event_id, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) gap_sum from (select user_id, event_id, ts, round(value)::bigint as value from events)""")
def cumulative_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as running sums of gaps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("user_id", "event_id", F.sum(F.round("value").cast("long")).over(w).cast("decimal(38,0)").alias("gap_sum"))


@query("""select n_name, r_name, count(*)::bigint customers, round(sum(c_acctbal), 2) balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2""")
def read_only_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad-hoc SQL, checked by the parser."""
    sql = store.ReadOnlySql(spark, {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region")})
    rows, _ = sql.run("select n_name, r_name, count(*) customers, round(sum(c_acctbal), 2) balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2")
    return rows


@query("""select p_partkey id, list_sort(list_distinct([p_brand, p_type])) labels, (p_brand is null)::boolean bare from part where p_partkey not in (select l_partkey from lineitem)""")
def without_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after an anti-join."""
    p = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    return p.select(F.col("p_partkey").alias("id"), F.array_sort(F.array_distinct(F.array("p_brand", "p_type"))).alias("labels"), F.col("p_brand").isNull().alias("bare"))


@query("""with m as (select l_suppkey member, p_brand kind_a, p_type kind_b from lineitem join part on p_partkey = l_partkey), a as (select member, 'brand' kind from m where kind_a = (select min(p_brand) from part) union select member, 'type' from m where kind_b = (select min(p_type) from part))
select member, count(distinct kind) kinds from a group by 1 having count(distinct kind) = 2 or not exists (select 1 from a group by member having count(distinct kind) = 2)""")
def hub_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members common to all kinds of hubs, or of any kind if there are none."""
    p = table(spark, sf_dir, "part")
    first = F.broadcast(p.agg(F.min("p_brand").alias("b"), F.min("p_type").alias("t")))
    kinds = F.array_compact(F.array(F.when(F.col("p_brand") == F.col("b"), "brand"), F.when(F.col("p_type") == F.col("t"), "type")))
    rows = table(spark, sf_dir, "lineitem").join(p.crossJoin(first), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("member"), F.explode(kinds).alias("kind"))
    counts = rows.groupBy("member").agg(F.countDistinct("kind").alias("kinds"))
    best = F.broadcast(counts.agg(F.max("kinds").alias("most")))
    return counts.crossJoin(best).filter((F.col("kinds") == 2) | (F.col("most") < 2)).select("member", "kinds")
