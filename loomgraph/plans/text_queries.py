"""Lexical and dense retrieval, fusion, metrics and text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, stems, text
from ..operators import dense, lexical, ranked
from ..session import table
from ..sources import store
from .catalog import query


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and gain = quality of every labelled document, for all questions alike."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("gain"))


# SQL that several queries share
TOKENS = r"""
tok as (select doc_id id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) term from documents),
post as (select id, term, count(*) tf from tok group by 1, 2),
len as (select id, count(*) dl, sum(tf) tokens from post group by 1),
stats as (select (select count(*) from documents)::double n,
  (select sum(greatest(dl, 1)) + (select count(*) from documents) - count(*) from len)::double / (select count(*) from documents) avgdl,
  (select sum(greatest(tokens, 1)) + (select count(*) from documents) - count(*) from len)::double / (select count(*) from documents) avgtokens),
df as (select term, count(*)::double df from post group by 1),
idf as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from df, stats),
qtok as (select item_id qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term from benchmark),
qt as (select qid, term, count(*) qtf from qtok group by 1, 2)"""

_SCORED = """
scored as (select qid, p.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score, count(*) matched
  from qt join post p using (term) join idf using (term) join len l on l.id = p.id, stats group by 1, 2)"""

BM25 = TOKENS + "," + _SCORED + """,
bm as (select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from scored qualify rk <= 10)"""

OVERLAP = """
ov as (select qid, id, count(*) score, row_number() over (partition by qid order by count(*) desc, id)::int rk
  from qt join post using (term) group by 1, 2 qualify rk <= 10)"""


def bm25_lists(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return lexical.bm25(passages(spark, sf_dir), questions(spark, sf_dir), **options)


def overlap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    return lexical.token_overlap(passages(spark, sf_dir), terms)


@query("with" + BM25 + " select * from bm")
def bm25_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each question, any term."""
    return bm25_lists(spark, sf_dir)


@query("with" + BM25 + " select * from bm")
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over stored postings, of which a search reads its own terms' folders."""
    return lexical.bm25(lexical.Index(passages(spark, sf_dir), store.shared_path(spark, "index")), questions(spark, sf_dir))


#: The published suffix rules for English, told once more in SQL: stems of a table `terms` (term), stop words left out.
_ENGLISH = r"""
stop as (select unnest(string_split('STOP', ' ')) term),
odd as (select unnest(['skis','skies','dying','lying','tying','idly','gently','ugly','early','only','singly','sky','news','howe','atlas','cosmos','bias','andes']) term,
  unnest(['ski','sky','die','lie','tie','idl','gentl','ugli','earli','onli','singl','sky','news','howe','atlas','cosmos','bias','andes']) stem),
e0 as (select term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') w from terms where length(term) > 2 and term not in (select term from stop) and term not in (select term from odd)),
e1 as (select *, case when regexp_matches(w, '^(gener|commun|arsen)') then length(regexp_extract(w, '^(gener|commun|arsen)')) else coalesce(nullif(length(regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]')), 0), length(w)) end r1 from e0),
e2 as (select *, r1 + coalesce(nullif(length(regexp_extract(substr(w, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]')), 0), length(w) - r1) r2 from e1),
a1 as (select term, r1, r2, case when w like '%sses' then left(w, length(w) - 2) when regexp_matches(w, '(ied|ies)$') then left(w, length(w) - case when length(w) > 4 then 2 else 1 end)
  when regexp_matches(w, '(us|ss)$') then w when regexp_matches(w, '[aeiouy].+s$') then left(w, length(w) - 1) else w end w from e2),
a2 as (select *, w in ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') kept, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') suf from a1),
a3 as (select *, left(w, length(w) - length(suf)) t from a2),
b1 as (select term, r1, r2, kept, case when kept or suf = '' then w when suf in ('eed', 'eedly') then case when length(t) >= r1 then t || 'ee' else w end when not regexp_matches(t, '[aeiouy]') then w
  when regexp_matches(t, '(at|bl|iz)$') then t || 'e' when regexp_matches(t, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then left(t, length(t) - 1)
  when length(t) = r1 and regexp_matches(t, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$') then t || 'e' else t end w from a3),
c1 as (select term, r1, r2, kept, case when not kept and regexp_matches(w, '.[^aeiouy][yY]$') then left(w, length(w) - 1) || 'i' else w end w from b1),
s2 as (select *, regexp_extract(w, '(ational|ization|fulness|ousness|iveness|tional|biliti|lessli|entli|ation|alism|aliti|ousli|iviti|fulli|enci|anci|abli|izer|ator|alli|bli|ogi|li)$') suf from c1),
t2 as (select *, left(w, length(w) - length(suf)) t from s2),
d2 as (select term, r1, r2, kept, case when kept or suf = '' or length(t) < r1 then w when suf = 'ogi' then case when t like '%l' then t || 'og' else w end when suf = 'li' then case when regexp_matches(t, '[cdeghkmnrt]$') then t else w end
  else t || case when suf = 'tional' then 'tion' when suf in ('izer', 'ization') then 'ize' when suf in ('ational', 'ation', 'ator') then 'ate' when suf in ('alism', 'aliti', 'alli') then 'al' when suf = 'fulness' or suf = 'fulli' then 'ful'
    when suf in ('ousli', 'ousness') then 'ous' when suf in ('iveness', 'iviti') then 'ive' when suf in ('biliti', 'bli') then 'ble' when suf = 'lessli' then 'less' when suf = 'enci' then 'ence' when suf = 'anci' then 'ance' when suf = 'abli' then 'able' when suf = 'entli' then 'ent' end end w from t2),
s3 as (select *, regexp_extract(w, '(ational|tional|alize|icate|iciti|ative|ical|ness|ful)$') suf from d2),
t3 as (select *, left(w, length(w) - length(suf)) t from s3),
d3 as (select term, r1, r2, kept, case when kept or suf = '' or length(t) < r1 or (suf = 'ative' and length(t) < r2) then w else t || case suf when 'tional' then 'tion' when 'ational' then 'ate' when 'alize' then 'al' when 'icate' then 'ic' when 'iciti' then 'ic' when 'ical' then 'ic' else '' end end w from t3),
s4 as (select *, regexp_extract(w, '(ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic)$') suf from d3),
t4 as (select *, left(w, length(w) - length(suf)) t from s4),
d4 as (select term, r1, r2, kept, case when kept or suf = '' or length(t) < r2 or (suf = 'ion' and not regexp_matches(t, '[st]$')) then w else t end w from t4),
d5 as (select term, case when kept then w when w like '%e' and (length(w) - 1 >= r2 or (length(w) - 1 >= r1 and not regexp_matches(left(w, length(w) - 1), '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'))) then left(w, length(w) - 1)
  when w like '%ll' and length(w) - 1 >= r2 then left(w, length(w) - 1) else w end w from d4),
stems as (select term, replace(w, 'Y', 'y') stem from d5 union all select term, stem from odd where term in (select term from terms) and term not in (select term from stop) union all select term, term from terms where length(term) <= 2 and term not in (select term from stop))""".replace("STOP", stems.STOP["english"])

_STEMMED = (
    r"""
raw as (select doc_id id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) term from documents),
qraw as (select item_id qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term from benchmark),
terms as (select term from raw union select term from qraw),"""
    + _ENGLISH
    + """,
post as (select id, stem term, count(*) tf from raw join stems using (term) group by 1, 2),
len as (select id, count(*) dl, sum(tf) tokens from post group by 1),
stats as (select (select count(*) from documents)::double n, (select sum(greatest(dl, 1)) + (select count(*) from documents) - count(*) from len)::double / (select count(*) from documents) avgdl),
df as (select term, count(*)::double df from post group by 1),
idf as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from df, stats),
qt as (select distinct qid, stem term from qraw join stems using (term)),"""
    + _SCORED
)


@query("with" + _STEMMED + " select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from scored qualify rk <= 10")
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each question by English stems, without stop words."""
    return bm25_lists(spark, sf_dir, analyser="english")


@query("with" + _STEMMED + ", asked as (select qid, count(*) n from qt group by 1) select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from scored join asked using (qid) where matched = n qualify rk <= 10")
def bm25_stemmed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every stem of a question."""
    return bm25_lists(spark, sf_dir, analyser="english", every_term=True)


@query(r"with terms as (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) term from documents)," + _ENGLISH + " select term, stem from stems")
def term_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: every term of the passages with its English stem."""
    terms = passages(spark, sf_dir).select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    return lexical.stemmed(terms, "english")


@query("with" + TOKENS + "," + _SCORED + ", asked as (select qid, count(*) n from qt group by 1) select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from scored join asked using (qid) where matched = n qualify rk <= 10")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every term."""
    return bm25_lists(spark, sf_dir, every_term=True)


@query("with" + TOKENS + """ select qid, p.id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tokens / avgtokens))), 6) score,
  row_number() over (partition by qid order by round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tokens / avgtokens))), 6) desc, p.id)::int rk
  from qt join post p using (term) join idf using (term) join len l on l.id = p.id, stats group by 1, 2 qualify rk <= 10""")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lengths, and query terms as often as they occur."""
    return bm25_lists(spark, sf_dir, by_tokens=True)


@query("with" + TOKENS + "," + _SCORED + " select qid, s.id, score, row_number() over (partition by qid order by score desc, s.id)::int rk from scored s join documents d on d.doc_id = s.id where d.lang = 'en' qualify rk <= 10")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: a filter restricts the hits, not the statistics."""
    return bm25_lists(spark, sf_dir, candidates=passages(spark, sf_dir).filter("lang = 'en'").select("id"))


@query("with" + TOKENS + "," + OVERLAP + " select * from ov")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the number of a question's words they hold."""
    return overlap_lists(spark, sf_dir)


_RRF = """
lists as (select 0 list_no, qid, id, rk from bm union all select 1, qid, id, rk from ov),
fused as (select qid, id, round(sum(1.0::double / (60 + rk)), 6) score, min(list_no * 1000 + rk) pos from lists group by 1, 2)"""


@query("with" + BM25 + "," + OVERLAP + "," + _RRF + " select qid, id, score, row_number() over (partition by qid order by score desc, pos, id)::int rk from fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists by reciprocal ranks; ties as first seen."""
    return ranked.fuse(bm25_lists(spark, sf_dir), overlap_lists(spark, sf_dir))


@query("with" + BM25 + "," + OVERLAP + ", lists as (select 0 list_no, qid, id, rk, 2.0 w from bm union all select 1, qid, id, rk, 0.5 from ov), fused as (select qid, id, round(sum(w::double / (60 + rk)), 6) score, min(list_no * 1000 + rk) pos from lists group by 1, 2) select qid, id, score, row_number() over (partition by qid order by score desc, pos, id)::int rk from fused")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks with a weight for each list."""
    lists = ranked.union([bm25_lists(spark, sf_dir), overlap_lists(spark, sf_dir)])
    return ranked.rrf(lists, F.when(F.col("list_no") == 0, 2.0).otherwise(0.5))


@query("with" + BM25 + " select qid, id, round(1.0::double / rk, 6) score, rk from bm")
def fuse_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list alone."""
    return ranked.fuse(None, bm25_lists(spark, sf_dir))


_CC = """
scaled as (select 0 l, qid, id, case when max(score) over w <= min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end s from bm window w as (partition by qid)
  union all select 1, qid, id, case when max(score) over w <= min(score) over w then 1.0 else (score - min(score) over w)::double / (max(score) over w - min(score) over w) end from ov window w as (partition by qid)),
cc as (select qid, id, round(sum(case when l = 0 then 0.7 else 0.3 end * s)::double, 6) score from scaled group by 1, 2)"""


@query("with" + BM25 + "," + OVERLAP + "," + _CC + " select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from cc")
def cc_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex combination of rescaled scores."""
    return ranked.convex(bm25_lists(spark, sf_dir), overlap_lists(spark, sf_dir).withColumn("score", F.col("score").cast("double")), 0.7)


@query("with" + BM25 + "," + OVERLAP + """, parts as (select qid, id, case when rk <= 4 then 0 else 2 end part, rk pos from bm
  union all select qid, id, 1, rk from ov where (qid, id) not in (select (qid, id) from bm where rk <= 4)),
firsts as (select qid, id, min(part * 1000 + pos) fst from parts group by 1, 2)
select qid, id, row_number() over (partition by qid order by fst, id)::int rk from firsts qualify rk <= 12""")
def frozen_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head stays, then what the side list adds, then the rest."""
    return ranked.frozen_head(bm25_lists(spark, sf_dir), overlap_lists(spark, sf_dir), 12, head=4)


@query("with" + BM25 + """, judged as (select item_id qid, doc_id id, quality::double gain from benchmark, labels),
hits as (select qid, count(*) hits, min(rk) fst, sum(gain / log2(rk + 1)) dcg from bm join judged using (qid, id) where gain > 0 group by 1),
ideal as (select qid, count(*) n, sum(case when r <= 10 then gain / log2(r + 1) end) ideal from (select *, row_number() over (partition by qid order by gain desc, id) r from judged where gain > 0) group by 1)
select qid, round(coalesce(hits / n, 0)::double, 6) recall, round(coalesce(1.0 / fst, 0)::double, 6) mrr, round(coalesce(dcg / ideal, 0)::double, 6) ndcg
from (select distinct qid from judged) left join ideal using (qid) left join hits using (qid)""")
def ndcg_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the BM25 lists against the labels."""
    return ranked.metrics(bm25_lists(spark, sf_dir), gains(spark, sf_dir), 10, questions(spark, sf_dir))


@query("with" + BM25 + """, m as (select lang slice, b.score from bm b join documents d on d.doc_id = b.id)
select slice, count(*) n, round(avg(score), 6) mean, round(quantile_cont(score, 0.5), 6) p50, round(quantile_cont(score, 0.95), 6) p95 from m group by grouping sets ((), (slice))""")
def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and interpolated percentiles, overall and by slice in one pass."""
    rows = bm25_lists(spark, sf_dir).join(passages(spark, sf_dir).select("id", F.col("lang").alias("slice")), "id")
    p = F.percentile("score", F.array(F.lit(0.5), F.lit(0.95)))
    out = rows.cube("slice").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), p.alias("p"))
    return out.select("slice", "n", "mean", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


@query("with" + BM25 + """, c as (select qid, source id, min(rk) fst from bm b join documents d on d.doc_id = b.id group by 1, 2)
select qid, id, row_number() over (partition by qid order by fst, id)::int rk from c""")
def canonical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits collapsed to what they belong to, the first of each kept."""
    rows = bm25_lists(spark, sf_dir).join(passages(spark, sf_dir).select("id", "source"), "id")
    return ranked.canonical(rows, F.col("source"))


@query("with" + BM25 + " select b.qid, b.id, b.score, row_number() over (partition by b.qid order by b.rk)::int rk from bm b where b.id in (select doc_id from labels)")
def labelled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: lists within the judged pool."""
    return ranked.restricted(bm25_lists(spark, sf_dir), gains(spark, sf_dir))


@query("with" + BM25 + " select b.qid, b.id, b.rk, coalesce(l.quality, 0)::double gain from bm b left join labels l on l.doc_id = b.id")
def labelled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved lists with their labels, unlabelled as irrelevant."""
    rows = bm25_lists(spark, sf_dir).select("qid", "id", "rk").join(gains(spark, sf_dir), "id", "left")
    return rows.select("qid", "id", "rk", F.coalesce("gain", F.lit(0.0)).alias("gain"))


@query("with" + BM25 + """, n as (select b.qid, d.text, min(b.rk) fst from bm b join documents d on d.doc_id = b.id where b.id not in (select doc_id from labels where quality > 0) group by 1, 2)
select qid, md5(text) text_md5, row_number() over (partition by qid order by fst, text)::int rk from n""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved texts that aren't relevant, each once."""
    rows = bm25_lists(spark, sf_dir).join(gains(spark, sf_dir).filter("gain > 0"), "id", "left_anti").join(passages(spark, sf_dir).select("id", "text"), "id")
    first = rows.groupBy("qid", "text").agg(F.min("rk").alias("at"))
    return first.select("qid", F.md5("text").alias("text_md5"), F.row_number().over(Window.partitionBy("qid").orderBy("at", "text")).alias("rk"))


@query("with" + BM25 + "," + OVERLAP + """, a as (select qid, id, bm.rk is not null in_bm, ov.rk is not null in_ov from bm full join ov using (qid, id))
select qid, count(*) filter (in_bm and in_ov) both_lists, count(*) filter (in_bm and not in_ov) only_bm25, count(*) filter (in_ov and not in_bm) only_overlap from a group by 1""")
def list_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two lists share and what either adds."""
    a = bm25_lists(spark, sf_dir).select("qid", "id", F.lit(True).alias("a"))
    b = overlap_lists(spark, sf_dir).select("qid", "id", F.lit(True).alias("b"))
    rows = a.join(b, ["qid", "id"], "full")
    return rows.groupBy("qid").agg(F.count_if(F.col("a") & F.col("b")).alias("both_lists"), F.count_if(F.col("a") & F.col("b").isNull()).alias("only_bm25"), F.count_if(F.col("b") & F.col("a").isNull()).alias("only_overlap"))


@query("with" + BM25 + """, stop as (select unnest(['the','and','for','with','from','this','that','are','was']) term),
fb as (select qid, term, sum(tf) score from bm join post using (id) where rk <= 8 and length(term) > 2 and term not in (select term from stop) and (qid, term) not in (select (qid, term) from qt) group by 1, 2)
select qid, term, score::bigint score, row_number() over (partition by qid order by score desc, term)::int rk from fb qualify rk <= 8""")
def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion terms from the first eight documents."""
    return lexical.expansion(passages(spark, sf_dir), bm25_lists(spark, sf_dir), questions(spark, sf_dir), list(text.HYBRID_STOP))


@query(r"""select item_id qid, doc_id id from benchmark b join documents d on contains(lower(d.text), lower(regexp_extract(b.text, '[\p{L}]{6,}')))""")
def contains_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive containment of each question's first long word."""
    asked = questions(spark, sf_dir).select("qid", F.regexp_extract("text", r"[\p{L}]{6,}", 0).alias("needle"))
    return lexical.holding(passages(spark, sf_dir), asked)


# -- dense

_COS = """
pairs as (select a.vec_id qid, b.vec_id id, a.label ql, b.label bl, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id <> b.vec_id)"""


@query()
def cosine_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every fiftieth vector by inverted lists, approximately."""
    v = vectors(spark, sf_dir).select("id", "embedding")
    return dense.approximate(v, v.filter("id % 50 = 0").withColumnRenamed("id", "qid"), 10)


@query()
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index, some of whose rows were written anew; tests hold its recall before and after
    inserts, deletes and splits."""
    v = vectors(spark, sf_dir)
    index = dense.VectorIndex.built(v.select("id", "embedding"), store.shared_path(spark, "vectors"))
    index.insert(v.join(F.broadcast(v.agg(F.min("label").alias("label"))), "label").select("id", "embedding"))
    return index.search(v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), 10)


@query("with" + _COS + " select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from pairs qualify rk <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of each vector, exactly."""
    store = vectors(spark, sf_dir)
    return dense.nearest(store.select("id", "embedding"), store.select(F.col("id").alias("qid"), "embedding"), 10, skip_self=True)


@query("with" + _COS + " select qid, id, score, row_number() over (partition by qid order by score desc, id)::int rk from pairs where score >= 0.2 qualify rk <= 5")
def similar_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar vectors over a threshold, self excluded."""
    store = vectors(spark, sf_dir)
    return dense.nearest(store.select("id", "embedding"), store.select(F.col("id").alias("qid"), "embedding"), 5, least=0.2, skip_self=True)


@query("""select label, count(*) n, round(avg(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x)))), 6) mean_norm from embeddings group by 1""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of a store by label."""
    v = vectors(spark, sf_dir)
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(scores.euclidean(F.col("embedding"), zero)), 6).alias("mean_norm"))


@query("""with c as (select label, i, avg(embedding[i]::double) m from embeddings, range(1, 65) t(i) group by 1, 2), m as (select label, list(m order by i) centre from c group by 1),
s as (select e.label, vec_id, round(list_cosine_similarity(embedding::double[], centre), 6) score from embeddings e join m using (label))
select label, vec_id, score, row_number() over (partition by label order by score desc, vec_id)::int rk from s qualify rk <= 3""")
def centroid_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors, and the members nearest to them."""
    v = vectors(spark, sf_dir)
    parts = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    rows = v.join(centre, "label").select("label", F.col("id").alias("vec_id"), F.round(scores.cosine(F.col("embedding"), F.col("centre")), 6).alias("score"))
    return ranked.top(rows, 3, ["label"], tie="vec_id")


@query("select vec_id, (('0x' || substr(sha256(vec_id::varchar), 1, 16))::ubigint % 9223372036854775808::ubigint)::bigint vector_key from embeddings")
def vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric keys of string ids."""
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), scores.vector_key(F.col("id").cast("string")).alias("vector_key"))
