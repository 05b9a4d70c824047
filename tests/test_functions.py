import math

import pytest
from loomgraph.functions import dates, scores, text
from loomgraph.operators import channels, ingest, ranked, recommend
from loomgraph.plans.text_queries import questions  # noqa: F401
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(1,)]
    names = list(values) or ["_"]
    return spark.createDataFrame(row, names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "want"),
    [("03/08/2024", "03/08/2024"), ("2024-8-3", "03/08/2024"), ("2024/08/03", "03/08/2024"), ("3-8-2024", "03/08/2024"), ("August 3, 2024", "03/08/2024"), ("aug 3, 2024", "03/08/2024"), ("May 3 2024", "03/05/2024"), ("3 August 2024", "03/08/2024"), ("3 Aug 2024", "03/08/2024"), ("Aug-3-2024", "03/08/2024"), ("2024-08-03T10:11:12", "03/08/2024"), ("2024-08-03T23:30:00-0200", "04/08/2024"), ("2024-08-03 10:11:12.5Z", "03/08/2024"), ("1:56 pm on 8 May, 2023", "08/05/2023"), ("no date", "no date"), ("", "")],
)
def test_absolute_dates(spark, value, want):
    assert one(spark, dates.normal(F.col("v")), v=value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("yesterday", "29/02/2024"), ("Tomorrow", "02/03/2024"), ("today", "01/03/2024"), ("last week", "23/02/2024"), ("next  month", "01/04/2024"), ("3 days ago", "27/02/2024"), ("in 1 day", "02/03/2024"), ("2 weeks ago", "16/02/2024"), ("this friday", "01/03/2024"), ("next friday", "08/03/2024"), ("last friday", "23/02/2024"), ("next Monday", "04/03/2024"), ("someday", "someday")],
)
def test_relative_dates(spark, value, want):
    assert one(spark, dates.resolved(F.col("v"), F.lit("2024-03-01")), v=value) == want  # a Friday


def test_tokens_and_scores(spark):
    assert one(spark, text.hybrid_tokens(F.col("v")), v="The Red, red FOX of ÉCOLE 42 and x") == ["red", "fox", "école"]
    assert one(spark, text.graph_tokens(F.col("v")), v="what is big red box red one two six ten") == ["big", "red", "box", "one", "two", "six"]
    tokens = F.array(F.lit("red"), F.lit("box"))
    assert one(spark, text.name_score(F.lit("red box"), tokens, F.lit("Red Box"))) == 5 + 2 + 1 + 0.75
    assert one(spark, text.name_score(F.lit("red box"), tokens, F.lit("box of red"))) == 2 + 1
    assert one(spark, text.attribute_label(F.lit("9 lives!"))) == "ATTR_9_LIVES" and one(spark, text.attribute_label(F.lit("--"))) == "ATTR"
    assert one(spark, text.camel_key(F.lit("shelf life days"))) == "shelfLifeDays"
    assert one(spark, text.normal_label(F.lit("a-b c.d"))) == "A_B_C_D"


def test_extraction(spark):
    body = "DOCID x-17.\nTitle: Blue lamp\nbrand : Acme\n"
    assert one(spark, text.marked_id(F.lit(body))) == "x-17" and one(spark, text.field(F.lit(body), "Brand")) == "Acme" and one(spark, text.field(F.lit(body), "color")) is None
    assert one(spark, text.hierarchy(F.lit("Home > Light / home|Desk"))) == ["Home", "Light", "Desk"]
    assert [tuple(p) for p in one(spark, text.feature_pairs(F.lit("Size : 4 | bad | Tint: red:dark | x:")))] == [("size", "4"), ("tint", "red:dark")]
    assert one(spark, text.sessions(F.lit("session_3 b1_t2 session_3"))) == ["session_3", "session_b1_t2"]
    assert one(spark, text.span_alignment(F.lit("Red  fox"), F.lit("a red fox ran"))) == 1.0
    assert 0.2 < one(spark, text.span_alignment(F.lit("red fox jumped far"), F.lit("the red dog and the fox jumped over"))) < 0.6
    assert one(spark, text.snippet(F.lit("x" * 300))) == "x" * 239 + "…"
    assert one(spark, text.entity_words(F.lit("the Rome and rome école"))) == ["Rome", "École"]


def test_chunks_as_by_hand(spark):
    def by_hand(s, most):
        units = []
        for p in [p for p in __import__("re").split(r"\n\n+", s)]:
            lines = [p] if len(p) <= most else p.split("\n")
            for x in lines:
                units += [x] if len(x) <= most else [x[i : i + most] for i in range(0, len(x), most)]
        out = []
        for u in [u for u in units if u.strip()]:
            if out and len(out[-1]) + 2 + len(u) <= most:
                out[-1] += "\n\n" + u
            else:
                out.append(u)
        return out

    for s in ("a\n\nb\n\n\nc", "x" * 95, "aa\nbb " * 9 + "\n\n" + "y" * 12, "", "   "):
        assert one(spark, text.chunks(F.lit(s), 20)) == by_hand(s, 20)


def test_math(spark):
    assert one(spark, scores.half_life(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"), 14.0)) == 0.5
    assert one(spark, scores.half_life(F.lit(None).cast("timestamp"), F.lit("2024-01-15").cast("timestamp"), 14.0)) == 1.0
    for name, want in {"Add to-Cart": 0.5, "PURCHASE": 1.0, "wish_list": 0.7, "other": 0.2, None: 0.2}.items():
        assert one(spark, scores.behaviour_weight(F.lit(name).cast("string"))) == want
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(-1.0))
    assert one(spark, scores.cosine(a, b)) == 0.0 and one(spark, scores.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, scores.euclidean(a, b)) == pytest.approx(math.sqrt(10))
    assert one(spark, scores.association(F.lit(0.5), F.lit(0.0), F.lit(1.3))) == 0.0
    assert [one(spark, scores.personal_share(F.lit(q))) for q in ("lamp", "red lamp", "a b c", "a b c d", "lamp 3", "")] == [0.85, 0.5, 0.25, 0.1, 0.0, 0.0]
    assert one(spark, scores.mcnemar(F.lit(1), F.lit(5))) == pytest.approx(2 * (1 + 6) / 64)
    assert one(spark, scores.mcnemar(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, scores.okapi_idf(F.lit(10.0), F.lit(2.0))) == pytest.approx(math.log(1 + 8.5 / 2.5))
    assert one(spark, scores.vector_key(F.lit("x"))) == int(__import__("hashlib").sha256(b"x").hexdigest()[:16], 16) % 2**63
    past = ["how many days between X and Y", "In which order did it happen", "What is it now, and have I said otherwise", "before the update", "walk me through it"]
    now = ["where does she live now", "the formerly used one", "what did she use before", "currently latest", "", "chronology"]
    assert [one(spark, channels.wants_history(F.lit(t))) for t in past + now] == [True] * len(past) + [False] * len(now)
    polar = lambda a, b, mode: one(spark, channels.same_polarity(F.lit(a).cast("string"), F.lit(b).cast("string"), mode))
    assert polar(None, "neutral", "same") and polar("odd", "neutral", "same") and polar(" Positive ", "positive", "same") and not polar("odd", "negative", "same")
    assert polar("positive", " NEGATIVE", "opposite") and not polar("positive", "neutral", "opposite") and not polar("odd", None, "opposite") and not polar("negative", "negative", "opposite")
    assert one(spark, ingest.bag_embedding(F.lit("abcdefghi"))) == [(97 + 105) / 9] + [c / 9 for c in range(98, 105)]


def test_fusion_ties_and_modes(spark):
    lists = lambda rows: spark.createDataFrame(rows, "qid string, id string, rk int, score double")
    a, b = lists([("q", "x", 1, 3.0), ("q", "y", 2, 1.0)]), lists([("q", "y", 1, 9.0), ("q", "x", 2, 8.0), ("q", "z", 3, 0.0)])
    assert [r.id for r in ranked.fuse(a, b).orderBy("rk").collect()] == ["x", "y", "z"]
    assert [r.score for r in ranked.fuse(a, None).orderBy("rk").collect()] == [1.0, 0.5]
    cc = {r.id: r.score for r in ranked.fuse(a, b, "cc", 0.25).collect()}
    assert cc == {"x": pytest.approx(0.25 + 0.75 * 8 / 9, abs=1e-6), "y": 0.75, "z": 0.0}
    head = ranked.frozen_head(b, lists([("q", "n", 1, 1.0), ("q", "y", 2, 1.0)]), 3, head=1)
    assert [r.id for r in head.orderBy("rk").collect()] == ["y", "n", "x"]
    gains = spark.createDataFrame([("q", "y", 2.0), ("q", "z", 1.0), ("q", "w", 0.0), ("p", "x", 1.0)], "qid string, id string, gain double")
    m = {r.qid: r for r in ranked.metrics(b, gains, 2).collect()}
    ideal = 2 + 1 / math.log2(3)
    assert (m["q"].recall, m["q"].mrr, m["q"].ndcg) == (0.5, 1.0, round(2 / ideal, 6)) and m["p"].ndcg == 0.0


def test_blend_keeps_order_without_preferences(spark):
    hits = spark.createDataFrame([("q", "x", 1, 3.0), ("q", "y", 2, 1.0), ("p", "x", 1, 1.0), ("p", "z", 2, 0.5)], "qid string, id string, rk int, score double")
    pref = spark.createDataFrame([("q", "y", 5.0)], "qid string, id string, pref double")
    share = spark.createDataFrame([("q", 0.85), ("p", 0.85)], "qid string, s double")
    got = {(r.qid, r.id): r.new_rk for r in ranked.blend(hits, pref, share).collect()}
    assert got == {("q", "y"): 1, ("q", "x"): 2, ("p", "x"): 1, ("p", "z"): 2}


def test_mmr_spreads_labels(spark):
    rows = spark.createDataFrame([("u", "a", 1.0, ["X"]), ("u", "b", 0.99, ["X"]), ("u", "c", 0.6, ["Y"])], "seed string, id string, score double, labels array<string>")
    assert [r.id for r in recommend.mmr(rows, 2).orderBy("rk").collect()] == ["a", "c"]


def test_merge_and_resolve(spark):
    writes = spark.createDataFrame([("n", 2, "B", "two", ["L2"], {"k": "2", "m": "1"}, ["y", "x"]), ("n", 1, "A", "one", ["L1"], {"k": "1"}, ["x"]), ("n", 3, None, "one", [], None, None)], "uuid string, seq int, name string, description string, labels array<string>, properties map<string,string>, aliases array<string>")
    r = ingest.merged_nodes(writes).first()
    assert (r.name, r.description, r.labels, r.properties, r.aliases) == ("B", "one | two", ["L2"], {"k": "2", "m": "1"}, ["x", "y"])
    new = spark.createDataFrame([("k1", "u1", "Q", "T"), ("k2", "zz", "ann", "p"), ("k3", "z3", "Q", "P"), ("k4", "z4", "Q", "P")], "key string, uuid string, name string, type string")
    known = spark.createDataFrame([("u1", "Other", "T"), ("u2", "Ann", "P"), ("u3", "C", "P"), ("u4", "D", "P")], "uuid string, name string, type string")
    near = spark.createDataFrame([("k3", "u3", 0.95), ("k3", "u4", 0.9), ("k4", "u3", 0.95), ("k4", "u4", 0.94)], "key string, uuid string, sim double")
    assert {r.key: (r.match, r.how) for r in ingest.resolved(new, known, near).collect()} == {"k1": ("u1", "uuid"), "k2": ("u2", "name"), "k3": ("u3", "vector"), "k4": (None, "new")}
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "c")], "uuid string, src string, dst string")
    old = spark.createDataFrame([("o1", "b", "a")], "uuid string, src string, dst string")
    close = spark.createDataFrame([("e1", "o1", 0.05), ("e2", "o1", 0.01)], "uuid string, other string, distance double")
    assert [r.uuid for r in ingest.without_known_edges(edges, close, old).collect()] == ["e2"]


def test_triples_and_states(spark):
    t = spark.createDataFrame([(1, "a", "MADE", "ev", "TARGETED", "b"), (2, "a", "HAS", None, None, "c")], "id int, subject string, subj_event string, event string, event_obj string, object string")
    rows = ingest.relationships_of(t).orderBy("id", "leg").collect()
    assert [(r.src_name, r.name, r.dst_name) for r in rows] == [("a", "MADE", "ev"), ("ev", "TARGETED", "b"), ("a", "HAS", "c")]
    assert rows[0].flow_key == rows[1].flow_key and rows[2].flow_key is None
    states = spark.createDataFrame([("t", "started", 1), ("t", "completed", 2), ("t", "failed", 3), ("t", "queued", 4), ("u", "odd", 1)], "task string, state string, seq int")
    assert {r.task: r.state for r in ingest.task_status(states).collect()} == {"t": "completed", "u": "odd"}
    rows = spark.createDataFrame([("a", "T", "P", "b", "T", 0.5), ("a", "T", "P", "A", "t", 0.9), ("a", "", "P", "b", "T", 0.9), ("a", "T", "P", "b", "T", 0.1), ("a", "T", "P", "b", "T", 0.3), ("a", "T", " ", "b", "T", 0.3), ("", "T", "P", "b", "T", 1.0)], "subject string, subject_type string, predicate string, object string, object_type string, score double")
    assert [r.x for r in rows.select(ingest.reason().alias("x")).collect()] == ["accepted", "same_ends", "missing_type", "ungrounded", "ambiguous", "missing_predicate", "missing_name"]
