import json

import pytest
from loomgraph.sources import store
from pyspark.sql import functions as F


def test_corpus_splits_and_refuses_other_types(spark, tmp_path):
    lines = [{"type": "doc", "doc_id": "d1", "text": "t"}, {"type": "query", "qid": "q", "query": "w", "gold_doc_ids": ["d1"], "gold_grades": {"d1": 1.0}, "slice": "s"}]
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("\n".join(map(json.dumps, lines)))
    bad.write_text("\n".join(map(json.dumps, [*lines, {"type": "odd", "doc_id": "x"}])))
    docs, asked = store.corpus(spark, str(good))
    assert docs.collect()[0].doc_id == "d1" and asked.collect()[0].gold_grades == {"d1": 1.0}
    with pytest.raises(Exception, match="unknown record type: odd"):
        store.corpus(spark, str(bad))[0].collect()


def test_json_lines_skip_incomplete_rows(spark, tmp_path):
    p = tmp_path / "i.jsonl"
    p.write_text('{"user_id": "u", "item_id": "i"}\n{"user_id": "", "item_id": "i"}\n{"item_id": "i"}\n')
    assert store.json_lines(spark, str(p), "user_id string, item_id string", ["user_id", "item_id"]).count() == 1


def test_packed_logs(spark, tmp_path):
    p = tmp_path / "log.txt"
    p.write_text("query\twids\tlabels\nred\x18lamp\t7_8_9\t0_1_0\n")
    rows = store.packed(store.tab_separated(spark, str(p)), ["wids", "labels"]).orderBy("pos").collect()
    assert [(r.pos, r.wids, r.labels) for r in rows] == [(0, "7", "0"), (1, "8", "1"), (2, "9", "0")]
    assert store.tab_separated(spark, str(p)).select(store.packed_terms(F.col("query")).alias("q")).first().q == "red lamp"


def test_ratings_and_listing(spark, tmp_path):
    p = tmp_path / "u.data"
    p.write_text("1\t10\t4\t881250949\n")
    r = store.ratings(spark, str(p)).first()
    assert (r.user_id, r.rating, r.ts.year) == ("1", 4.0, 1997)
    rows = spark.createDataFrame([("a", "50% off_now", {"Lang": " EN "}, ["x"]), ("b", "500 offend", {}, [])], "id string, text string, metadata map<string,string>, labels array<string>")
    assert [r.id for r in store.listing(rows, ["text"], "0% OFF_").collect()] == ["a"]
    assert [r.id for r in store.listing(rows, ["text"], equal={"lang": "en"}, any_of=("labels", ["x", "y"])).collect()] == ["a"]


def test_edges_from_vectors_only_without_edges(spark):
    edges = spark.createDataFrame([], "uuid string, src string, dst string, name string")
    v = spark.createDataFrame([("relationships", ("r", ["a", "b"], "KNOWS")), ("nodes", ("n", ["a"], None))], "store string, metadata struct<uuid:string,node_ids:array<string>,predicate:string>")
    assert [tuple(r) for r in store.edges_from_vectors(edges, v).collect()] == [("r", "a", "b", "KNOWS")]
