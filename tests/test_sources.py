"""Sources and sinks on small files."""

import hashlib
import json

from tarnweave.sources import readers


def test_recipes(spark, tmp_path):
    rows = [{"id": "a", "title": "t", "domain": "d", "steps": [{"title": "x", "code": "ls"}]}, {"id": "a", "steps": [{"code": " "}]}, {"id": "", "steps": []}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    r = readers.read_recipes(spark, str(tmp_path / "r.json"))
    assert r.count() == 3 and sorted((x["id"], x["rule"]) for x in readers.recipe_errors(r).collect()) == [("", "id"), ("", "steps"), ("a", "code"), ("a", "duplicate")]


def test_suite(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"id": f"c{i}", "query": "q", "expected_topic_id": f"t{i}"}) for i in range(3)))
    (tmp_path / "b.jsonl").write_text(json.dumps({"id": "c9", "query": "q", "expected_topic_id": "t9"}))
    (tmp_path / "b.qrels").write_text("c9 0 t1 2\nc9 0 t2 1\n")
    (tmp_path / "m.json").write_text(json.dumps({"datasets": [{"name": "a", "path": "a.jsonl"}, {"name": "b", "path": "b.jsonl", "qrels": "b.qrels"}]}))
    cases, judged = readers.read_suite(spark, str(tmp_path / "m.json"), str(tmp_path))
    assert cases.count() == 4 and sorted((r["dataset"], r["doc_id"], r["relevance"]) for r in judged.collect()) == [("a", "t0", 1), ("a", "t1", 1), ("a", "t2", 1), ("b", "t1", 2), ("b", "t2", 1)]


def test_fixture_errors(spark):
    good, bad = "x\ny\n", "x\n\ny"
    files = spark.createDataFrame([("g", good), ("b", bad)], "name string, content string")
    want = [("g", hashlib.sha256(good.encode()).hexdigest(), 2), ("b", "0", 2), ("gone", "0", 1)]
    got = readers.fixture_errors(files, spark.createDataFrame(want, "name string, sha256 string, case_count int"))
    assert sorted(map(tuple, got.collect())) == [("b", "blank_line"), ("b", "count"), ("b", "hash"), ("gone", "missing")]


def test_chunks_and_revisions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, title string")
    chunks = spark.createDataFrame([(2, 0, "p2"), (1, 1, "gone"), (1, 0, "p1"), (3, 0, "p1")], "doc_id long, idx long, parent_id string")
    parents = spark.createDataFrame([("p1", "one"), ("p2", "two")], "parent_id string, text string")
    assert [(r["doc_id"], r["idx"], r["parent_text"]) for r in readers.scan_chunks(chunks, docs, parents).collect()] == [(1, 0, "one"), (1, 1, None), (2, 0, "two")]
    chunks.write.parquet(str(tmp_path / "v1"))
    fresh = spark.createDataFrame([(1, 0, "p9")], chunks.schema)
    v2 = readers.merge_revision(str(tmp_path / "v1"), fresh, ["doc_id"], "r2", str(tmp_path / "v2"))
    assert sorted((r["doc_id"], r["parent_id"], r["revision"]) for r in v2.collect() if r["doc_id"] < 3) == [(1, "p9", "r2"), (2, "p2", None)]


def test_sinks(spark, tmp_path):
    topics = spark.createDataFrame([("a", "git"), ("b", "git"), ("c", "sql")], "id string, domain string")
    bundle = readers.write_catalog(topics, str(tmp_path / "cat")).first()
    again = readers.write_catalog(topics.repartition(3), str(tmp_path / "cat2")).first()
    assert (bundle["topics"], bundle["shards"]) == (3, 2) and bundle["catalog_hash"] == again["catalog_hash"]
    results = spark.createDataFrame([(1, True), (2, False)], "case_id long, passed boolean")
    readers.write_report(results, results.selectExpr("count(*) cases", "avg(passed::int) pass_rate"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/failed")).count() == 1 and "| pass_rate | 0.5 |" in [r[0] for r in spark.read.text(str(tmp_path / "rep/summary")).collect()]
    assert spark.read.json(str(tmp_path / "rep/manifest")).first()["cases"] == 2
    s = spark.createDataFrame([("train", "abc"), ("train", "d"), ("val", "ef")], "split string, text string")
    assert {r["split"]: (r["samples"], r["chars"], r["longest"]) for r in readers.split_stats(s, "text").collect()} == {"train": (2, 4, 3), "val": (1, 2, 2)}


def test_utf8_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "b.txt").write_text("\ufeffok \ufffd", encoding="utf-8")
    (tmp_path / "c.txt").write_text("fine")
    assert sorted(map(tuple, readers.utf8_errors(spark, str(tmp_path)).collect())) == [("a.txt", "encoding"), ("b.txt", "mark"), ("b.txt", "replacement")]
