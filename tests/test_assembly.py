"""Answers from evidence, nested reports and types of placeholders on hand-made cases."""

import json

from pyspark.sql import functions as F

from tarnweave.functions import nested
from tarnweave.operators import assembly, records

EVIDENCE = "answer_id long, place long, code string, upload boolean, rank long, citation_id string"
COMMANDS = "answer_id long, pos long, code string"


def ground(spark, commands, evidence):
    out = assembly.ground_commands(spark.createDataFrame(commands, COMMANDS), spark.createDataFrame(evidence, EVIDENCE))
    return [tuple(r) for r in out.orderBy("answer_id", "place").select("answer_id", "code", "citation_ids", "tier").collect()]


def test_commands_that_differ_in_a_placeholder_find_themselves(spark):
    both = [(1, 1, "git checkout <path/to/file>", False, 0, "c1"), (1, 2, "git checkout <branch_name>", False, 0, "c1")]
    assert ground(spark, [(1, 0, "git checkout <branch_name>")], both) == [(1, "git checkout <branch_name>", ["c1"], 1)]
    assert ground(spark, [(1, 0, "git checkout <other>")], both) == [(1, "git checkout <path/to/file>", ["c1"], 2)]
    asked = [(1, 0, "git checkout <branch_name>"), (1, 1, "git checkout <path/to/file>"), (1, 2, "git checkout <branch_name>")]
    assert [r[1] for r in ground(spark, asked, both)] == ["git checkout <branch_name>", "git checkout <path/to/file>"]


def test_quotes_come_back_as_in_the_catalog(spark):
    canonical = 'tasklist /FI "PID eq <pid>"'
    for code in ('tasklist /FI "PID eq <pid>"', "tasklist /FI 'PID eq <pid>'", "tasklist /FI PID eq <pid>", "tasklist /FI  “PID eq <id>”"):
        assert [r[1] for r in ground(spark, [(1, 0, code)], [(1, 1, canonical, False, 0, "c")])] == [canonical]
    assert ground(spark, [(1, 0, "tasklist /V")], [(1, 1, "tasklist", False, 0, "c")]) == []


def test_uploads_come_first_and_order_is_that_of_the_evidence(spark):
    evidence = [
        (1, 1, "ls", False, 5, "b"), (1, 2, "ls", True, 7, "u2"), (1, 3, "ls", True, 6, "u1"), (1, 4, "pwd", False, 1, "a"), (1, 4, "pwd", False, 0, "z"),
        (1, 5, "no cite", False, None, None), (2, 1, "ls", False, 0, "x"),
    ]
    asked = [(1, 0, "no cite"), (1, 1, "ls \n"), (1, 2, "pwd"), (2, 0, "'ls'"), (2, 1, "ls"), (3, 0, "ls")]
    assert ground(spark, asked, evidence) == [(1, "pwd", ["z", "a"], 1), (1, "ls \n", ["u1", "u2"], 0), (1, "no cite", [], 1), (2, "ls", ["x"], 2)]
    assert ground(spark, [], evidence) == [] and ground(spark, asked, []) == []


def test_segments_cite_known_evidence(spark):
    segments = spark.createDataFrame(
        [(1, 0, "a", ["c2", "zz", "c1", "c2"]), (1, 1, "b", ["zz"]), (1, 2, "  ", ["c1"]), (2, 0, "x", []), (3, 0, "y", None), (4, 0, "w", ["c9"])], "answer_id long, pos long, text string, citation_ids array<string>"
    )
    cites = spark.createDataFrame([(1, 0, "c1"), (1, 1, "c2"), (2, 3, "d"), (2, 1, "e"), (4, 0, "c1"), (5, 0, None)], "answer_id long, rank long, citation_id string")
    summaries = spark.createDataFrame([(1, "s1"), (2, " s2 "), (3, "s3"), (4, " ")], "answer_id long, summary string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(assembly.ground_segments(segments, cites)) == [(1, 0, "a", ["c2", "c1"])]
    assert rows(assembly.ground_segments(segments, cites, summaries)) == [(1, 0, "a", ["c2", "c1"]), (2, 0, "s2", ["e"])]


def plain_leaves(value, path="$"):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in plain_leaves(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in plain_leaves(v, f"{path}[{i}]")]
    return [(path, value)]


DEEP = {"a": [1, {"b": [[{"c": "token: abcdefghijklmnop"}]]}], "e": {}, "f": [], "n": None, "t": True, "k<y>": {"x y": "plain"}, "w": {f"k{i}": f"v{i}" for i in range(10_000)}}


def test_leaves_at_any_depth(spark):
    texts = [json.dumps(DEEP), "not json", None, '"top"', "[]", json.dumps([[["x"]]])]
    got = {}
    for r in nested.leaves(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "j", ["id"]).collect():
        got.setdefault(r["id"], []).append((r["path"], r["value"]))
    said = lambda v: None if v is None else json.dumps(v) if isinstance(v, (bool, int)) else v
    for i in (0, 3, 5):
        assert sorted(got[i]) == sorted((p, said(v)) for p, v in plain_leaves(json.loads(texts[i])))
    assert set(got) == {0, 3, 5}
    leaks = nested.find_leaks(spark.createDataFrame([(0, texts[0])], "id long, j string"), "j", ["id"])
    assert [r["path"] for r in leaks.collect()] == ["$.a[1].b[0][0].c"]
    assert nested.leaves(spark.createDataFrame([], "id long, j string"), "j", ["id"]).count() == 0


def test_redaction_goes_all_the_way_down(spark):
    report = {"api_key": {"x": [1]}, "total_tokens": 5, "a": [{"Authorization": "x", "note": "use sk-abcdefghijklmnopqrst now", "b": [None, 1.5, "ghp_" + "A" * 20]}]}
    rows = [(json.dumps(report),), ("nope",), (None,), ('"password=abcdefghijklmnop"',)]
    out = [r[0] for r in spark.createDataFrame(rows, "j string").select(nested.redact_json(F.col("j"))).collect()]
    assert json.loads(out[0]) == {"api_key": "[REDACTED]", "total_tokens": 5, "a": [{"Authorization": "[REDACTED]", "note": "use [REDACTED] now", "b": [None, 1.5, "[REDACTED]"]}]}
    assert out[1:] == [None, None, '"[REDACTED]"']


def test_types_of_placeholders(spark):
    code = "a <report-file> <support-user> <HTTP_PORT> <port> <API token> < Enter > <[x|y]> <n> <<EOF <Report-File> <export-dir> <\n>"
    got = spark.createDataFrame([(code,)], "c string").select(records.typed_placeholders(F.col("c")).alias("m")).first()["m"]
    assert [(m["name"], m["kind"]) for m in got] == [
        ("report-file", "path"), ("support-user", "identifier"), ("HTTP_PORT", "port"), ("port", "port"), ("API token", "credential"), ("Enter", "literal"), ("[x|y]", "literal"), ("n", "value"), ("export-dir", "path"),
    ]
