"""The gate on whole reports, turns in two forms and contradicted facts, on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import slots
from tarnweave.operators import gate, memory

GOOD = {
    "profile": "full", "quality": 0.9, "p95": 100, "cost": 1.5, "cases": [{"case_id": str(i), "model_calls": [{"attempted": True}]} for i in range(10)], "failed_case_ids": [],
    "metrics": {"cases": 10, "evaluated_cases": 10, "skipped_cases": 0, "passed_cases": 9, "error_cases": 0, "pass_rate": 0.9},
}


def made(**changes):
    m = {**GOOD["metrics"], **changes.pop("m", {})}
    return json.dumps({k: v for k, v in {**GOOD, "metrics": m, **changes}.items() if v != "absent"})


#: candidate, baseline -> status, gate:kind:reason of all issues
CASES = [
    (made(), None, "pass", []),
    (made(), made(), "pass", []),
    (None, made(), "fail", ["schema:schema:not_an_object"]),
    ("{broken", None, "fail", ["schema:schema:not_an_object"]),
    ("[1]", None, "fail", ["schema:schema:not_an_object"]),
    (made(profile=" "), made(), "fail", ["profile:schema:missing"]),
    (made(profile="absent", profile_id="full"), made(), "pass", []),
    (made(quality="0.9", p95=True, cost=None), made(), "fail", ["cost:schema:missing", "p95:schema:missing", "quality:schema:missing"]),
    (made(cost=-1), made(), "fail", ["cost:schema:negative"]),
    (made(metrics="absent"), made(), "fail", ["metrics:schema:missing"]),
    (made(m={"passed_cases": 9.5}), made(), "fail", ["metrics:schema:passed_cases_no_count"]),
    (made(m={"cases": 11}), made(), "fail", ["metrics:schema:list_length", "metrics:schema:skipped"]),
    (made(m={"passed_cases": 0, "pass_rate": 0.0}), made(), "fail", ["metrics:schema:none_passed"]),
    (made(m={"pass_rate": 0.8}), made(), "fail", ["metrics:schema:pass_rate"]),
    (made(cases="absent"), made(), "fail", ["metrics:schema:no_list"]),
    (made(failed_case_ids=[1]), made(), "fail", ["metrics:schema:failed_ids"]),
    (made(report_schema_errors=1), made(), "fail", ["schema_errors:schema:reported"]),
    (made(m={"error_cases": 1}), made(), "fail", ["execution_errors:hard:errors"]),
    (made(m={"error_rate": 0.1}), made(), "fail", ["execution_errors:hard:errors"]),
    (made(cases=[{"fallback_reason": "timeout"}] + GOOD["cases"][1:]), made(), "fail", ["provider_failures:hard:hidden"]),
    (made(cases=[{"model_calls": [{"fallback_reason": "rate_limit"}]}] + GOOD["cases"][1:]), made(), "fail", ["provider_failures:hard:hidden"]),
    (made(cases=[{"fallback_reason": "no_evidence"}] + GOOD["cases"][1:]), made(), "pass", []),
    (made(failed_case_ids=["1"]), None, "fail", ["failed_cases_without_baseline:hard:failed"]),
    (made(failed_case_ids=["1"]), made(), "pass", []),
    (made(quality=0), None, "fail", ["zero_quality:hard:zero"]),
    (made(citation_errors=["x"], injection_flags=0, refusal_errors={}), made(), "fail", ["invalid_citations:hard:reported"]),
    (made(commit="a", expected_commit="b"), made(), "fail", ["commit_mismatch:hard:differs"]),
    (made(commit="a", expected_commit="a", revision="x"), made(), "pass", []),
    (made(notes=[{"deep": {"x": "token=abcdefghijklmnop"}}]), made(), "fail", ["credential_leakage:hard:found"]),
    (made(), made(profile="other"), "not_comparable", []),
    (made(), made(quality="absent"), "fail", ["quality:schema:missing"]),
    (made(quality=0.885), made(), "fail", ["quality:tolerance:fell"]),
    (made(quality=0.895), made(), "pass", []),
    (made(quality=89.5), made(quality=90), "pass", []),
    (made(p95=121, cost=1.7), made(), "fail", ["p95:tolerance:grew"]),
    (made(cost=0.01), made(cost=0), "fail", ["cost:tolerance:grew"]),
]


def test_each_issue_of_the_gate(spark):
    rows = spark.createDataFrame([(i, c, b) for i, (c, b, *_) in enumerate(CASES)], "report_id long, c string, b string")
    out = gate.report_issues(rows.select("report_id", F.col("c").alias("report")), rows.filter("b is not null").select("report_id", F.col("b").alias("report")))
    got = {r["report_id"]: (r["status"], [":".join(x) for x in r["issues"]]) for r in out.collect()}
    assert got == {i: (s, x) for i, (_, _, s, x) in enumerate(CASES)}
    assert gate.report_issues(rows.limit(0).select("report_id", F.col("c").alias("report")), rows.limit(0).select("report_id", F.col("b").alias("report"))).count() == 0


def plain_turns(turns, budget, reserve, base):
    left, out = max(0, budget - base - 48), []
    for i, (turn, full, compact) in enumerate(sorted(turns, reverse=True)):
        allowed = max(0, left - (reserve if i == 0 and len(turns) > 1 else 0))
        form, cost = "full", full
        if i < 2 and cost > allowed:
            form, cost = "compact", compact
        if cost > allowed:
            if i < 2:
                continue
            break
        out.append((turn, form, cost))
        left -= cost
    return sorted(out)


@pytest.mark.parametrize("base", [0, 300, 1752, 5000])
def test_turns_in_two_forms(spark, base):
    import random

    draw = random.Random(base)
    talks = {c: [(t, n := draw.choice([1, 200, 900, 1500, 3000]), max(1, n // 3)) for t in range(draw.choice([1, 2, 3, 8]))] for c in range(40)}
    rows = spark.createDataFrame([(c, *t, base) for c, ts in talks.items() for t in ts], "conv_id long, turn long, full long, compact long, base long")
    got = {}
    for r in memory.two_form_turns(rows).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["form"], r["tokens"]))
    assert {c: sorted(x) for c, x in got.items()} == {c: x for c, ts in talks.items() if (x := plain_turns(ts, 1800, 360, base))}
    assert memory.two_form_turns(rows.limit(0)).count() == 0


def test_contradicted_facts(spark):
    cases = [
        ("os", "ubuntu 22.04", {"os": ["ubuntu 22"]}, True), ("os", "ubuntu 22.04", {"os": ["ubuntu"]}, False), ("runtime", "python", {"runtime": ["Python 3.12"]}, False),
        ("runtime", "python 3.12", {"runtime": ["!python"]}, True), ("runtime", "java", {"runtime": ["!python"]}, False), ("language", "en us", {"language": ["en"]}, True),
        ("shell", "powershell 7", {"os": ["linux"]}, True), ("shell", "zsh", {"os": ["linux", "macos"]}, False), ("shell", "bash", {"os": ["windows"]}, True),
        ("shell", "bash", {"os": ["!windows"]}, False), ("os", "windows", {"shell": ["zsh"]}, True), ("os", "windows 11", {"shell": ["zsh"]}, False), ("os", "linux", {"shell": ["cmd"]}, True),
        ("os", "linux", {}, False), ("os", None, {"os": ["linux"]}, True), ("os", "linux", None, False), ("os", "linux", {"os": []}, False),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, slot string, value string, explicit map<string,array<string>>, want boolean")
    assert rows.filter(slots.contradicted(F.col("slot"), F.col("value"), F.col("explicit")) != F.col("want")).collect() == []
