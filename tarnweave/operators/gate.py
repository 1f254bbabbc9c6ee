"""The release gate on whole JSON reports: every reason against a release as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.nested import find_leaks

# Names under which reports give their metrics, findings and identities; provider errors.
METRICS = {
    "quality": ("quality", "quality_score", "quality_percent"),
    "p95": ("p95", "p95_ms", "latency_p95", "latency_p95_ms"),
    "cost": ("cost", "cost_usd", "cost_per_case"),
}
FINDINGS = {
    "invalid_citations": ("invalid_citations", "citation_errors"),
    "unresolved_placeholders": ("unresolved_placeholders", "placeholder_errors"),
    "credential_leakage": ("credential_leakage", "credential_leaks", "secret_leaks"),
    "injection_safety_flags": ("injection_safety_flags", "injection_flags", "prompt_injection_flags", "high_risk_safety_flags", "high_risk_flags"),
    "schema_errors": ("schema_errors", "report_schema_errors"),
    "refusal_errors": ("refusal_errors", "no_answer_failures", "incorrect_refusals"),
    "revision_mismatch": ("revision_mismatch", "source_revision_mismatch"),
    "commit_mismatch": ("commit_mismatch", "release_commit_mismatch"),
}
PROFILE = ("profile", "profile_id", "evaluation_profile")
PROVIDER_ERRORS = ("timeout", "rate_limit", "authentication", "provider_error", "invalid_json")
COUNTS = ("cases", "evaluated_cases", "skipped_cases", "passed_cases", "error_cases")

_NUMBER = "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, F.lit("$"), kind)


def _field(fields: Column, names) -> Column:
    """The value under the first of ``names`` that the report has."""
    there = F.filter(F.array(*map(F.lit, names)), lambda n: F.map_contains_key(fields, n))
    return F.try_element_at(fields, F.get(there, F.lit(0)))


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike(_NUMBER), _as(v, "double"))


def _found(v: Column) -> Column:
    """Whether a field tells of something: true, a number but 0, a text, list or object that isn't empty."""
    k = _kind(v)
    some = F.when(k == "BOOLEAN", _as(v, "boolean")).when(k.rlike(_NUMBER), _as(v, "double") != 0).when(k == "STRING", F.length(_as(v, "string")) > 0)
    some = some.when(F.startswith(k, F.lit("ARRAY")), F.size(_as(v, "array<variant>")) > 0).when(F.startswith(k, F.lit("OBJECT")), F.size(_as(v, "map<string,variant>")) > 0)
    return F.coalesce(some, F.lit(False))


def _issue(when: Column, gate: str, kind: str, reason: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(gate).alias("gate"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))


def parsed(reports: DataFrame, key: str) -> DataFrame:
    """reports (key, report) -> key and the fields that rules look at, each read from the JSON once."""
    v = reports.select(key, F.try_parse_json("report").alias("v"))
    v = v.withColumn("v", F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.col("v"))).withColumn("f", _as(F.col("v"), "map<string,variant>"))
    f = F.col("f")
    v = v.withColumns({"m": F.try_element_at(f, F.lit("metrics")), "cs": F.try_element_at(f, F.lit("cases")), "failed": F.try_element_at(f, F.lit("failed_case_ids")), "p": _field(f, PROFILE), **{f"v_{k}": _field(f, n) for k, n in METRICS.items()}})
    v = v.withColumn("mf", F.when(F.startswith(_kind(F.col("m")), F.lit("OBJECT")), _as(F.col("m"), "map<string,variant>")))
    count = lambda n: F.try_element_at("mf", F.lit(n))
    said = lambda x: F.coalesce(_as(x, "string"), F.to_json(x))
    pair = lambda k: (_field(f, (k, f"evaluated_{k}", f"actual_{k}")), _field(f, (f"expected_{k}", f"release_{k}", f"target_{k}")))
    bad = lambda x: F.coalesce(F.try_variant_get(x, F.lit("$.fallback_reason"), "string").isin(*PROVIDER_ERRORS), F.lit(False))
    calls = lambda c: F.coalesce(F.try_variant_get(c, F.lit("$.model_calls"), "array<variant>"), F.array().cast("array<variant>"))
    cases = F.when(F.startswith(_kind(F.col("cs")), F.lit("ARRAY")), _as(F.col("cs"), "array<variant>"))
    return v.select(
        key, F.col("v").isNotNull().alias("is_object"), F.when((_kind(F.col("p")) == "STRING") & (F.trim(_as(F.col("p"), "string")) != ""), F.trim(_as(F.col("p"), "string"))).alias("profile"),
        *[_number(F.col(f"v_{k}")).alias(k) for k in METRICS], F.col("mf").isNotNull().alias("has_metrics"),
        *[F.when(_kind(count(n)) == "BIGINT", F.when(_as(count(n), "long") >= 0, _as(count(n), "long"))).alias(f"n_{n}") for n in COUNTS],
        *[_number(count(n)).alias(n) for n in ("error_cases", "error_rate", "evaluated_cases", "pass_rate")],
        F.size(cases).alias("listed"), F.coalesce(F.exists(cases, lambda c: bad(c) | F.exists(calls(c), bad)), F.lit(False)).alias("provider"),
        (_kind(F.col("failed")) != "VOID").alias("has_failed"), F.when(F.startswith(_kind(F.col("failed")), F.lit("ARRAY")), _as(F.col("failed"), "array<variant>")).alias("failed"),
        F.array_compact(F.array(*[F.when(_found(_field(f, n)), F.lit(k)) for k, n in FINDINGS.items()])).alias("findings"),
        F.array_compact(F.array(*[F.when(said(pair(k)[0]) != said(pair(k)[1]), F.lit(k)) for k in ("revision", "commit")])).alias("other_identity"),
    )


def _schema_rules() -> list[Column]:
    n = {c: F.col(f"n_{c}") for c in COUNTS}
    whole = reduce(lambda a, c: a & c.isNotNull(), n.values(), F.lit(True))
    rate = F.coalesce(F.try_divide(n["passed_cases"], n["evaluated_cases"]), F.lit(0.0))
    far = F.abs(F.col("pass_rate") - rate) > F.greatest(F.lit(1e-9), F.lit(1e-6) * F.greatest(F.abs("pass_rate"), F.abs(rate)))
    schema = lambda when, gate, reason: _issue(F.col("is_object") & when, gate, "schema", reason)
    metric = lambda when, reason: schema(F.col("has_metrics") & whole & when, "metrics", reason)
    return [
        _issue(~F.col("is_object"), "schema", "schema", "not_an_object"), schema(F.col("profile").isNull(), "profile", "missing"),
        *[schema(F.col(m).isNull(), m, "missing") for m in METRICS], *[schema(F.col(m) < 0, m, "negative") for m in METRICS],
        schema(~F.col("has_metrics"), "metrics", "missing"), *[schema(F.col("has_metrics") & c.isNull(), "metrics", f"{k}_no_count") for k, c in n.items()],
        metric(n["cases"] < 1, "no_case"), metric(n["evaluated_cases"] < 1, "none_evaluated"), metric(n["evaluated_cases"] > n["cases"], "evaluated_over_cases"),
        metric(n["passed_cases"] > n["evaluated_cases"], "passed_over_evaluated"), metric(n["skipped_cases"] != n["cases"] - n["evaluated_cases"], "skipped"),
        metric(n["error_cases"] > n["evaluated_cases"], "errors_over_evaluated"), metric(n["passed_cases"] == 0, "none_passed"),
        metric(F.col("listed").isNull(), "no_list"), metric(F.col("listed") != n["cases"], "list_length"),
        metric(F.col("has_failed") & (F.col("failed").isNull() | F.exists("failed", lambda x: _kind(x) != "STRING")), "failed_ids"),
        metric(far, "pass_rate"), schema(F.array_contains("findings", "schema_errors"), "schema_errors", "reported"),
    ]


def schema_issues(fields: DataFrame, key: str) -> DataFrame:
    """fields of ``parsed`` -> key, gate, kind, reason of what makes a report unfit to be judged."""
    return fields.select(key, F.inline(F.array_compact(F.array(*_schema_rules()))))


def report_issues(candidates: DataFrame, baselines: DataFrame, key: str = "report_id", slower: float = 0.2) -> DataFrame:
    """candidates and baselines (key, report as JSON) -> key, status, comparable and issues, an array of (gate, kind, reason) in order.

    A report that isn't fit to be judged or has a hard finding fails whatever the baseline says; without a baseline
    it must be a clean run with no failed case; a baseline of another profile gives not_comparable; then
    quality may fall by a point (of 100, or 0.01 if both are fractions), p95 and cost may grow by a fifth, and from 0 not at all. A
    baseline that is unfit fails too, by its own issues. A null or broken report is no object. Keys are unique on both sides.
    """
    c, b = parsed(candidates, key), parsed(baselines, key)
    leaks = find_leaks(candidates, "report", [key]).select(key).distinct().withColumn("leak", F.lit(True))
    base = b.select(key, F.struct("profile", *METRICS).alias("b"), F.array_compact(F.array(*_schema_rules())).alias("unfit"))
    j = c.join(leaks, key, "left").join(base, key, "left")
    n_failed = F.size("failed")
    alone = F.col("b").isNull()
    hard = lambda when, gate, reason: _issue(F.col("is_object") & when, gate, "hard", reason)
    errors = F.when(F.col("error_cases") > 0, True).otherwise(F.coalesce(F.col("error_rate") > 0, F.lit(False)))
    rules = [
        hard(errors, "execution_errors", "errors"), hard(F.col("evaluated_cases") <= 0, "empty_evaluation", "empty"), hard(F.col("provider"), "provider_failures", "hidden"),
        hard(alone & (n_failed > 0), "failed_cases_without_baseline", "failed"), hard(alone & (F.col("quality") == 0) & (F.coalesce("evaluated_cases", F.lit(0.0)) != 0), "zero_quality", "zero"),
        *[hard(F.array_contains("findings", k), k, "reported") for k in FINDINGS if k != "schema_errors"],
        *[hard(F.array_contains("other_identity", k), f"{k}_mismatch", "differs") for k in ("revision", "commit")], hard(F.col("leak"), "credential_leakage", "found"),
    ]
    fraction = F.col("quality").between(0, 1) & F.col("b.quality").between(0, 1)
    fell = F.col("quality") < F.col("b.quality") - F.when(fraction, 0.01).otherwise(1.0)
    grew = lambda m: F.when(F.col(f"b.{m}") == 0, F.col(m) > 0).otherwise(F.col(m) > F.col(f"b.{m}") * (1 + slower))
    moved = [_issue(fell, "quality", "tolerance", "fell"), *[_issue(grew(m), m, "tolerance", "grew") for m in ("p95", "cost")]]
    j = j.withColumns({"own": F.array_compact(F.array(*_schema_rules(), *rules)), "moved": F.array_compact(F.array(*moved))})
    other = F.col("profile") != F.col("b.profile")
    none = F.slice("moved", 1, 0)
    stage = F.when(F.size("own") > 0, "own").when(alone, "alone").when(F.size("unfit") > 0, "unfit").when(other, "other").otherwise("moved")
    j = j.withColumn("stage", stage)
    s = F.col("stage")
    issues = F.when(s == "own", F.col("own")).when(s == "unfit", F.col("unfit")).when(s == "moved", F.col("moved")).otherwise(none)
    status = F.when(s == "other", "not_comparable").when(F.size("issues") > 0, "fail").otherwise("pass")
    return j.withColumn("issues", F.array_sort(F.array_distinct(issues))).select(key, status.alias("status"), s.isin("alone", "moved").alias("comparable"), "issues")
