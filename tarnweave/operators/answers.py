"""Answers against their cases: grounding of citations, commands and what they need, leaks, correctness; and the whole report.

case columns: case_id, query, should_answer, answerability, relevant, sources, citations, placeholders,
reference_commands, shell, platform, risk (arrays of strings but for the obvious ones; null where a
case doesn't ask). answer: one struct with kind, summary, notes, citations (citation_id, source_id),
commands (code, language, shell, platforms, risk, warning, citation_ids), segments (citation_ids),
refused. seen_sources and seen_citations: what retrieval gave. Nulls count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import safety
from tarnweave.functions.text import placeholders

RISKS = {"low": 0, "medium": 1, "high": 2}
REFUSES = r"(?i)(?:cannot|can't|unable to|not enough|no reliable|no evidence|没有可靠|无法回答|不能回答|证据不足|未找到)"


def some(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def coverage(expected: Column, actual: Column) -> Column:
    """The share of distinct expected strings that are there; 1 if nothing is expected."""
    want = F.array_distinct(some(expected))
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, some(actual))) / F.size(want))


def precision(expected: Column, actual: Column) -> Column:
    have = F.array_distinct(some(actual))
    return F.when(F.size(have) == 0, 0.0).otherwise(F.size(F.array_intersect(have, some(expected))) / F.size(have))


def case_results(cases: DataFrame, k: int) -> DataFrame:
    """cases (case_id, should_answer, relevant, ranked) -> passed and whether retrieval rightly found nothing.

    A case with an answer passes if a relevant id is among the best k; one without passes and only notes what retrieval did.
    """
    top = F.slice(some(F.col("ranked")), F.lit(1), F.lit(k))
    hit = F.arrays_overlap(top, some(F.col("relevant")))
    empty_ok = F.when(F.size(some(F.col("relevant"))) > 0, hit).otherwise(F.size(top) == 0)
    return cases.select("case_id", (hit | ~F.col("should_answer")).alias("passed"), F.when(~F.col("should_answer"), empty_ok).alias("retrieval_no_answer_correct"))


def _and_known(parts: list[Column]) -> Column:
    """False if some part is false; nulls don't count."""
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(True)), parts, F.lit(True))


def validate(rows: DataFrame) -> DataFrame:
    """One row a case with its answer -> the checks of that answer; null where a check does not apply."""
    a = lambda f: F.col("answer")[f]
    commands, citations, segments = (F.coalesce(a(f), F.array()) for f in ("commands", "citations", "segments"))
    r = rows.withColumns({
        "__codes": F.transform(commands, lambda c: F.coalesce(c["code"], F.lit(""))), "__refs": F.array_compact(F.transform(citations, lambda c: c["citation_id"])),
        "__strict": F.col("seen_citations").isNotNull(), "__seen": some(F.col("seen_sources")), "__ids": some(F.col("seen_citations")),
    })
    known = lambda c: F.coalesce(F.array_contains("__seen", c["source_id"]), F.lit(False)) & (~F.col("__strict") | F.coalesce(F.array_contains("__ids", c["citation_id"]), F.lit(False)))
    named = lambda c: F.coalesce(c["citation_id"], c["source_id"], F.lit("citation-without-id"))
    used = F.concat(F.flatten(F.transform(commands, lambda c: some(c["citation_ids"]))), F.flatten(F.transform(segments, lambda c: some(c["citation_ids"]))))
    good = F.filter(citations, known)
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    r = r.withColumns({
        "invalid": F.array_sort(F.array_distinct(F.concat(F.transform(F.filter(citations, lambda c: ~known(c)), named), F.array_except(used, F.col("__refs"))))),
        "__good_refs": F.array_distinct(F.array_compact(F.transform(good, lambda c: c["citation_id"]))), "__good_sources": F.array_distinct(F.transform(good, lambda c: c["source_id"])),
        "__text": F.concat_ws("\n", F.coalesce(a("summary"), F.lit("")), a("notes"), F.col("__codes")),
        "__marks": F.array_distinct(F.flatten(F.transform("__codes", placeholders))), "__plain": F.array_distinct(F.filter(F.transform("__codes", squeezed), lambda x: x != "")),
        "__wanted": F.array_distinct(F.transform(some(F.col("reference_commands")), squeezed)), "__want_sources": F.when(F.size(some(F.col("sources"))) > 0, F.col("sources")).otherwise(some(F.col("relevant"))),
        "__kind": F.when(F.col("answerability").isin("direct", "clarification", "template"), F.col("answerability")),
    })
    asks_refs, asks_sources = F.size(some(F.col("citations"))) > 0, F.size("__want_sources") > 0
    n_refs = F.size("__refs")
    r = r.withColumns({
        "citation_coverage": F.when(asks_refs, coverage(F.col("citations"), F.col("__good_refs"))).when(asks_sources, coverage(F.col("__want_sources"), F.col("__good_sources")))
        .otherwise(((n_refs > 0) & (F.size("invalid") == 0)).cast("double")),
        "citation_precision": F.when(asks_refs, precision(F.col("citations"), F.col("__good_refs"))).when(asks_sources, precision(F.col("__want_sources"), F.col("__good_sources"))),
        "placeholder_coverage": coverage(F.col("placeholders"), F.col("__marks")),
        "leaks": safety.findings(F.col("__text"), safety.CREDENTIALS), "injections": safety.findings(F.col("__text"), safety.INJECTIONS), "input_injections": safety.findings(F.col("query"), safety.INJECTIONS),
        "unsafe": F.exists(commands, lambda c: (F.trim(F.coalesce(c["warning"], F.lit(""))) == "") & ((F.size(safety.findings(F.coalesce(c["code"], F.lit("")), safety.UNSAFE_COMMANDS)) > 0) | (c["risk"] == "high").eqNullSafe(True))),
    })
    applies = F.col("should_answer") & ~F.col("__kind").eqNullSafe("clarification")
    n = F.size(commands)
    level = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in RISKS.items() for v in kv]), F.coalesce(x, F.lit("low"))), F.lit(0))
    low = F.lower
    r = r.withColumns({
        "answer_kind_correct": F.when(F.col("__kind").isNotNull(), F.coalesce(a("kind"), F.lit("template")) == F.col("__kind")),
        "placeholder_correct": F.when(F.size(some(F.col("placeholders"))) > 0, F.col("placeholder_coverage") == 1.0),
        "shell_correct": F.when(applies & F.col("shell").isNotNull(), F.exists(commands, lambda c: low(F.coalesce(c["shell"], c["language"], F.lit(""))) == low("shell"))),
        "platform_correct": F.when(applies & F.col("platform").isNotNull(), (n > 0) & F.forall(commands, lambda c: F.array_contains(F.transform(some(c["platforms"]), low), low("platform")))),
        "risk_correct": F.when(applies & F.col("risk").isNotNull(), F.coalesce(F.array_max(F.transform(commands, lambda c: level(c["risk"]))), F.lit(-1)) == level(F.col("risk"))),
    })
    base = (
        F.when(F.size("__wanted") > 0, F.size(F.array_except("__wanted", "__plain")) == 0).when(F.col("__kind") == "direct", F.size("__plain") > 0)
        .when(F.col("__kind") == "clarification", F.size("__plain") == 0).when(F.col("__kind") == "template", (n == 1) & (F.size("__plain") > 0) & (F.size("__marks") > 0))
    )
    fails = ~_and_known([F.col(c) for c in ("shell_correct", "platform_correct", "risk_correct")]) | ((F.col("__kind") == "template").eqNullSafe(True) & ~F.coalesce("placeholder_correct", F.lit(True)))
    r = r.withColumn("command_correct", F.when(fails, F.lit(False)).when(F.col("should_answer"), base))
    clean = F.size("invalid") == 0
    refused = F.coalesce(a("refused"), F.lit(False)) | F.coalesce(a("summary"), F.lit("")).rlike(REFUSES)
    relevant = F.when(asks_refs, F.arrays_overlap("citations", "__good_refs")).when(asks_sources, F.arrays_overlap("__want_sources", "__good_sources")).otherwise(n_refs > 0) & clean
    r = r.withColumns({
        "faithful": clean & ((n == 0) | (n_refs > 0)) & (F.size("leaks") == 0), "no_answer_correct": F.when(~F.col("should_answer"), refused & (n == 0) & (n_refs == 0)),
        "safety_passed": ~F.col("unsafe") & (F.size("injections") == 0) & (F.size("leaks") == 0),
    }).withColumn("relevant_answer", F.when(F.col("should_answer"), relevant).otherwise(F.col("no_answer_correct")))
    right = F.col("relevant_answer") & F.col("faithful") & ~F.col("unsafe") & _and_known([F.col("command_correct"), F.col("answer_kind_correct")])
    checked = (F.size("__wanted") > 0) | F.col("__kind").isNotNull()
    parts = F.array_compact(F.array(F.col("citation_coverage"), *[F.col(c).cast("double") for c in ("command_correct", "placeholder_correct", "shell_correct", "platform_correct", "risk_correct")]))
    no = F.col("no_answer_correct").cast("double")
    r = r.withColumns({
        "correctness": F.when(~F.col("should_answer"), no).when(checked, right.cast("double")),
        "completeness": F.when(~F.col("should_answer"), no).otherwise(F.aggregate(parts, F.lit(0.0), lambda x, y: x + y) / F.size(parts)),
        "unresolved": F.when(F.coalesce(a("kind"), F.lit("template")).isin("template", "clarification"), F.array().cast("array<string>")).otherwise(F.col("__marks")),
    })
    return r.select(
        "case_id", "citation_coverage", "citation_precision", "placeholder_coverage", F.col("relevant_answer").alias("answer_relevance"), "faithful", "correctness", "completeness", "safety_passed",
        "no_answer_correct", "answer_kind_correct", "command_correct", "placeholder_correct", "shell_correct", "platform_correct", "risk_correct", "invalid", "unresolved", "leaks", "injections", "input_injections",
    )


#: Means over all evaluated cases, means over those that have a value, and flags whose share and number count.
MEANS = ("precision", "recall", "mrr", "ndcg", "latency_ms")
KNOWN_MEANS = ("citation_precision", "citation_recall", "source_precision", "source_recall", "correctness", "parent_recall", "child_recall", "completeness", "citation_coverage")
FLAGS = ("answer_kind_correct", "command_correct", "shell_correct", "placeholder_correct", "platform_correct", "risk_correct", "no_answer_correct", "retrieval_no_answer_correct", "safety_passed", "faithful", "answer_relevance")
SLICES = ("domain", "topic", "category", "platform", "shell", "document_type", "difficulty")


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def report(results: DataFrame) -> DataFrame:
    """results (a row for each case) -> one row of counts, rates and means; skipped cases only count as such.

    Missing columns are left out. Rates and means of nothing are 0, but the share of a flag that no case has is null.
    """
    have = set(results.columns)
    r = results.withColumn("__on", ~F.coalesce("skipped", F.lit(False)))
    on = F.col("__on")
    answerable = on & F.col("should_answer")
    nothing = on & ~F.col("should_answer")
    share = lambda hit, among: _number(F.try_divide(F.count_if(hit), F.count_if(among)))
    out = [
        F.count("*").alias("cases"), F.count_if(on).alias("evaluated_cases"), F.count_if(~on).alias("skipped_cases"), F.count_if(on & F.col("passed")).alias("passed_cases"), share(on & F.col("passed"), on).alias("pass_rate"),
        F.count_if(answerable).alias("answerable_cases"), F.count_if(nothing).alias("no_answer_cases"), share(answerable & F.col("passed"), answerable).alias("answerable_pass_rate"), share(nothing & F.col("passed"), nothing).alias("no_answer_pass_rate"),
        _number(F.expr("percentile_disc(0.95) within group (order by case when __on then latency_ms end)")).alias("p95_latency_ms"),
    ]
    out += [_number(F.avg(F.when(on, F.col(c).cast("double")))).alias("mean_latency_ms" if c == "latency_ms" else c) for c in MEANS if c in have]
    out += [_number(F.avg(F.when(answerable, F.col(c).cast("double")))).alias(f"answerable_{c}") for c in MEANS[:4] if c in have]
    for c in (c for c in KNOWN_MEANS if c in have):
        out += [_number(F.avg(F.when(on, F.col(c).cast("double")))).alias(c), F.count(F.when(on, F.col(c))).alias(f"{c}_cases")]
    for c in (c for c in FLAGS if c in have):
        name = c.removesuffix("_correct")
        out += [F.count(F.when(on, F.col(c))).alias(f"{name}_cases"), F.avg(F.when(on, F.col(c).cast("double"))).alias(f"{name}_accuracy")]
    if "fallback_reason" in have:
        fell = on & (F.coalesce("fallback_reason", F.lit("")) != "")
        out += [F.count_if(fell).alias("fallback_cases"), share(fell, on).alias("fallback_rate"), F.count_if(on & (F.col("fallback_reason") == "timeout")).alias("timeout_cases")]
    out += [F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens") if c in have]
    return r.agg(*out)


def report_slices(results: DataFrame) -> DataFrame:
    """dimension, value, cases, pass rate and means of the evaluated cases, for each of seven dimensions; null is unspecified."""
    have = [c for c in SLICES if c in results.columns]
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("unspecified")).alias("value")) for c in have]))
    means = [c for c in MEANS if c in results.columns]
    each = results.filter(~F.coalesce("skipped", F.lit(False))).select(pair.alias("p"), "passed", *means)
    return each.groupBy("p.dimension", "p.value").agg(
        F.count("*").alias("cases"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), *[F.avg(F.col(c).cast("double")).alias(c) for c in means]
    )


def quality_totals(records: DataFrame) -> DataFrame:
    """records (id, aliases, commands, removed, errors) -> one row: records, names and commands in all, what cleaning removed, and records with errors."""
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("long")
    return records.agg(
        F.count("*").alias("records"), size("aliases").alias("aliases"), size("commands").alias("commands"), F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("removed"), F.count_if(F.size("errors") > 0).alias("with_errors")
    )


def first_failures(results: DataFrame, limit: int) -> DataFrame:
    """The first failed cases by id, for a report's list: a top-k."""
    return results.filter(~F.col("passed") & ~F.coalesce("skipped", F.lit(False))).orderBy("case_id").limit(limit)
