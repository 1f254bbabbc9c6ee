"""Whether the results of an evaluation cover its suites: order-free fingerprints, counts by case, calls by turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[str]) -> Column:
    """Columns as one string that tells values, lengths and nulls apart."""
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def fingerprints(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, n, fingerprint) of the multiset of rows of each dataset, whatever their order.

    Two sums of 60 bits each of the rows' SHA-256 are added up before the shuffle; a repeated row counts
    each time. Null in ``by`` is a dataset of its own; a dataset without rows has no fingerprint.
    """
    digest = F.sha2(row_text(columns), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    g = rows.select(by, part(1).alias("a"), part(16).alias("b")).groupBy(by).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return g.select(by, "n", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "a", "b")]), 256).alias("fingerprint"))


def fingerprint_issues(now: DataFrame, reported: DataFrame, by: str) -> DataFrame:
    """(dataset, rule): datasets of which a report has no fingerprint, another one, or that are not known now."""
    a, b = (d.select(F.col(by).cast("string").alias(k), F.col("fingerprint").alias(f)) for d, k, f in ((now, "k", "now"), (reported, "k2", "was")))
    rule = F.when(F.col("was").isNull(), "fingerprint_missing").when(F.col("now").isNull(), "fingerprint_unknown").when(F.col("now") != F.col("was"), "fingerprint_differs")
    return a.join(b, F.col("k").eqNullSafe(F.col("k2")), "full").select(F.coalesce("k", "k2").alias("dataset"), rule.alias("rule")).filter("rule is not null")


def turns_of_cases(cases: DataFrame, turns: DataFrame) -> DataFrame:
    """cases (case_id, previous_query), turns (case_id, role, text) -> cases with n_turns, the questions of their user.

    A case with turns has as many as the user has turns with text, at least one; a turn without a role
    is the user's. A case without turns has two if there is a previous question, else one.
    """
    said = (F.lower(F.coalesce("role", F.lit("user"))) == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    n = turns.groupBy("case_id").agg(F.greatest(F.count_if(said), F.lit(1)).alias("n_turns"))
    alone = F.when(F.coalesce("previous_query", F.lit("")) != "", F.lit(2)).otherwise(F.lit(1)).cast("long")
    return cases.join(n, "case_id", "left").withColumn("n_turns", F.coalesce("n_turns", alone))


def case_issues(expected: DataFrame, results: DataFrame, calls: DataFrame, model: bool) -> DataFrame:
    """(dataset, case_id, rule): everything that speaks against a release, a row each.

    expected (dataset, case_id, n_turns, may_skip); results (case_id, result_no, skipped), where
    result_no tells the results of a case apart; calls (case_id, result_no, attempted, fallback_reason).
    Rules: ``expected_twice`` (a case stands twice in the suites), ``lost``, ``duplicate``, ``foreign``,
    ``skipped`` (not permitted); with ``model`` also ``calls`` (not one for each turn), ``call_invalid``
    (attempted is null) and, without a case, ``no_success``: no call was attempted and did not fall back.
    A null case_id is a result of no case: foreign. Counts meet in joins by case, so no case's
    results or calls are gathered.
    """
    e = expected.filter("case_id is not null").groupBy("case_id").agg(F.min("dataset").cast("string").alias("dataset"), F.count("*").alias("n_e"), F.max("n_turns").alias("n_turns"), F.min("may_skip").alias("may_skip"))
    r = results.groupBy("case_id").agg(F.count("*").alias("n_r"))
    rules = lambda *pairs: F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))).alias("rule")
    known = F.col("n_e").isNotNull()
    counted = e.join(r, "case_id", "full").select("dataset", "case_id", rules(
        (F.col("n_e") > 1, "expected_twice"), (F.col("n_r").isNull(), "lost"), (known & (F.col("n_r") > 1), "duplicate"), (~known, "foreign"),
    ))
    good = F.coalesce("attempted", F.lit(False)) & (F.coalesce("fallback_reason", F.lit("")) == "")
    c = calls.groupBy("case_id", "result_no").agg(F.count("*").alias("n_c"), F.count_if(F.col("attempted").isNull()).alias("n_bad"), F.count_if(good).alias("n_good"))
    each = results.join(e, "case_id").join(c, ["case_id", "result_no"], "left")
    skipped = F.coalesce("skipped", F.lit(False))
    ran = F.lit(model) & ~skipped
    found = each.select("dataset", "case_id", rules(
        (skipped & ~F.coalesce("may_skip", F.lit(False)), "skipped"), (ran & (F.coalesce("n_c", F.lit(0)) != F.col("n_turns")), "calls"), (ran & (F.col("n_bad") > 0), "call_invalid"),
    )).distinct()
    out = counted.unionByName(found)
    if model:
        none = each.filter(~skipped).agg(F.coalesce(F.sum("n_good"), F.lit(0)).alias("n")).filter("n = 0")
        out = out.unionByName(none.select(F.lit(None).cast("string").alias("dataset"), F.lit(None).cast(expected.schema["case_id"].dataType).alias("case_id"), F.lit("no_success").alias("rule")))
    return out
