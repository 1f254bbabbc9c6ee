"""Ranking metrics, reports, slices and the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.functions.scores import p95_nearest


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """ranking (query_id, doc_id, rank), qrels (query_id, doc_id, relevance) -> precision, recall, mrr, ndcg at k.

    Precision divides by k. A document that is listed twice counts once for precision and
    recall and gains nothing the second time. Judgments of 0 and less are none. Queries come
    from the judgments; one without a ranking scores 0.
    """
    good = qrels.filter("relevance > 0").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("rel"))
    first = ranking.filter(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = first.join(good, ["query_id", "doc_id"])
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1.0)
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id"))
    total = good.groupBy("query_id").agg(F.count("*").alias("total"))
    ideal = good.withColumn("rank", place).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("idcg"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return total.join(ideal, "query_id").join(per, "query_id", "left").select(
        "query_id", zero(F.col("n") / k).alias("precision"), zero(F.col("n") / F.col("total")).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
    )


def set_precision_recall(rows: DataFrame, actual: str, expected: str) -> DataFrame:
    """Adds set_precision and set_recall of two arrays; both null where nothing is expected."""
    a, e = F.array_distinct(actual), F.array_distinct(expected)
    n = F.size(F.array_intersect(actual, expected))
    some = F.size(e) > 0
    return rows.withColumns({
        "set_precision": F.when(some, F.round(F.coalesce(F.try_divide(n, F.size(a)), F.lit(0.0)), 6)),
        "set_recall": F.when(some, F.round(F.try_divide(n, F.size(e)), 6)),
    })


def report(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: number of cases, pass rate, mean of each metric without nulls (0 if all are), nearest-rank p95 latency."""
    return cases.agg(
        F.count("*").alias("cases"), F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)), 6).alias("pass_rate"),
        *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(f"mean_{m}") for m in metrics],
        F.coalesce(F.expr("percentile_disc(0.95) within group (order by latency)"), F.lit(0.0)).alias("p95_latency"),
    )


def slices(cases: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """The report's means for each value of each dimension; the first dimension's values stand bare."""
    keys = F.array(*[F.when(F.col(d).isNotNull(), F.concat(F.lit("" if i == 0 else f"{d}:"), F.col(d).cast("string"))) for i, d in enumerate(dimensions)])
    each = cases.withColumn("slice", F.explode(F.filter(keys, lambda x: x.isNotNull())))
    return each.groupBy("slice").agg(
        F.count("*").alias("cases"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(f"mean_{m}") for m in metrics],
    )


def gate(candidate: DataFrame, baseline: DataFrame, quality: float = 0.01, slower: float = 0.2) -> DataFrame:
    """(metric, value) of two reports -> candidate, baseline, and whether the change is within tolerance.

    Metrics whose name starts with p95 or cost may grow by a fifth; all others may fall by a point.
    A metric that only one side has fails.
    """
    j = candidate.select("metric", F.col("value").alias("candidate")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full")
    costly = F.col("metric").rlike("^(?:p95|cost)")
    fine = F.when(costly, F.col("candidate") <= F.col("baseline") * (1 + slower)).otherwise(F.col("candidate") >= F.col("baseline") - quality)
    return j.withColumn("ok", F.coalesce(fine, F.lit(False)))


def latency_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank p95 by key from a sorted array; for groups of bounded size."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v")).select(key, p95_nearest(F.col("v")).alias("p95"))


def release_gate(candidate: DataFrame, baseline: DataFrame, hard: dict[str, float], profiles: tuple[str, str], quality: float = 0.01, slower: float = 0.2) -> DataFrame:
    """(metric, value) of two reports -> metric, rule for each reason against a release; none means go.

    changed: a metric fell or grew beyond tolerance; missing: only one report has it, or a hard one is in neither;
    hard: below its floor; profile: the reports are of different profiles and can't be compared.
    """
    g = gate(candidate, baseline, quality, slower)
    moved = g.filter("not ok").select("metric", F.when(F.col("candidate").isNull() | F.col("baseline").isNull(), "missing").otherwise("changed").alias("rule"))
    spark = candidate.sparkSession
    floors = spark.createDataFrame([(k, float(v)) for k, v in sorted(hard.items())], "metric string, floor double")
    h = floors.join(candidate, "metric", "left").filter(F.col("value").isNull() | (F.col("value") < F.col("floor")))
    h = h.select("metric", F.when(F.col("value").isNull(), "missing").otherwise("hard").alias("rule"))
    other = spark.createDataFrame([("profile", "profile")] if profiles[0] != profiles[1] else [], "metric string, rule string")
    return moved.unionByName(h).unionByName(other).distinct()
