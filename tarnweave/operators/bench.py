"""Roll-ups of runs: hit rates, throughput, counters, flags, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_rates(cases: DataFrame, group: str, rank: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of cases with a rank up to k, for each group and for all."""
    each = cases.withColumn("slice", F.explode(F.array(F.col(group).cast("string"), F.lit("all"))))
    return each.groupBy("slice").agg(F.count("*").alias("cases"), *[F.round(F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double")), 6).alias(f"top{k}") for k in ks])


def throughput(requests: DataFrame, level: str, start: str, seconds: str, tokens: str) -> DataFrame:
    """Requests and tokens for each second between the first start and the last end."""
    end = F.col(start) + F.col(seconds)
    r = requests.groupBy(level).agg(F.count("*").alias("requests"), (F.max(end) - F.min(start)).alias("wall"), F.sum(tokens).alias("t"), F.round(F.avg(seconds), 6).alias("mean_seconds"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("wall")), F.lit(0.0)), 6)
    return r.select(level, "requests", rate("requests").alias("requests_per_s"), rate("t").alias("tokens_per_s"), "mean_seconds")


def k_of_n(runs: DataFrame, by: list[str], success: str) -> DataFrame:
    """ "k/n" successes for each value."""
    return runs.groupBy(*by).agg(F.format_string("%d/%d", F.count_if(F.col(success)), F.count("*")).alias("success"))


def case_flags(runs: DataFrame) -> DataFrame:
    """runs (fixed, violation, reported, claimed, found array, needed array of term groups) -> success, false_success, diagnosed."""
    hit = F.forall("needed", lambda g: F.exists(g, lambda t: F.array_contains("found", t)))
    return runs.withColumns({"success": F.col("fixed") & ~F.col("violation") & F.col("reported"), "false_success": F.col("claimed") & ~F.col("fixed"), "diagnosed": hit})


def tested_after_change(trace: DataFrame, run: str, order: str, kind: str) -> DataFrame:
    """Whether a run's last restart comes after its last change; -1 stands for none."""
    last = lambda k: F.coalesce(F.max(F.when(F.col(kind) == k, F.col(order))), F.lit(-1))
    return trace.groupBy(run).agg((last("restart") > last("change")).alias("tested"))


def completeness(candidate: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, missing, extra): keys whose number of rows differs between two runs."""
    c, e = candidate.groupBy(key).agg(F.count("*").alias("c")), expected.groupBy(key).agg(F.count("*").alias("e"))
    d = e.join(c, key, "full").withColumns({"c": F.coalesce("c", F.lit(0)), "e": F.coalesce("e", F.lit(0))})
    return d.filter("c <> e").select(key, F.greatest(F.col("e") - F.col("c"), F.lit(0)).alias("missing"), F.greatest(F.col("c") - F.col("e"), F.lit(0)).alias("extra"))


def memory_audit(learned: DataFrame, truth: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Learned facts that the truth lacks, by run."""
    wrong = learned.join(truth.select(*keys).distinct(), keys, "left_anti").groupBy(by).agg(F.count("*").alias("wrong"))
    total = learned.groupBy(by).agg(F.count("*").alias("learned"))
    return total.join(wrong, by, "left").select(by, "learned", F.coalesce("wrong", F.lit(0)).cast("long").alias("wrong"))


def blank_secrets(rows: DataFrame, run: str, text: str, secrets: DataFrame, secret: str) -> DataFrame:
    """rows with every secret of their run replaced, the longest first; secrets of a run are few."""
    s = secrets.filter(F.length(secret) >= 4).groupBy(run).agg(F.collect_set(secret).alias("s"))
    longest = F.array_sort("s", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.aggregate(longest, F.col(text), lambda t, x: F.replace(t, x, F.lit("[redacted]")))
    return rows.join(s, run, "left").withColumn(text, F.when(F.col("s").isNull(), F.col(text)).otherwise(clean)).drop("s")


def last_modes(results: DataFrame, key: str, mode: str, order: list[str]) -> DataFrame:
    """mode, n: the last result of each key counts."""
    last = results.groupBy(key).agg(F.max_by(mode, F.struct(*order)).alias("mode"))
    return last.groupBy("mode").agg(F.count("*").alias("n"))


def turn_counts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns of a user with text by conversation, at least one."""
    said = (F.col("role") == "user") & (F.coalesce("text", F.lit("")) != "")
    return turns.groupBy(key).agg(F.greatest(F.count_if(said), F.lit(1)).alias("turns"))


def broken_texts(docs: DataFrame, by: str) -> DataFrame:
    """n, and how many hold a replacement sign, by a column."""
    return docs.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("\ufffd"))).alias("broken"))
