"""Catalog building: assembly of blocks, key checks, overlays, corrections, routing of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.functions.text import bind, routing_tokens


def assemble(blocks: DataFrame, doc: str, idx: str, text: str) -> DataFrame:
    """Start and end of each block in the document that joins its blocks by an empty line."""
    before = F.sum(F.length(text) + 2).over(W.partitionBy(doc).orderBy(idx).rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return blocks.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(text))


def ingest_unique(uploads: DataFrame, scope: str, sha: str, key: str) -> DataFrame:
    """The upload of least key for each (scope, content hash)."""
    cols = [c for c in uploads.columns if c not in (scope, sha)]
    first = uploads.groupBy(scope, sha).agg(F.min_by(F.struct(*cols), key).alias("r"))
    return first.select(scope, sha, *[F.col(f"r.{c}").alias(c) for c in cols])


def reference_errors(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(key, rule): keys that occur twice, and keys without a parent."""
    twice = rows.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate").alias("rule"))
    orphan = rows.select(key).distinct().join(parents.select(F.col(parent_key).alias(key)), key, "left_anti").select(key, F.lit("orphan").alias("rule"))
    return twice.unionByName(orphan)


def label_code_pairs(lines: DataFrame, group: str, order: str, kind: str, within: int = 4) -> DataFrame:
    """Each label row with the first code row among the next ``within`` rows, before another label."""
    w = W.partitionBy(group).orderBy(order)
    out = lines.withColumn("ahead", F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k"))).over(w.rowsBetween(1, within)))
    hit = F.filter("ahead", lambda x: x["k"].isin("label", "code"))
    first = F.get(hit, F.lit(0))
    return out.filter(F.col(kind) == "label").filter(first["k"] == "code").select(group, F.col(order).alias("label_at"), first["o"].alias("code_at"))


def skeleton(code: Column) -> Column:
    """A command without what its placeholders and numbers stand for."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(code), r"<[^<>]*>|\{\{[^{}]*\}\}|[0-9]+", "_"), r"\s+", " "))


def overlay(rows: DataFrame, code: str, patches: DataFrame, patch_code: str, value: str) -> DataFrame:
    """rows with ``value`` of the patch of equal skeleton; null where there is none."""
    p = patches.select(skeleton(F.col(patch_code)).alias("__s"), F.col(value)).groupBy("__s").agg(F.min(value).alias(value))
    return rows.withColumn("__s", skeleton(F.col(code))).join(p, "__s", "left").drop("__s")


def corrections(rows: DataFrame, key: str, patches: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with patched values, patches that fit no row)."""
    p = patches.select(key, F.col(value).alias("__new"))
    fixed = rows.join(p, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")
    return fixed, patches.join(rows.select(key), key, "left_anti")


def query_variants(text: Column, most: int = 4) -> Column:
    """The query first, then its parts at conjunctions and line ends, without repeats."""
    parts = F.filter(F.transform(F.split(text, r"\s+(?:and|und|y|et)\s+|[;；\n]|以及|和"), lambda x: F.trim(x)), lambda x: F.length(x) >= 3)
    return bind(parts, lambda p: F.slice(F.array_distinct(F.concat(F.array(F.trim(text)), F.when(F.size(p) > 1, p).otherwise(F.array().cast("array<string>")))), 1, most))


def infer_domain(queries: DataFrame, topics: DataFrame, margin: float = 0.75) -> DataFrame:
    """queries (query_id, text), topics (domain, text) -> query_id, domain or null.

    A token is worth its length up to 32, over 32, for each domain that uses it; the best
    domain must lead the next one by ``margin``.
    """
    index = topics.select("domain", F.explode(routing_tokens(F.col("text"))).alias("token")).distinct()
    asked = queries.select("query_id", F.explode(routing_tokens(F.col("text"))).alias("token"))
    score = asked.join(index, "token").groupBy("query_id", "domain").agg(F.round(F.sum(F.least(F.length("token"), F.lit(32)) / 32), 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "domain")
    best = score.withColumns({"n": F.row_number().over(w), "second": F.lead("score").over(w)}).filter("n = 1")
    clear = F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.when(clear, F.col("domain")).alias("domain"))


def command_language(code: Column) -> Column:
    low = F.lower(F.trim(code))
    sql = low.rlike(r"^(?:select|insert|update|delete|create|alter|drop|truncate|with)\b")
    shell = low.rlike(r"^(?:get-|set-|new-|remove-|start-|stop-|restart-|test-)\w+")
    return F.when(sql, "sql").when(shell, "powershell").otherwise("bash")


def last_mention(text: Column, options: dict[str, list[str]]) -> Column:
    """The option whose word stands last in the text; null without any."""
    low = F.lower(text)
    at = lambda w: F.when(F.contains(low, F.lit(w)), F.length(low) - F.locate(w[::-1], F.reverse(low)) - len(w) + 2)
    places = F.array(*[F.struct(F.greatest(F.lit(-1), *[F.coalesce(at(w), F.lit(-1)) for w in words]).alias("p"), F.lit(o).alias("o")) for o, words in options.items()])
    return bind(F.array_max(places), lambda b: F.when(b["p"] > 0, b["o"]))


def operation_label(changes: DataFrame, key: str, action: str) -> DataFrame:
    """ADD if all are, SUPERSEDE if any is, UPDATE if any is, else NOOP."""
    a = F.col(action)
    return changes.groupBy(key).agg(
        F.when(F.bool_and(a == "ADD"), "ADD").when(F.bool_or(a == "SUPERSEDE"), "SUPERSEDE").when(F.bool_or(a == "UPDATE"), "UPDATE").otherwise("NOOP").alias("operation")
    )


def contradicts(memory: Column, mentions: Column) -> Column:
    """memory (slot, value), mentions (slot, value with ! for a negation): another value, or its negation, in the same slot."""
    same = lambda m: m["slot"] == memory["slot"]
    other = lambda m: F.when(F.startswith(m["value"], F.lit("!")), F.substr(m["value"], F.lit(2)) == memory["value"]).otherwise(m["value"] != memory["value"])
    return F.exists(mentions, lambda m: same(m) & other(m))
