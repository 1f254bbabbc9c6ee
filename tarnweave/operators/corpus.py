"""Training-set builders: leakage checks, splits, merges, trajectories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.functions import safety
from tarnweave.functions.scores import hash_bucket
from tarnweave.functions.text import dedup_key, estimate_tokens
from tarnweave.operators import nearness
from tarnweave.sources.tables import written


def drop_exact(rows: DataFrame, text: str, protected: DataFrame, protected_text: str) -> DataFrame:
    """Rows whose letters and digits equal no protected text's; digests are joined, so no text is shuffled for its key."""
    p = protected.select(F.sha2(dedup_key(F.col(protected_text)), 256).alias("__k")).distinct()
    return rows.withColumn("__k", F.sha2(dedup_key(F.col(text)), 256)).join(p, "__k", "left_anti").drop("__k")


def nearest_protected(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """rows (vec_id, embedding) that have a vector, with the largest cosine to a protected one (query_id, embedding)."""
    return nearest_of_protected(rows, protected).filter("nearest is not null").select("vec_id", "nearest", "cosine")


def nearest_of_protected(rows: DataFrame, protected: DataFrame, block: int = 2048) -> DataFrame:
    """Every row (vec_id, embedding) with the protected vector (query_id, embedding) of largest cosine, of equals the least id.

    The protected vectors are a stated set and go out in blocks of bounded size; the rows stay where
    they are and are read once a block. vec_id is a key. Rows without a vector, or with nothing
    protected, have null for both.
    """
    spark, out, held = rows.sparkSession, None, protected.select("query_id", "embedding").filter("embedding is not null").toLocalIterator()
    rows = rows.select("vec_id", "embedding")
    while part := [r for _, r in zip(range(block), held, strict=False)]:
        part.sort(key=lambda r: r["query_id"])
        q = np.array([r["embedding"] for r in part], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in part]), q))

        def run(frames, shared=shared):
            ids, q = shared.value
            for whole in frames:
                for at in range(0, len(whole), 1024):
                    f = whole.iloc[at : at + 1024]
                    c = np.stack(f["embedding"].to_numpy()).astype(np.float64)
                    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
                    s = np.round(c @ q.T, 6)
                    best = s.argmax(axis=1)  # the first of equals, and ids ascend
                    yield pd.DataFrame({"vec_id": f["vec_id"].to_numpy(), "nearest": ids[best], "cosine": s[np.arange(len(s)), best]})

        found = rows.filter("embedding is not null").mapInPandas(run, "vec_id long, nearest long, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "vec_id long, nearest long, cosine double")
    best = out.groupBy("vec_id").agg(F.max_by(F.struct("nearest", "cosine"), F.struct("cosine", -F.col("nearest"))).alias("b"))
    return rows.select("vec_id").join(best, "vec_id", "left").select("vec_id", "b.nearest", "b.cosine")


def split(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Adds split: val for about ``percent`` of a hundred keys by SHA-1, else train. All rows of a key go together."""
    return rows.withColumn("split", F.when(hash_bucket(F.col(key).cast("string")) < percent, "val").otherwise("train"))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, before any filter on its content."""
    cols = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def first_source_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in order of priority; a key comes from the first part that has it."""
    out = parts[0].withColumn("priority", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("priority", F.lit(i)))
    best = F.min("priority").over(W.partitionBy(key))
    return out.withColumn("best", best).filter("priority = best").drop("best")


def _head_kept(vectors: DataFrame, most: float, block: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(vec_id kept of the first ``block`` vectors in order, all later vectors that are near none of these, the kept vectors).

    At most ``block`` vectors reach the driver.
    """
    spark, rows = vectors.sparkSession, vectors.orderBy("h", "vec_id").limit(block).collect()
    if not rows:
        return vectors.select("vec_id"), vectors, np.zeros((0, 1))
    m = nearness.units(r["embedding"] for r in rows)
    kept: list[int] = []
    for i in range(len(m)):
        if not kept or (m[kept] @ m[i]).max() < most:
            kept.append(i)
    shared = spark.sparkContext.broadcast(m[kept])

    def far(frames):
        for whole in frames:
            for at in range(0, len(whole), 1024):
                f = whole.iloc[at : at + 1024]
                yield f[(nearness.units(f["embedding"]) @ shared.value.T).max(axis=1) < most]

    later = vectors.filter((F.col("h") > rows[-1]["h"]) | ((F.col("h") == rows[-1]["h"]) & (F.col("vec_id") > rows[-1]["vec_id"])))
    return spark.createDataFrame([(rows[i]["vec_id"],) for i in kept], "vec_id long"), later.mapInPandas(far, vectors.schema), m[kept]


def greedy_near_duplicates(vectors: DataFrame, most: float = 0.93, block: int = 2048, order: Column | None = None, pivots: int = 64) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, kept): in order, a row goes if its cosine to a kept one is ``most`` or more.

    Of identical vectors only the first can be kept, so they are folded first. The first ``block``
    rows in order are settled at once and what is near a kept one of them goes, so that a group
    which is a large part of all rows is mostly gone; the first ``pivots`` kept ones then prune the
    blocks of what is left (``nearness``). vec_id is a key. Rows without a direction (null, empty or
    all zero) are near nothing and stay. ``order`` is a long that should be random; equal ones go by
    vec_id. Without it the order is a hash of vec_id, the engine's own definition.
    """
    keyed = vectors.select("vec_id", "embedding", (F.xxhash64("vec_id") if order is None else order).alias("h"))
    pointed = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    first = keyed.filter(pointed).groupBy("embedding").agg(F.min(F.struct("h", "vec_id")).alias("r"))
    first = written(first.select("r.vec_id", "r.h", "embedding"), "first")
    head, rest, known = _head_kept(first, most, block)
    kept = head
    if len(known):
        known = known[:pivots]
        rest = written(nearness.celled(rest, known), "rest")
        kept = rest.select("vec_id").join(nearness.removed_in_order(rest, known, most, block), "vec_id", "left_anti").unionByName(head)
    kept = kept.unionByName(keyed.filter(~pointed).select("vec_id"))
    return vectors.select("vec_id").join(kept.withColumn("k", F.lit(True)), "vec_id", "left").select("vec_id", F.coalesce("k", F.lit(False)).alias("kept"))


def decontaminated(rows: DataFrame, protected: DataFrame, near: float = 0.85, most: float = 0.93, order: Column | None = None) -> DataFrame:
    """rows (vec_id, text, embedding) against protected (vec_id, text, embedding) -> (vec_id, verdict), a row each.

    ``exact_eval``: letters and digits equal a protected text's; ``near_eval``: a cosine of ``near`` or
    more (6 decimals) to a protected vector; ``near_duplicate``: of the rows left, in order, a cosine of
    ``most`` or more to one that is kept; else ``kept``. Earlier verdicts win, and a row that goes by one
    of the first two takes no other with it. Null texts equal nothing; a text without letters and digits
    equals any other such. Vectors without a direction are near nothing. ``order`` as in
    ``greedy_near_duplicates``.
    """
    rows = rows.select("vec_id", "text", "embedding")
    fresh = drop_exact(rows, "text", protected.filter("text is not null"), "text").select("vec_id", "embedding")
    best = nearest_of_protected(fresh, protected.select(F.col("vec_id").alias("query_id"), "embedding"))
    close = written(best.filter(F.col("cosine") >= near).select("vec_id"), "close")
    left = written(fresh.join(close, "vec_id", "left_anti"), "left")
    late = greedy_near_duplicates(left, most, order=order).select("vec_id", F.when(F.col("kept"), "kept").otherwise("near_duplicate").alias("v"))
    settled = late.unionByName(close.withColumn("v", F.lit("near_eval")))
    return rows.select("vec_id").join(settled, "vec_id", "left").select("vec_id", F.coalesce("v", F.lit("exact_eval")).alias("verdict"))


def trajectories(turns: DataFrame, most_chars: int) -> DataFrame:
    """turns (conv_id, turn, role, text) -> one sample for each answered turn, with its split; safety is not looked at.

    n_context counts the turns before the answer; answers beyond ``most_chars`` go.
    """
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    t = turns.withColumns({"n_context": F.count("*").over(w), "context_chars": F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))})
    s = t.filter((F.col("role") == "assistant") & (F.col("n_context") > 0) & (F.length("text") + F.col("context_chars") <= most_chars))
    return split(s.select("conv_id", "turn", "n_context", "context_chars"), "conv_id", 4)


def unsafe(text: Column) -> Column:
    """A secret, an attempt to steer an agent, or a command that can't be undone."""
    risky = F.size(safety.findings(text)) > 0
    return F.coalesce(safety.is_sensitive(text) | safety.looks_like_instruction(text) | risky, F.lit(False))


def safe_trajectories(turns: DataFrame, most_tokens: int = 12288) -> DataFrame:
    """turns (conv_id, turn, role, text) -> one sample for each answered turn of a conversation without an unsafe turn, with its split.

    n_context and context_tokens are of the turns before the answer; samples whose estimated
    tokens, answer included, are beyond ``most_tokens`` go. An answer without text is none.
    """
    bad = turns.filter(unsafe(F.col("text"))).select("conv_id").distinct()
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    t = turns.join(bad, "conv_id", "left_anti").withColumn("tokens", estimate_tokens(F.col("text")))
    t = t.withColumns({"n_context": F.count("*").over(w), "context_tokens": F.coalesce(F.sum("tokens").over(w), F.lit(0))})
    s = t.filter((F.col("role") == "assistant") & F.col("text").isNotNull() & (F.col("n_context") > 0) & (F.col("tokens") + F.col("context_tokens") <= most_tokens))
    return split(s.select("conv_id", "turn", "n_context", "context_tokens"), "conv_id", 4)


def protected_texts(topics: DataFrame, evaluation: DataFrame) -> DataFrame:
    """topics (title, aliases) and evaluation (query) -> text: all distinct names and questions that training data must not hold."""
    names = topics.select(F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"))
    every = names.unionByName(evaluation.select(F.col("query").alias("text"))).select(F.trim("text").alias("text"))
    return every.filter("text <> ''").distinct()


def last_good_call(calls: DataFrame) -> DataFrame:
    """calls (qid, pos, task, finish, content) -> the last answer call of each question whose content is a JSON object with a summary."""
    summary = F.get_json_object("content", "$.summary")
    good = calls.filter((F.col("task") == "answer") & (F.col("finish") == "stop") & F.startswith(F.ltrim("content"), F.lit("{")) & (F.coalesce(F.trim(summary), F.lit("")) != ""))
    return good.groupBy("qid").agg(F.max_by(F.struct("pos", "content"), "pos").alias("r")).select("qid", "r.pos", F.get_json_object("r.content", "$.summary").alias("summary"))


def evaluation_cases(topics: DataFrame, all_of: str) -> DataFrame:
    """topics (id, domain, aliases) -> case_id, query, expected: a case for the first alias of a topic, for every alias in domain ``all_of``.

    Case numbers follow the topic's id and the alias's place within its domain, so they stay when other domains grow.
    """
    each = topics.select("id", "domain", F.posexplode(F.filter("aliases", lambda a: F.trim(a) != "")).alias("pos", "query")).filter((F.col("pos") == 0) | (F.col("domain") == all_of))
    n = F.row_number().over(W.partitionBy("domain").orderBy("id", "pos"))
    return each.select(F.concat(F.col("domain"), F.lit("-"), F.lpad(n.cast("string"), 5, "0")).alias("case_id"), "query", F.col("id").alias("expected"))


def follow_up_cases(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> a case for each user turn after another: the question before it, and the follow-up."""
    w = W.partitionBy("conv_id").orderBy("turn")
    asked = turns.filter("role = 'user'").withColumns({"previous": F.lag("text").over(w), "n": F.row_number().over(w)})
    return asked.filter("n > 1").select("conv_id", "turn", "previous", F.col("text").alias("follow_up"))


def run_samples(runs: DataFrame, turns: DataFrame, tools: list[str], percent: int = 10) -> DataFrame:
    """runs (run_id, app, success, false_success, violation), turns (run_id, pos, called, tokens) -> samples of the runs worth learning from.

    A run counts if it succeeded, not only by its own word, and broke no rule; a turn, if it calls tools, all of them known.
    The split is by app, so that no app is in both parts.
    """
    good = runs.filter("success and not coalesce(false_success, false) and not coalesce(violation, false)").select("run_id", "app")
    known = F.array(*[F.lit(t) for t in tools])
    t = turns.filter((F.size(F.coalesce("called", F.array().cast("array<string>"))) > 0) & (F.size(F.array_except("called", known)) == 0))
    return split(t.join(good, "run_id"), "app", percent)
