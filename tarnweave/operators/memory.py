"""Conversation turns, versioned facts, episode ranking and keyed state, in batch."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.functions import safety
from tarnweave.functions.scores import age_decay, freshness, reliability
from tarnweave.functions.text import dice, estimate_tokens, signature_tokens
from tarnweave.operators import likeness
from tarnweave.sources.tables import written


def turn_pairs(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> user turns with the answer right after them.

    Only user and answered assistant rows count; the latest user turn before an answer wins, a
    second answer in a row pairs with nobody.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    m = messages.filter((F.col("role") == "user") | ((F.col("role") == "assistant") & F.col("text").isNotNull()))
    m = m.withColumns({"p_role": F.lag("role").over(w), "p_turn": F.lag("turn").over(w), "p_text": F.lag("text").over(w)})
    return m.filter("role = 'assistant' and p_role = 'user'").select(
        "conv_id", F.col("p_turn").alias("user_turn"), F.col("turn").alias("assistant_turn"), F.col("p_text").alias("question"), F.col("text").alias("answer")
    )


def after_boundary(messages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Messages after the last boundary (conv_id, turn) of their conversation; all where there is none."""
    last = boundaries.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return messages.join(last, "conv_id", "left").filter(F.col("last").isNull() | (F.col("turn") > F.col("last"))).drop("last")


def unique_recent(rows: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """The last n distinct values of each key, in the order of their last use: one window on distinct values."""
    last = rows.groupBy(key, value).agg(F.max(order).alias("at"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("at").desc(), F.col(value).desc()))
    return last.withColumn("n", place).filter(F.col("n") <= n).select(key, value, F.col("n").cast("long").alias("place"))


def budgeted_turns(turns: DataFrame, budget: int = 1800, reserve: int = 360) -> DataFrame:
    """turns (conv_id, turn, tokens) -> the newest that fit the budget, newest first.

    The two newest are skipped where they don't fit; from the third on the first overflow
    ends it; after the newest, ``reserve`` tokens are set aside. A fold, so one group a conversation.
    """

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for i, (turn, n) in enumerate(f.sort_values("turn", ascending=False)[["turn", "tokens"]].itertuples(index=False)):
            if n <= left:
                keep.append((turn, n))
                left -= n + (reserve if i == 0 else 0)
            elif i >= 2:
                break
        return pd.DataFrame({"conv_id": [f["conv_id"].iloc[0]] * len(keep), "turn": [t for t, _ in keep], "tokens": [n for _, n in keep]})

    return turns.groupBy("conv_id").applyInPandas(fold, "conv_id long, turn long, tokens long")


def two_form_turns(turns: DataFrame, budget: int = 1800, reserve: int = 360, frame: int = 48) -> DataFrame:
    """turns (conv_id, turn, full, compact, base) -> conv_id, turn, form, tokens: the newest turns that fit, in full or in compact form.

    From the budget go ``base`` (tokens of the summary) and ``frame``. The two newest turns take their compact form where the full one
    doesn't fit, and are passed over where that doesn't either; from the third on only full forms count and the first that doesn't fit
    ends it. The newest leaves ``reserve`` to the next, if there is one. A turn costs at least 1, so no more than the budget's
    newest turns of a conversation can matter: only those come together, for a fold inside the JVM.
    """
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("full").desc(), F.col("compact").desc())
    least = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1))).cast("long").alias(c)
    near = turns.withColumn("__i", F.row_number().over(newest)).filter(F.col("__i") <= budget + 3)
    rows = near.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("__i", "turn", least("full"), least("compact")))).alias("t"), F.max(F.coalesce("base", F.lit(0))).cast("long").alias("base")
    )
    kept = "array<struct<turn:{},form:string,tokens:bigint>>".format(turns.schema["turn"].dataType.simpleString())
    start = F.struct(F.greatest(F.lit(0), F.lit(budget - frame) - F.col("base")).cast("long").alias("left"), F.lit(False).alias("over"), F.array().cast(kept).alias("kept"))

    def step(s, x):
        first = (x["__i"] == 1) & (F.size("t") > 1)
        allowed = F.greatest(F.lit(0), s["left"] - F.when(first, reserve).otherwise(0))
        short = (x["__i"] <= 2) & (x["full"] > allowed)
        cost = F.when(short, x["compact"]).otherwise(x["full"])
        fits = (cost <= allowed) & ~s["over"]
        taken = F.array(F.struct(x["turn"].alias("turn"), F.when(short, "compact").otherwise("full").alias("form"), cost.alias("tokens")))
        return F.struct(
            F.when(fits, s["left"] - cost).otherwise(s["left"]).alias("left"), (s["over"] | (~fits & (x["__i"] > 2))).alias("over"),
            F.when(fits, F.concat(s["kept"], taken.cast(kept))).otherwise(s["kept"]).alias("kept"),
        )

    return rows.select("conv_id", F.inline(F.aggregate("t", start, step, lambda s: s["kept"])))


def greedy_budget(ranked: DataFrame, budget: int = 400, most: int = 4) -> DataFrame:
    """ranked (key, rank, item, tokens) -> what is taken, skipping what doesn't fit.

    Each of ``most`` rounds takes the best-ranked item after the last taken one that fits what is
    left of the budget; what once didn't fit never does later, so this is the fold over all items.
    """
    best = F.min_by(F.struct("key", "rank", "item", "tokens"), "rank").alias("p")
    rows, state = ranked.select("key", "rank", "item", "tokens"), None
    for _ in range(most):
        if state is None:
            new = rows.filter(F.col("tokens") <= budget).groupBy("key").agg(best)
            state = new.select("key", F.array("p").alias("taken"), (budget - F.col("p.tokens")).alias("left"), F.col("p.rank").alias("last"))
            continue
        s = state.select(F.col("key").alias("k"), "left", "last")
        fits = rows.join(s, F.col("key").eqNullSafe(F.col("k"))).filter((F.col("tokens") <= F.col("left")) & (F.col("rank") > F.col("last")))
        new = fits.groupBy("key").agg(best).select(F.col("key").alias("k"), "p")
        more = F.col("p").isNotNull()
        state = state.join(new, F.col("key").eqNullSafe(F.col("k")), "left").select(
            "key", F.when(more, F.concat("taken", F.array("p"))).otherwise(F.col("taken")).alias("taken"),
            F.when(more, F.col("left") - F.col("p.tokens")).otherwise(F.col("left")).alias("left"), F.coalesce("p.rank", "last").alias("last"),
        )
    return state.select(F.explode("taken").alias("t")).select("t.key", "t.rank", "t.item", "t.tokens")


def versions(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Slowly changing versions: a run of equal values (trimmed, lower-cased) is one version.

    version, value (first of the run), valid_from, valid_to (null: active), n_seen.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    norm = F.lower(F.trim(F.col(value)))
    e = events.withColumn("new", (~norm.eqNullSafe(F.lag(norm).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    e = e.withColumn("version", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    v = e.groupBy(*keys, "version").agg(
        F.min_by(value, F.struct(*order)).alias("value"), F.min(order[0]).alias("valid_from"), F.count("*").alias("n_seen")
    )
    return v.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy(*keys).orderBy("version")))


def merge_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """facts (keys, source, value, seen_at, confidence, pinned) -> the active one of each key.

    A user's fact beats a host's, later beats earlier; confidence is the largest and pinned any
    of the rows that say the winning value.
    """
    best = facts.groupBy(*keys).agg(F.max_by("value", F.struct((F.col("source") == "user").cast("int"), "seen_at", "value")).alias("win"))
    same = facts.join(best, keys).filter(F.lower(F.trim("value")) == F.lower(F.trim("win")))
    return same.groupBy(*keys).agg(F.first("win").alias("value"), F.max("confidence").alias("confidence"), F.max("pinned").alias("pinned"), F.count("*").alias("seen_count"))


def rank_episodes(episodes: DataFrame, query: str, k: int, half_life: float = 30.0) -> DataFrame:
    """episodes (query, episode, match, successes, failures, days) -> the k best of each query that aren't quarantined."""
    live = episodes.filter(~((F.col("failures") >= 2) & (F.col("failures") > F.col("successes"))))
    score = F.col("match") * (0.5 + reliability(F.col("successes"), F.col("failures"))) * (0.5 + 0.5 * freshness(F.col("days"), half_life))
    s = live.withColumn("score", F.round(score, 6))
    place = F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc(), "episode"))
    return s.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def decayed(memories: DataFrame) -> DataFrame:
    """Adds the age and use multiplier of memories (days, pinned, uses)."""
    return memories.withColumn("multiplier", F.round(age_decay(F.col("days"), F.col("pinned"), F.col("uses")), 6))


def undo_last(v: DataFrame, keys: list[str]) -> DataFrame:
    """Versions without the last one of each key; the one before becomes active again."""
    last = F.max("version").over(W.partitionBy(*keys))
    left = v.withColumn("last", last).filter("version < last").drop("last")
    newest = F.max("version").over(W.partitionBy(*keys))
    return left.withColumn("n", newest).withColumn("valid_to", F.when(F.col("version") < F.col("n"), F.col("valid_to"))).drop("n")


def expire(plans: DataFrame, now) -> DataFrame:
    return plans.withColumn("status", F.when((F.col("status") == "pending") & (F.col("expires_at") <= F.lit(now)), "expired").otherwise(F.col("status")))


def claim(tasks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pending tasks whose epoch is still the profile's."""
    return tasks.filter("status = 'pending'").join(profiles.select("user_id", F.col("epoch").alias("now_epoch")), "user_id").filter("epoch = now_epoch").drop("now_epoch")


#: Other words for a slot and for its values; fixed values.
SLOT_KEYS = {"language": ("language", "lang", "response_language", "answer_language"), "detail": ("detail", "verbosity", "detail_level"), "developer_level": ("developer_level", "expertise", "level", "skill")}
SLOT_VALUES = {
    "language": {"en": ("en", "en-us", "english", "英文", "英语"), "zh-CN": ("zh", "zh-cn", "chinese", "中文", "汉语")},
    "detail": {"concise": ("concise", "brief", "short", "简短", "简洁", "精炼"), "detailed": ("detailed", "verbose", "详细", "展开", "多解释")},
    "developer_level": {
        "beginner": ("beginner", "novice", "junior", "新手", "初学者", "入门"), "intermediate": ("intermediate", "mid", "中级"),
        "advanced": ("advanced", "senior", "expert", "高级", "资深", "专家"),
    },
}
#: Technologies by the slot they fill; they come before what a key claims. Fixed values.
TECHNOLOGIES = {
    "os": ("windows", "macos", "linux", "ubuntu", "debian"), "shell": ("powershell", "bash", "zsh"), "package_manager": ("pnpm", "npm", "yarn", "pip", "poetry"),
    "database": ("postgresql", "mysql", "sqlite", "redis"), "runtime": ("python", "node.js", "java", "go"),
}
PERSISTS = r"(?i)\b(?:always|from now on|by default|remember|prefer|in future)\b|以后|默认|记住|总是|一直|今后"
ASKS = r"[?？]\s*$|(?i)^\s*(?:what|why|how|which|who|when|where|is|are|can|does)\b|什么|怎么|如何|吗"
CORRECTS = r"(?i)\b(?:instead|not .{1,20} but|switch(?:ed)? to|no longer)\b|改用|换成|不是.{1,12}(?:而?是)"
CONSTRAINT = r"(?i)\b(?:this|our|the) project\b.{0,20}?\b(must|must not|only|never|requires?)\b([^.!?]{2,120})"


def _as_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for canonical, words in pairs.items() for w in words for x in (w, canonical)])


NEGATED = r"(?<!\bnot )(?<!instead of )(?<!rather than )(?<!no longer )(?<!no longer use )(?<!avoid )"


def _named(text: Column, word: str, before: str = "") -> Column:
    return F.lower(text).rlike(rf"(?<![a-z0-9_.+-]){before}{re.escape(word)}(?![a-z0-9_+-])")


def slot_of(key: Column, value: Column) -> Column:
    """The slot that a fact fills: by its value if that names one technology, else by its key; null if by neither."""
    slots = F.array_compact(F.array(*[F.when(_any_named(value, words), F.lit(slot)) for slot, words in TECHNOLOGIES.items()]))
    k = F.translate(F.regexp_replace(F.lower(key), r"[^a-z0-9_.:-]+", "_"), "-:", "__")
    return F.when(F.size(slots) == 1, F.get(slots, F.lit(0))).otherwise(F.coalesce(F.try_element_at(_as_map(SLOT_KEYS), k), F.when(k.isin(*TECHNOLOGIES), k)))


def _any_named(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= _named(value, w)
    return out


def canonical_value(slot: Column, value: Column) -> Column:
    """The usual word for a value of a slot; other values lower-cased with single blanks."""
    v = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    out = F.lit(None).cast("string")
    for s, values in SLOT_VALUES.items():
        out = F.when(slot == s, F.try_element_at(_as_map(values), v)).otherwise(out)
    for s, words in TECHNOLOGIES.items():
        named = F.get(F.array_compact(F.array(*[F.when(_named(value, w), F.lit(w)) for w in words])), F.lit(0))
        out = F.when(slot == s, named).otherwise(out)
    return F.coalesce(out, v)


def signal_gate(messages: DataFrame) -> DataFrame:
    """messages (id, text) -> id, slot, value, action for each thing worth remembering; the last mention of a slot wins.

    Nothing is taken from long or sensitive messages, from attempts to steer, or from mere questions.
    """
    t = F.coalesce("text", F.lit(""))
    fine = (F.length(t) <= 1200) & ~safety.is_sensitive(t) & ~safety.looks_like_instruction(t)
    lasting = (t.rlike(PERSISTS) | t.rlike(CORRECTS)) & ~t.rlike(ASKS)
    action = F.when(t.rlike(CORRECTS), "SUPERSEDE").otherwise("ADD")
    low = F.lower(t)
    last = lambda word: F.length(low) - F.instr(F.reverse(low), F.reverse(F.lit(word))) - len(word) + 2
    found = []
    for s, values in SLOT_VALUES.items():
        for canonical, words in values.items():
            for w in words:
                there = F.contains(low, F.lit(w)) if ord(w[0]) > 127 else _named(t, w, NEGATED)
                found.append(F.when(there & lasting & F.lit(len(w) > 2 or ord(w[0]) > 127), F.struct(F.lit(s).alias("slot"), last(w).alias("at"), F.lit(canonical).alias("value"))))
    for s, words in TECHNOLOGIES.items():
        for w in words:
            found.append(F.when(_named(t, w, NEGATED) & lasting, F.struct(F.lit(s).alias("slot"), last(w).alias("at"), F.lit(w).alias("value"))))
    rule = F.trim(F.concat(F.regexp_extract(t, CONSTRAINT, 1), F.regexp_extract(t, CONSTRAINT, 2)))
    found.append(F.when(t.rlike(CONSTRAINT) & ~t.rlike(ASKS), F.struct(F.lit("project_constraint").alias("slot"), F.lit(0).alias("at"), F.lower(rule).alias("value"))))
    each = messages.filter(fine).select("id", action.alias("action"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    best = each.groupBy("id", "x.slot").agg(F.max_by(F.col("x.value"), F.struct("x.at", F.length("x.value"))).alias("value"), F.first("action").alias("action"))
    return best.select("id", "slot", "value", "action")


def trusted(facts: DataFrame, text: str) -> DataFrame:
    """Facts whose stored text holds no secret and no attempt to steer; looked at again on the way out."""
    t = F.coalesce(text, F.lit(""))
    return facts.filter(~safety.is_sensitive(t) & ~safety.looks_like_instruction(t))


def payload(memories: DataFrame, most: int = 4, budget: int = 400) -> DataFrame:
    """memories (owner, place, text) -> those that go to a model: trusted, at most ``most`` in order of place, within ``budget`` estimated tokens.

    One that doesn't fit is passed over and the next ones still count: ``most`` rounds each take the first that fits.
    """
    left = trusted(memories, "text").withColumn("tokens", estimate_tokens(F.col("text")))
    taken = None
    used = left.select("owner").distinct().withColumns({"used": F.lit(0).cast("long"), "after": F.lit(-1).cast("long")})
    for _ in range(most):
        fits = left.join(used, "owner").filter((F.col("used") + F.col("tokens") <= budget) & (F.col("place") > F.col("after")))
        first = fits.groupBy("owner").agg(F.min_by(F.struct("place", "text", "tokens", "used"), "place").alias("r"))
        row = first.select("owner", "r.place", "r.text", "r.tokens", F.col("r.used").alias("before"))
        taken = row if taken is None else taken.unionByName(row)
        used = row.select("owner", (F.col("before") + F.col("tokens")).alias("used"), F.col("place").alias("after"))
    return taken.select("owner", "place", "text", "tokens")


def local_summary(turns: DataFrame, constraint: str, limit: int = 12) -> DataFrame:
    """turns (conv_id, turn, text) of users -> conv_id, goal (the last text), topics and constraints: the last distinct ones, in order."""
    full = turns.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.substring(safety.redact(F.col("text")), 1, 180))
    last = full.groupBy("conv_id", "text").agg(F.max("turn").alias("turn"), F.first(F.col("text").rlike(constraint)).alias("binds"))
    place = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    ranked = last.withColumn("n", F.row_number().over(place)).withColumn("c", F.row_number().over(W.partitionBy("conv_id", "binds").orderBy(F.col("turn").desc())))
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda x: x["text"])
    return ranked.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("goal"), ordered(F.col("n") <= limit).alias("topics"), ordered(F.col("binds") & (F.col("c") <= limit)).alias("constraints")
    )


#: Tokens whose frequency goes to all tasks, the most frequent ones; it only decides how many episodes are compared, not the result.
FREQUENT = 1 << 19
#: A side with at most so many rows is broadcast.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is cheap to read, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _rest(n: np.ndarray, least: float) -> np.ndarray:
    """How many of a set's n tokens, the most frequent ones, need no comparing: sets that are alike share one of the others too."""
    return np.maximum(np.ceil(n * (least / (2 - least)) - 1e-9).astype(np.int64) - 1, 0)


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """sets (id, grp, t) -> key, id, n: a row for each of a set's rarest tokens, all but _rest of them.

    Any order that is the same for all sets would do; by frequency, the groups of a key stay small. Tokens that
    only one set has meet nothing and are left out.
    """
    df = written(sets.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    floor, above = 2, 0
    for r in df.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.col("df").desc()).toLocalIterator():
        above += r["n"]
        if above > FREQUENT:
            floor = r["df"] + 1
            break
    table = df.filter(F.col("df") >= floor).toArrow()
    token, count = table["token"].to_numpy(), table["df"].to_numpy()
    order = np.argsort(token)
    shared = sets.sparkSession.sparkContext.broadcast((token[order], count[order], floor == 2))

    def run(batches):
        token, count, whole = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                n = b["t"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                t, row, start = b["t"].flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                df = np.zeros(len(t), np.int64)
                if len(token):
                    place = np.minimum(np.searchsorted(token, t), len(token) - 1)
                    df = np.where(token[place] == t, count[place], 0)
                order = np.lexsort((t, df, row))
                t, df = t[order], df[order]
                keep = np.arange(len(t)) - start[row] < (n - _rest(n, least))[row]
                if whole:
                    keep &= df > 0
                grp, ids, row = b["grp"].to_numpy(zero_copy_only=False), b["id"].to_numpy(zero_copy_only=False), row[keep]
                yield pa.record_batch([pa.array(t[keep] ^ grp[row]), pa.array(ids[row]), pa.array(n[row].astype(np.int32))], ["key", "id", "n"])

    return sets.select("id", "grp", "t").mapInArrow(run, "key long, id long, n int")


def _pairs(key: np.ndarray, ids: np.ndarray, n: np.ndarray, least: float):
    """Batches (id, other, n, m) of the rows of one key whose sizes allow it; rows are in order of key and id."""
    at, apart = np.arange(len(key)), 0
    while len(at):
        apart += 1
        at = at[at + apart < len(key)]
        at = at[key[at] == key[at + apart]]
        x, y = n[at + apart], n[at]
        fits = np.minimum(x, y) >= np.maximum(x, y) * (least / (2 - least)) - 1e-9
        if fits.any():
            yield pa.record_batch([ids[at + apart][fits], ids[at][fits], x[fits], y[fits]], ["id", "other", "n", "m"])


def _met(rare: DataFrame, least: float) -> DataFrame:
    """rare (key, id, n) -> id, other: an episode and an earlier one that share so many rare tokens that they can be alike.

    What else two sets share is among the rest of one of them. Only ids and sizes move.
    """

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for b in batches:
            key, ids, n = held = [np.concatenate([h, b[c].to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "id", "n"), strict=True)]
            if len(key):
                end = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
                yield from _pairs(key[:end], ids[:end], n[:end], least)
                held = [key[end:], ids[end:], n[end:]]
        yield from _pairs(*held, least)

    met = rare.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "id long, other long, n int, m int")
    rest = F.ceil(F.greatest("n", "m") * (least / (2 - least)) - 1e-9) - 1
    needed = F.ceil((F.col("n") + F.col("m")) * (least / 2) - 1e-9)
    return met.groupBy("id", "other", "n", "m").agg(F.count("*").alias("c")).filter(F.col("c") + F.greatest(rest, F.lit(0)) >= needed).select("id", "other")


def _alike(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs of ``met`` (id, other) whose sets are alike, as id, first: the least other of each."""
    met = _small(met)
    a = sets.join(met, "id").select("id", "other", "grp", "t")
    b = sets.select(F.col("id").alias("other"), F.col("grp").alias("grp2"), F.col("t").alias("t2")).join(met, "other").select("id", "other", "grp2", "t2")
    pairs = a.join(b, ["id", "other"]).filter((F.col("grp") == F.col("grp2")) & (dice(F.col("t"), F.col("t2")) >= least))
    return pairs.groupBy("id").agg(F.min("other").alias("first"))


def episode_duplicates(episodes: DataFrame, least: float = 0.8) -> DataFrame:
    """episodes (id, project, outcome, symptom, keys) -> id, first: the earliest episode with the same keys and a symptom alike (Dice).

    Only episodes of one project and outcome with equal key sets are compared, first by sketches of their tokens
    (``likeness``), and by the tokens themselves where these leave it open; a symptom without tokens is alike only to its equals, an episode without project,
    outcome or keys to none. Tokens are their 64-bit hashes. Each episode is first held against the earliest one
    that may do, and only where that fails against the others.
    """
    cols = ["project", "outcome", "keys"]
    e = episodes.select("id", "project", "outcome", F.array_sort(F.array_distinct("keys")).alias("keys"), F.array_sort(signature_tokens(F.coalesce("symptom", F.lit("")))).alias("t"))
    known = F.col("project").isNotNull() & F.col("outcome").isNotNull() & F.col("keys").isNotNull()
    digest = F.unhex(F.sha2(F.array_join("t", " "), 256))
    e = written(e.select("id", *[F.when(known, F.col(c)).alias(c) for c in cols], F.when(known, F.xxhash64(*cols)).alias("grp"), digest.alias("digest"), F.array_distinct(F.transform("t", lambda x: F.xxhash64(x))).alias("t")), "episodes")
    # Equal symptoms first, so that groups of copies are one row.
    copies = e.filter("grp is not null").groupBy(*cols, "digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    rep = written(e.select("id", *cols, "digest").join(copies, [*cols, "digest"]).filter("id > rep").select("id", "rep"), "copies")
    # Copies go from the sketches, which are short, and so take no part in what follows.
    sets = e.filter("grp is not null").select("id", "grp", "t")
    met = likeness.may_be_alike(written(likeness.sketches(sets), "sketches").join(_small(rep), "id", "left_anti"), least)
    nearest = met.groupBy("id").agg(F.min("other").alias("other"))
    found = written(_alike(nearest, sets, least), "alike")
    others = met.join(_small(found), "id", "left_anti").join(nearest, ["id", "other"], "left_anti")
    first = written(found.unionByName(_alike(written(others, "others"), sets, least)), "first")
    of_copies = rep.join(first.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("first", "rep").alias("first"))
    return e.select("id").join(first.unionByName(of_copies), "id", "left").select("id", F.coalesce("first", "id").alias("first"))


def observed_facts(trace: DataFrame) -> DataFrame:
    """trace (run_id, pos, tool, ok, target, output) -> run_id, kind, value: what tools saw, so log text can't make a fact.

    A run's health URL is the last one that answered with HTTP 2xx.
    """
    t = trace.filter("ok")
    kind = (
        F.when(F.col("tool") == "service_status", F.when(F.col("output").rlike(r"^(?:running|stopped)"), "service"))
        .when(F.col("tool") == "read_file", F.when(F.contains("target", F.lit("/log")), "log_file"))
        .when(F.col("tool") == "edit_file", F.when(F.col("target").rlike(r"\.(?:conf|ini|ya?ml|toml|json|env)$"), "config_file"))
        .when(F.col("tool") == "run_script", F.when(F.startswith("output", F.lit("exit 0")), "maintenance_command"))
    )
    seen = t.select("run_id", kind.alias("kind"), F.col("target").alias("value")).filter("kind is not null").distinct()
    url = t.filter((F.col("tool") == "http_check") & F.startswith("output", F.lit("HTTP 2"))).groupBy("run_id").agg(F.max_by("target", "pos").alias("value"))
    return seen.unionByName(url.select("run_id", F.lit("health_url").alias("kind"), "value"))


def learned(runs: DataFrame, trace: DataFrame, known: DataFrame) -> DataFrame:
    """runs (run_id, project, symptom, verified, tested) -> one episode for each run that is new and verified or tested.

    known (run_id) are runs learned from before; a run that comes twice counts once. Columns: run_id, project, symptom, outcome, n_writes, facts.
    """
    fresh = runs.filter("verified is not null and (verified or tested)").dropDuplicates(["run_id"]).join(known.select("run_id"), "run_id", "left_anti")
    writes = trace.filter("ok and writes").groupBy("run_id").agg(F.count("*").alias("n_writes"))
    facts = observed_facts(trace).groupBy("run_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "kind", "value"))).alias("facts"))
    out = fresh.join(writes, "run_id", "left").join(facts, "run_id", "left").filter("n_writes > 0 and symptom <> ''")
    none = F.array().cast("array<string>")
    return out.select("run_id", "project", "symptom", F.when(F.col("verified"), "verified").otherwise("failed").alias("outcome"), "n_writes", F.when(F.col("verified"), F.coalesce("facts", none)).otherwise(none).alias("facts"))


def first_and_recurrence(rows: DataFrame, keys: list[str], family: str, order: str) -> DataFrame:
    """``rows`` with occurrence (from 1) of their family within ``keys``, and whether it is the first one, the last one, or both."""
    w = W.partitionBy(*keys, family).orderBy(order)
    n = F.row_number().over(w)
    total = F.count("*").over(W.partitionBy(*keys, family))
    return rows.withColumns({"occurrence": n.cast("long"), "recurs": total > 1}).withColumn("is_last", F.col("occurrence") == total)


def quarantine(outcomes: DataFrame) -> DataFrame:
    """Adds quarantined: two failures at least, and more failures than successes."""
    return outcomes.withColumn("quarantined", (F.col("failures") >= 2) & (F.col("failures") > F.col("successes")))


def compactable(turns: DataFrame, most_turns: int = 6, most_tokens: int = 1800) -> DataFrame:
    """conv_id, turns, tokens of the conversations with more turns of a user or more estimated tokens than that."""
    c = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"))
    return c.filter((F.col("turns") > most_turns) | (F.col("tokens") > most_tokens))


def upsert_chain(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events (keys, order, value, confidence, pinned, source) -> versions of each key, each with the one it supersedes.

    A run of equal values (trimmed, lower-cased) is one version: its first value, largest confidence, pinned if
    any is, and first source that is known. The last version is active, the others are superseded.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    norm = F.lower(F.trim("value"))
    e = events.withColumn("new", (~norm.eqNullSafe(F.lag(norm).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    e = e.withColumns({"version": F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"), "at": F.struct(*order)})
    v = e.groupBy(*keys, "version").agg(
        F.min_by("value", "at").alias("value"), F.max("confidence").alias("confidence"), F.bool_or("pinned").alias("pinned"),
        F.min_by("source", F.when(F.col("source").isNotNull(), F.col("at"))).alias("source"), F.count("*").alias("n_seen"),
    )
    last = F.max("version").over(W.partitionBy(*keys))
    return v.withColumns({"status": F.when(F.col("version") == last, "active").otherwise("superseded"), "supersedes": F.when(F.col("version") > 1, F.col("version") - 1)})


def delete_keys(versions: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Without all versions of the keys in ``gone``."""
    return versions.join(gone.select(*keys).distinct(), keys, "left_anti")


def mark_used(versions: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to use_count of active versions how often their key occurs in ``used``."""
    n = used.groupBy(*keys).agg(F.count("*").alias("__n"))
    j = versions.join(n, keys, "left")
    more = F.when(F.col("status") == "active", F.coalesce("__n", F.lit(0))).otherwise(0)
    return j.withColumn("use_count", F.coalesce("use_count", F.lit(0)) + more).drop("__n")


def reset_owner(profiles: DataFrame, versions: DataFrame, owner: str, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, versions) after the owners in ``which`` start anew: their epoch grows by one, so work of an earlier epoch is void, and their versions go."""
    w = which.select(owner).distinct()
    bumped = profiles.join(w.withColumn("__r", F.lit(1)), owner, "left").withColumn("epoch", F.col("epoch") + F.coalesce("__r", F.lit(0))).drop("__r")
    return bumped, versions.join(w, owner, "left_anti")
