"""Preference formatting of conversation pairs (operator 5).

A pair is a chosen and a rejected conversation. Their longest common turn prefix
is rendered once as the prompt; what follows in each is its completion, with the
places on which a loss counts: assistant texts and their end marks, not the marks
and texts of others.

Cases: null roles and texts count as empty; control marks inside a text are broken
up, so no text can forge a turn; repeated rows (same side, turn, role, text) count
once; turns order by number, then role, then text, null first; a pair with one side only has
an empty prefix and a null completion on the other; turns whose pair id is null
form one pair of that id; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _render(turns: Column) -> Column:
    """struct(text, mask) of rendered turns; the mask lists start:end, in code points, of what is trained on."""

    def add(a: Column, t: Column) -> Column:
        head = F.concat(F.lit(OPEN), t["role"], F.lit("\n"))
        body = F.concat(t["text"], F.lit(CLOSE))
        s = a["n"] + F.length(head)
        e = s + F.length(body)
        return F.struct(
            F.concat(a["parts"], F.array(F.concat(head, body, F.lit("\n")))).alias("parts"),
            (e + 1).alias("n"),
            F.when(t["role"] == "assistant", F.concat(a["mask"], F.array(F.concat(s.cast("string"), F.lit(":"), e.cast("string"))))).otherwise(a["mask"]).alias("mask"),
        )

    none = F.array().cast("array<string>")
    return F.aggregate(
        turns, F.struct(none.alias("parts"), F.lit(0).alias("n"), none.alias("mask")), add,
        lambda a: F.struct(F.array_join(a["parts"], "").alias("text"), F.array_join(a["mask"], ",").alias("mask")),
    )


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns (pair_id, rejected boolean, turn, role, text) -> a row for each pair.

    pair_id, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask. One shuffle, by pair.
    """
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select("pair_id", "rejected", F.struct("turn", safe(F.col("role")).alias("role"), safe(F.col("text")).alias("text")).alias("t"))
    sides = rows.groupBy("pair_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("rejected") == side, F.col("t")))).alias(name) for side, name in ((False, "c"), (True, "r"))]
    )

    def prefix(c: Column, r: Column) -> Column:
        same = lambda i: (F.get(c, i)["role"] == F.get(r, i)["role"]) & (F.get(c, i)["text"] == F.get(r, i)["text"])
        n = F.least(F.size(c), F.size(r))
        differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.coalesce(same(i), F.lit(False)))
        return F.get(differ, F.lit(0))

    out = sides.withColumn("n", prefix(F.col("c"), F.col("r")))
    tail = lambda c: F.when(F.size(c) > 0, _render(F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))))
    out = out.withColumns({"p": _render(F.slice("c", F.lit(1), F.col("n"))), "c": tail("c"), "r": tail("r")})
    return out.select(
        "pair_id", F.col("n").cast("long").alias("n_prefix"), F.col("p.text").alias("prompt"), F.col("c.text").alias("chosen"),
        F.col("c.mask").alias("chosen_mask"), F.col("r.text").alias("rejected"), F.col("r.mask").alias("rejected_mask"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as a pair, the first one chosen."""
    return conversations.select(
        F.shiftright("conv_id", 1).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 1).alias("rejected"), "turn", "role", "text"
    )


def op5_chat_format(spark, sf_dir):
    return format_preferences(pair_neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql() -> str:
    tail = lambda s, name: f"""(select pair_id, string_agg(txt, '' order by i) txt, coalesce(string_agg((b + hl)::varchar || ':' || (b + hl + bl)::varchar, ',' order by i) filter (where role = 'assistant'), '') m
      from (select *, (coalesce(sum(hl + bl + 1) over (partition by pair_id order by i rows between unbounded preceding and 1 preceding), 0))::bigint b
            from n join np using (pair_id) where side = {s} and i > n_prefix) group by 1) {name}"""  # noqa: E731
    return rf"""
with t as (select distinct conv_id // 2 pair_id, conv_id % 2 side, turn, replace(coalesce(role, ''), '<|', '< |') role, replace(coalesce(text, ''), '<|', '< |') text from conversations),
n as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role, text) i,
        '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) txt, len('{OPEN}' || role) + 1 hl, len(text || '{CLOSE}') bl from t),
p as (select pair_id, max(i) filter (where side = 0) nc, max(i) filter (where side = 1) nr from n group by 1),
d as (select c.pair_id, min(c.i) i from n c join n r on c.pair_id = r.pair_id and c.i = r.i and c.side = 0 and r.side = 1 where c.role <> r.role or c.text <> r.text group by 1),
np as (select p.pair_id, nc, nr, least(coalesce(d.i - 1, 1000000000), coalesce(nc, 0), coalesce(nr, 0))::bigint n_prefix from p left join d using (pair_id)),
pr as (select pair_id, string_agg(txt, '' order by i) txt from n join np using (pair_id) where side = 0 and i <= n_prefix group by 1)
select np.pair_id, n_prefix, coalesce(pr.txt, '') prompt,
  case when nc is not null then coalesce(c.txt, '') end chosen, case when nc is not null then coalesce(c.m, '') end chosen_mask,
  case when nr is not null then coalesce(r.txt, '') end rejected, case when nr is not null then coalesce(r.m, '') end rejected_mask
from np left join pr using (pair_id) left join {tail(0, 'c')} using (pair_id) left join {tail(1, 'r')} using (pair_id)
"""


QUERIES = {"op5_chat_format": op5_chat_format}
ORACLES = {"op5_chat_format": _sql()}
