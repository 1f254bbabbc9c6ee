"""Conversations, versioned facts and keyed state, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.functions.text import estimate_tokens
from tarnweave.operators import memory
from tarnweave.sources.tables import shared_dir, table
from tarnweave.streaming import state as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TOKENS = "case when coalesce(text, '') = '' then 0 else greatest(1, ceil(octet_length(encode(text)) / 4.0)) end::bigint"


@query("""with m as (select *, lag(role) over w p_role, lag(turn) over w p_turn, lag(text) over w p_text from conversations where role = 'user' or (role = 'assistant' and text is not null) window w as (partition by conv_id order by turn))
select conv_id, p_turn user_turn, turn assistant_turn, p_text question, text answer from m where role = 'assistant' and p_role = 'user'""")
def turn_pairs(spark, sf):
    return memory.turn_pairs(table(spark, sf, "conversations"))


@query("with b as (select conv_id, max(turn) last from conversations where role = 'system' or text like '%the%' and turn < 3 group by 1) select c.conv_id, c.turn from conversations c left join b using (conv_id) where last is null or c.turn > last")
def messages_after_boundary(spark, sf):
    c = table(spark, sf, "conversations")
    b = c.filter("role = 'system' or text like '%the%' and turn < 3").select("conv_id", "turn")
    return memory.after_boundary(c, b).select("conv_id", "turn")


_PAIRS = r"""p as (select conv_id, turn, text, role, lead(role) over w nr, lead(text) over w nt from conversations where role in ('user', 'assistant') and trim(coalesce(text, '')) <> '' window w as (partition by conv_id order by turn)),
k as (select conv_id, turn, (greatest(1, ceil(octet_length(encode(text)) / 4.0)) + greatest(1, ceil(octet_length(encode(nt)) / 4.0)))::bigint n from p where role = 'user' and nr = 'assistant')"""


@query(f"""with recursive {_PAIRS}, o as (select *, row_number() over (partition by conv_id order by turn desc) - 1 i from k),
r as (select conv_id, turn, n, i, n <= 1800 ok, 1800 - case when n <= 1800 then n + 360 else 0 end rest, false stop from o where i = 0 union all
  select o.conv_id, o.turn, o.n, o.i, o.n <= r.rest, r.rest - case when o.n <= r.rest then o.n else 0 end, o.n > r.rest and o.i >= 2 from r join o on o.conv_id = r.conv_id and o.i = r.i + 1 where not r.stop)
select conv_id, turn, n tokens from r where ok""")
def recent_turn_budget(spark, sf):
    p = memory.turn_pairs(table(spark, sf, "conversations"))
    return memory.budgeted_turns(p.select("conv_id", F.col("user_turn").alias("turn"), (estimate_tokens(F.col("question")) + estimate_tokens(F.col("answer"))).alias("tokens")))


@query("""with l as (select user_id, event_type, max(event_id) last_at from events group by 1, 2)
select user_id, event_type, row_number() over (partition by user_id order by last_at desc, event_type desc)::bigint place from l qualify place <= 3""")
def unique_recent(spark, sf):
    return memory.unique_recent(table(spark, sf, "events"), "user_id", "event_id", "event_type", 3)


@query(f"""select conv_id, (count(*) filter (where role = 'user'))::bigint turns, sum({_TOKENS})::bigint tokens from conversations group by 1 having turns > 3 or tokens > 600""")
def compaction_candidates(spark, sf):
    return memory.compactable(table(spark, sf, "conversations"), 3, 600)


_VALUE = "case when event_id % 2 = 0 then upper(substr(event_type, 1, 1)) else lower(substr(event_type, 1, 1)) end"


def _valued(spark, sf):
    first = F.substring("event_type", 1, 1)
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.upper(first)).otherwise(F.lower(first)).alias("value"))


@query(f"""with e as (select user_id, event_id, ts, {_VALUE} v from events), n as (select *, case when lag(lower(trim(v))) over w is not distinct from lower(trim(v)) then 0 else 1 end fresh from e window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) "version" from n),
x as (select user_id, "version"::bigint "version", arg_min(v, (ts, event_id)) "value", min(ts) valid_from, count(*)::bigint n_seen from g group by 1, 2)
select *, lead(valid_from) over (partition by user_id order by "version") valid_to from x""")
def scd2_upsert(spark, sf):
    return memory.versions(_valued(spark, sf), ["user_id"], ["ts", "event_id"], "value")


@query(f"""with e as (select user_id, event_id, ts, {_VALUE} v from events), n as (select *, case when lag(lower(trim(v))) over w is not distinct from lower(trim(v)) then 0 else 1 end fresh from e window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) "version" from n),
x as (select user_id, "version"::bigint "version", min(ts) valid_from from g group by 1, 2), y as (select * from x qualify "version" < max("version") over (partition by user_id))
select user_id, "version", lead(valid_from) over (partition by user_id order by "version") valid_to from y""")
def undo_last_version(spark, sf):
    return memory.undo_last(memory.versions(_valued(spark, sf), ["user_id"], ["ts", "event_id"], "value"), ["user_id"]).select("user_id", "version", "valid_to")


_FACTS = "f as (select user_id, event_type k, case when event_id % 10 = 0 then 'user' else 'host' end source, (event_id % 5)::varchar val, ts seen_at, round(value / 1000, 6) confidence, event_id % 17 = 0 pinned from events)"


@query(f"""with {_FACTS}, b as (select user_id, k, arg_max(val, ((source = 'user')::int, seen_at, val)) win from f group by 1, 2)
select user_id, k, win "value", max(confidence) confidence, bool_or(pinned) pinned, count(*)::bigint seen_count from f join b using (user_id, k) where val = win group by 1, 2, 3""")
def fact_priority_upsert(spark, sf):
    f = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("k"), F.when(F.col("event_id") % 10 == 0, "user").otherwise("host").alias("source"), (F.col("event_id") % 5).cast("string").alias("value"),
        F.col("ts").alias("seen_at"), F.round(F.col("value") / 1000, 6).alias("confidence"), (F.col("event_id") % 17 == 0).alias("pinned"),
    )
    return memory.merge_facts(f, ["user_id", "k"])


_EPISODES = 'e as (select user_id "query", event_id episode, round(value / 100, 4) "match", event_id % 7 successes, event_id % 5 failures, (event_id % 90)::double "days" from events)'


def _episodes(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("query"), i.alias("episode"), F.round(F.col("value") / 100, 4).alias("match"), (i % 7).alias("successes"), (i % 5).alias("failures"), (i % 90).cast("double").alias("days"))


@query(f"""with {_EPISODES}, s as (select "query", episode, round("match" * (0.5 + (successes + 1) / (successes + failures + 2)::double) * (0.5 + 0.5 * pow(0.5::double, "days" / 30)), 6) score from e where not (failures >= 2 and failures > successes))
select *, row_number() over (partition by "query" order by score desc, episode)::bigint rank from s qualify rank <= 3""")
def episode_rank(spark, sf):
    return memory.rank_episodes(_episodes(spark, sf), "query", 3).select("query", "episode", "score", "rank")


@query("""select user_id, event_type, (count(*) filter (where event_id % 2 = 0))::bigint successes, (count(*) filter (where event_id % 2 = 1))::bigint failures,
 (count(*) filter (where event_id % 2 = 1)) >= 2 and (count(*) filter (where event_id % 2 = 1)) > (count(*) filter (where event_id % 2 = 0)) quarantined from events group by 1, 2""")
def episode_quarantine(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("successes"), F.count_if(F.col("event_id") % 2 == 1).alias("failures"))
    return memory.quarantine(s)


@query("""select event_id, round(least(1.05, case when event_id % 11 = 0 then 1.0 else greatest(0.85, least(1.0, 0.85 + 0.15 * pow(2.0::double, -(event_id % 400)::double / 180))) end * least(1.05, 1.0 + 0.01 * ln(1 + event_id % 30))), 6)::double multiplier from events""")
def decay_rank(spark, sf):
    i = F.col("event_id")
    return memory.decayed(table(spark, sf, "events").select("event_id", (i % 400).cast("double").alias("days"), (i % 11 == 0).alias("pinned"), (i % 30).alias("uses"))).select("event_id", "multiplier")


@query("""with recursive m as (select user_id "key", event_id item, (20 + event_id % 200)::bigint tokens, row_number() over (partition by user_id order by value desc, event_id)::bigint "rank" from events),
r as (select distinct "key", 0 n, 400::bigint rest, 0::bigint "rank", 0::bigint item, 0::bigint tokens from m union all
  select * from (select r."key", r.n + 1, r.rest - arg_min(m.tokens, m."rank"), min(m."rank"), arg_min(m.item, m."rank"), arg_min(m.tokens, m."rank") from r join m on m."key" = r."key" and m."rank" > r."rank" and m.tokens <= r.rest where r.n < 4 group by r."key", r.n, r.rest))
select "key", "rank", item, tokens from r where n > 0""")
def memory_select_budget(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("item"), (20 + F.col("event_id") % 200).alias("tokens"), "value")
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("value").desc(), "item")).cast("long")
    return memory.greedy_budget(e.withColumn("rank", place).drop("value"))


@query("""with t as (select event_id, user_id, case when event_type = 'view' then 'done' else 'pending' end status, event_id % 3 epoch from events), p as (select user_id, max(event_id) % 3 now_epoch from events group by 1)
select event_id, user_id from t join p using (user_id) where status = 'pending' and epoch = now_epoch""")
def task_epoch_claim(spark, sf):
    e = table(spark, sf, "events")
    tasks = e.select("event_id", "user_id", F.when(F.col("event_type") == "view", "done").otherwise("pending").alias("status"), (F.col("event_id") % 3).alias("epoch"))
    return memory.claim(tasks, e.groupBy("user_id").agg((F.max("event_id") % 3).alias("epoch"))).select("event_id", "user_id")


@query(f"select event_id, case when event_type <> 'view' and ts <= timestamp '{NOW}' then 'expired' when event_type <> 'view' then 'pending' else 'done' end status from events")
def plan_expiry(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "done").otherwise("pending").alias("status"), F.col("ts").alias("expires_at"))
    return memory.expire(e, F.to_timestamp(F.lit(NOW))).select("event_id", "status")


def _stream(spark, sf):
    return streams.folder_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)


@query(f"""with e as (select user_id, event_type, event_id, ts, (event_id % 3)::varchar v from events), n as (select *, case when lag(v) over w is not distinct from v then 0 else 1 end fresh from e window w as (partition by user_id, event_type order by ts, event_id)),
g as (select *, sum(fresh) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding)::bigint "version" from n)
select user_id, event_type, "version", v "value", ts valid_from from g where fresh = 1""")
def stream_scd2(spark, sf):
    s = _stream(spark, sf).select("event_id", "ts", "user_id", "event_type", (F.col("event_id") % 3).cast("string").alias("value"))
    return streams.run_to_end(streams.stream_versions(s), shared_dir(spark, "stream-versions"))


@query("select user_id, count(*)::bigint n, 'active' status from events group by 1")
def stream_activity(spark, sf):
    """Keyed state with expiry; within a day of processing time every key is active."""
    return streams.latest_activity(_stream(spark, sf), shared_dir(spark, "activity"))


@query("select event_type, count(*)::bigint n, count(distinct event_id)::bigint n_ids from events group by 1")
def stream_ingest_ledger(spark, sf):
    out = streams.ingest_ledger(_stream(spark, sf), shared_dir(spark, "ledger"))
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"))


@query("""with v as (select *, lower(trim((event_id % 3)::varchar)) x, lag(event_id % 3) over (partition by user_id, event_type order by ts, event_id) p from events)
select user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as version, x as value, ts valid_from from v where p is null or p <> event_id % 3""")
def stream_revisions(spark, sf):
    """Versions of events that come in four batches in no order of time: what is late corrects what was emitted."""
    from datetime import timedelta

    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", (F.col("event_id") % 3).cast("string").alias("value"))
    folder, tasks = shared_dir(spark, "shuffled-events"), spark.sparkContext.defaultParallelism
    e.repartition(4 * tasks, F.xxhash64("event_id")).write.parquet(folder)
    files = len(spark.read.schema(e.schema).parquet(folder).inputFiles())
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", max(1, -(-files // 4))).parquet(folder)
    buckets = max(4 * tasks, e.count() // 16384)
    return streams.current_versions(streams.run_to_end(streams.stream_revisions(s, timedelta(days=36500), buckets), shared_dir(spark, "revisions")))
