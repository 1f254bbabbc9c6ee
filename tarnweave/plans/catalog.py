"""Catalog, routing and benchmark queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.operators import bench, catalog, cleaning, search
from tarnweave.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LINES = "(select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1) pos from documents)"


@query(f"""with s as (select doc_id, pos::bigint pos, len(line) n, coalesce(sum(len(line) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint char_start from {_LINES})
select doc_id, pos, char_start, char_start + n char_end from s""")
def canonical_assembly(spark, sf):
    a = catalog.assemble(cleaning.lines(table(spark, sf, "documents")), "doc_id", "pos", "line")
    return a.select("doc_id", F.col("pos").cast("long").alias("pos"), "char_start", "char_end")


@query("select source, sha256(coalesce(text, '')) sha, min(doc_id) doc_id from documents group by 1, 2")
def upload_ingest(spark, sf):
    d = table(spark, sf, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "doc_id")
    return catalog.ingest_unique(d, "source", "sha", "doc_id")


@query("""select o_custkey, 'duplicate' rule from orders group by 1 having count(*) > 1 union all
select distinct o_custkey, 'orphan' from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)""")
def reference_errors(spark, sf):
    return catalog.reference_errors(table(spark, sf, "orders").select("o_custkey"), "o_custkey", table(spark, sf, "customer").filter("c_acctbal > 0"), "c_custkey")


@query("""with e as (select user_id, event_id, case event_type when 'view' then 'label' when 'click' then 'code' else 'text' end kind from events),
a as (select *, list({'o': event_id, 'k': kind}) over (partition by user_id order by event_id rows between 1 following and 4 following) ahead from e),
f as (select user_id, event_id, list_filter(ahead, lambda x: x.k in ('label', 'code'))[1] f from a where kind = 'label')
select user_id, event_id label_at, f.o code_at from f where f.k = 'code'""")
def label_code_pairs(spark, sf):
    kind = F.when(F.col("event_type") == "view", "label").when(F.col("event_type") == "click", "code").otherwise("text")
    return catalog.label_code_pairs(table(spark, sf, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")


_SKELETON = r"trim(regexp_replace(regexp_replace(lower({}), '<[^<>]*>|\{{\{{[^{{}}]*\}}\}}|[0-9]+', '_', 'g'), '\s+', ' ', 'g'))"


@query(f"""with p as (select {_SKELETON.format('p_brand')} s, min(p_type) label from part where p_size > 25 group by 1)
select p_partkey, label from part left join p on {_SKELETON.format('p_brand')} = s""")
def translation_overlay(spark, sf):
    p = table(spark, sf, "part")
    return catalog.overlay(p.select("p_partkey", "p_brand"), "p_brand", p.filter("p_size > 25").select("p_brand", F.col("p_type").alias("label")), "p_brand", "label").select("p_partkey", "label")


@query("""with x as (select s_suppkey k, s_suppkey % 7 v from supplier where s_suppkey % 3 = 0 union all select -s_suppkey, 0 from supplier where s_suppkey % 10 = 0)
select s_suppkey k, coalesce(v, 100)::bigint v, true used from supplier left join x on s_suppkey = k union all select k, v, false from x where k not in (select s_suppkey from supplier)""")
def corrections_overlay(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    patches = s.filter("k % 3 = 0").select("k", (F.col("k") % 7).alias("v")).unionByName(s.filter("k % 10 = 0").select((-F.col("k")).alias("k"), F.lit(0).cast("long").alias("v")))
    fixed, unused = catalog.corrections(s.withColumn("v", F.lit(100).cast("long")), "k", patches, "v")
    return fixed.select("k", "v", F.lit(True).alias("used")).unionByName(unused.select("k", "v", F.lit(False).alias("used")))


@query(r"""with q as (select conv_id, turn, trim(text, ' ') q, list_filter(list_transform(string_split_regex(text, '\s+(?:and|und|y|et)\s+|[;；\n]|以及|和'), lambda x: trim(x, ' ')), lambda x: len(x) >= 3) p from conversations where role = 'user'),
v as (select conv_id, turn, 0 i, q v from q union all select conv_id, turn, i, p[i] from (select conv_id, turn, p, unnest(range(1, len(p) + 1)) i from q where len(p) > 1)),
u as (select conv_id, turn, v, min(i) i from v group by 1, 2, 3), r as (select *, row_number() over (partition by conv_id, turn order by i) n from u)
select conv_id, turn, md5(string_agg(v, '|' order by i)) variants, count(*)::bigint n from r where n <= 4 group by 1, 2""")
def query_plan(spark, sf):
    v = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", catalog.query_variants(F.col("text")).alias("v"))
    return v.select("conv_id", "turn", F.md5(F.array_join("v", "|")).alias("variants"), F.size("v").cast("long").alias("n"))


_ROUTE = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-zA-Z0-9_+.#:/-]+'), lambda x: regexp_matches(x, '[a-z0-9]') or len(x) >= 3))"


@query(f"""with ix as (select distinct lang "domain", unnest({_ROUTE.format('text')}) token from documents), q as (select item_id, unnest({_ROUTE.format('text')}) token from benchmark),
s as (select item_id, "domain", round(sum(least(len(token), 32) / 32.0::double), 6) score from q join ix using (token) group by 1, 2),
b as (select *, row_number() over w n, lead(score) over w runner from s window w as (partition by item_id order by score desc, "domain"))
select item_id query_id, case when score - coalesce(runner, 0) >= 0.75 then "domain" end "domain" from benchmark left join (select * from b where n = 1) using (item_id)""")
def domain_inference(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("domain"), "text")
    return catalog.infer_domain(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), d)


@query(r"""select l_orderkey, l_linenumber, case when regexp_matches(c, '^(?:select|insert|update|delete|create|alter|drop|truncate|with)\b') then 'sql' when regexp_matches(c, '^(?:get-|set-|new-|remove-|start-|stop-|restart-|test-)\w+') then 'powershell' else 'bash' end "language"
from (select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'select * from t' when 1 then 'get-item x' else 'ls' end c from lineitem)""")
def command_language(spark, sf):
    n = F.col("l_linenumber") % 3
    c = F.when(n == 0, "SELECT * FROM t").when(n == 1, " Get-Item x").otherwise("ls")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", catalog.command_language(c).alias("language"))


@query("""with p as (select conv_id, turn, case when contains(lower(text), 'the') then len(text) - strpos(reverse(lower(text)), 'eht') - 1 else -1 end a, case when contains(lower(text), 'und') then len(text) - strpos(reverse(lower(text)), 'dnu') - 1 else -1 end b from conversations)
select conv_id, turn, case when greatest(a, b) > 0 then case when b >= a then 'german' else 'english' end end option from p""")
def last_mention_wins(spark, sf):
    options = {"english": ["the"], "german": ["und"]}
    return table(spark, sf, "conversations").select("conv_id", "turn", catalog.last_mention(F.col("text"), options).alias("option"))


@query("""with c as (select user_id, case event_type when 'signup' then 'ADD' when 'purchase' then 'SUPERSEDE' when 'click' then 'UPDATE' else 'NOOP' end a from events where event_id % 4 = 0)
select user_id, case when bool_and(a = 'ADD') then 'ADD' when bool_or(a = 'SUPERSEDE') then 'SUPERSEDE' when bool_or(a = 'UPDATE') then 'UPDATE' else 'NOOP' end operation from c group by 1""")
def operation_label(spark, sf):
    t = F.col("event_type")
    a = F.when(t == "signup", "ADD").when(t == "purchase", "SUPERSEDE").when(t == "click", "UPDATE").otherwise("NOOP")
    return catalog.operation_label(table(spark, sf, "events").filter("event_id % 4 = 0").select("user_id", a.alias("a")), "user_id", "a")


@query("""with c as (select user_id, case event_type when 'signup' then 'ADD' when 'purchase' then 'SUPERSEDE' when 'click' then 'UPDATE' else 'NOOP' end a from events)
select user_id, case when bool_and(a = 'ADD') then 'ADD' when bool_or(a = 'SUPERSEDE') then 'SUPERSEDE' when bool_or(a = 'UPDATE') then 'UPDATE' else 'NOOP' end operation from c group by 1""")
def operation_label_all(spark, sf):
    """Of all changes of a user."""
    t = F.col("event_type")
    a = F.when(t == "signup", "ADD").when(t == "purchase", "SUPERSEDE").when(t == "click", "UPDATE").otherwise("NOOP")
    return catalog.operation_label(table(spark, sf, "events").select("user_id", a.alias("a")), "user_id", "a")


@query("""with m as (select user_id, list({'slot': event_id % 3, 'value': case when event_id % 2 = 0 then '!' else '' end || event_type}) m from events where event_id % 5 = 0 group by 1)
select event_id from events left join m using (user_id) where m is null or len(list_filter(m, lambda x: x.slot = event_id % 3 and case when x.value[1] = '!' then x.value[2:] = event_type else x.value <> event_type end)) = 0""")
def conflict_filter_all(spark, sf):
    """Events of users without a mention stay, as nothing contradicts them."""
    e = table(spark, sf, "events")
    value = F.concat(F.when(F.col("event_id") % 2 == 0, "!").otherwise(""), "event_type")
    m = e.filter("event_id % 5 = 0").groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 3).alias("slot"), value.alias("value"))).alias("m"))
    own = F.struct((F.col("event_id") % 3).alias("slot"), F.col("event_type").alias("value"))
    return e.join(m, "user_id", "left").filter(F.col("m").isNull() | ~catalog.contradicts(own, F.col("m"))).select("event_id")


@query("""with m as (select user_id, list({'slot': event_id % 3, 'value': case when event_id % 2 = 0 then '!' else '' end || event_type}) m from events where event_id % 5 = 0 group by 1)
select event_id from events join m using (user_id) where len(list_filter(m, lambda x: x.slot = event_id % 3 and case when x.value[1] = '!' then x.value[2:] = event_type else x.value <> event_type end)) = 0""")
def conflict_filter(spark, sf):
    e = table(spark, sf, "events")
    value = F.concat(F.when(F.col("event_id") % 2 == 0, "!").otherwise(""), "event_type")
    m = e.filter("event_id % 5 = 0").groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 3).alias("slot"), value.alias("value"))).alias("m"))
    own = F.struct((F.col("event_id") % 3).alias("slot"), F.col("event_type").alias("value"))
    return e.join(m, "user_id").filter(~catalog.contradicts(own, F.col("m"))).select("event_id")


@query("""with c as (select event_type, case when event_id % 6 < 5 then event_id % 6 + 1 end rank from events), s as (select unnest([event_type, 'all']) slice, rank from c)
select slice, count(*)::bigint cases, round(avg(coalesce(rank <= 1, false)::int::double), 6) top1, round(avg(coalesce(rank <= 3, false)::int::double), 6) top3 from s group by 1""")
def hit_rate_by_group(spark, sf):
    i = F.col("event_id") % 6
    return bench.hit_rates(table(spark, sf, "events").select("event_type", F.when(i < 5, i + 1).alias("rank")), "event_type", "rank")


@query("""with r as (select event_type, epoch(ts)::double s, 0.5 + event_id % 7 d, event_id % 100 t from events)
select event_type, count(*)::bigint requests, round(coalesce(count(*) / nullif(max(s + d) - min(s), 0)::double, 0), 6) requests_per_s, round(coalesce(sum(t)::double / nullif(max(s + d) - min(s), 0), 0), 6) tokens_per_s, round(avg(d), 6)::double mean_seconds from r group by 1""")
def serving_throughput(spark, sf):
    i = F.col("event_id")
    r = table(spark, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), (0.5 + i % 7).cast("double").alias("d"), (i % 100).alias("t"))
    return bench.throughput(r.withColumn("s", F.col("us") / 1000000), "event_type", "s", "d", "t")


@query("select event_type, event_id % 4 level, (count(*) filter (where value > 40))::varchar || '/' || count(*)::varchar success from events group by 1, 2")
def bench_rollup(spark, sf):
    return bench.k_of_n(table(spark, sf, "events").select("event_type", (F.col("event_id") % 4).alias("level"), (F.col("value") > 40).alias("ok")), ["event_type", "level"], "ok")


@query("""with l as (select user_id, arg_max(event_type, (ts, event_id)) mode from events group by 1) select mode, count(*)::bigint n from l group by 1""")
def mode_counters(spark, sf):
    return bench.last_modes(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("select user_id, coalesce(max(case when event_type = 'signup' then event_id end), -1) > coalesce(max(case when event_type = 'purchase' then event_id end), -1) tested from events group by 1")
def trace_tested(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "restart").when(F.col("event_type") == "purchase", "change")
    return bench.tested_after_change(table(spark, sf, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")


@query("select event_id, event_id % 2 = 0 and event_id % 3 <> 0 and event_id % 5 <> 0 success, event_id % 7 = 0 and event_id % 2 <> 0 false_success, event_type in ('click', 'view') diagnosed from events")
def bench_flags(spark, sf):
    i = F.col("event_id")
    r = table(spark, sf, "events").select(
        "event_id", (i % 2 == 0).alias("fixed"), (i % 3 == 0).alias("violation"), (i % 5 != 0).alias("reported"), (i % 7 == 0).alias("claimed"),
        F.array("event_type").alias("found"), F.array(F.array(F.lit("click"), F.lit("view"))).alias("needed"),
    )
    return bench.case_flags(r).select("event_id", "success", "false_success", "diagnosed")


@query("""with c as (select user_id k, count(*) c from events where event_id % 2 = 0 group by 1), e as (select user_id k, count(*) e from events where event_id % 2 = 1 group by 1),
d as (select k, coalesce(c, 0) c, coalesce(e, 0) e from e full join c using (k)) select k, greatest(e - c, 0)::bigint missing, greatest(c - e, 0)::bigint extra from d where c <> e""")
def release_completeness(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id")
    return bench.completeness(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "k")


@query("""with t as (select distinct user_id, event_type from events where value > 30) select event_id % 10 run, count(*)::bigint learned, (count(*) filter (where (user_id, event_type) not in (select (user_id, event_type) from t)))::bigint wrong from events group by 1""")
def memory_audit(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 10).alias("run"), "user_id", "event_type", "value")
    return bench.memory_audit(e.drop("value"), e.filter("value > 30"), ["user_id", "event_type"], "run")


@query("""select event_id, case when user_id in (select user_id from events where event_type = 'error') then 'x [redacted] y' else 'x secret' || user_id::varchar || ' y' end t from events""")
def secret_provenance(spark, sf):
    e = table(spark, sf, "events")
    s = F.concat(F.lit("secret"), F.col("user_id").cast("string"))
    found = e.filter("event_type = 'error'").select("user_id", s.alias("s0")).distinct()
    return bench.blank_secrets(e.select("event_id", "user_id", F.concat(F.lit("x "), s, F.lit(" y")).alias("t")), "user_id", "t", found, "s0").select("event_id", "t")


@query("select conv_id, greatest((count(*) filter (where role = 'user' and coalesce(text, '') <> '')), 1)::bigint turns from conversations group by 1")
def turn_count(spark, sf):
    return bench.turn_counts(table(spark, sf, "conversations"))


@query("select source, count(*)::bigint n, (count(*) filter (where contains(text, chr(65533))))::bigint broken from documents group by 1")
def text_integrity(spark, sf):
    return bench.broken_texts(table(spark, sf, "documents"), "source")


@query("""with h as (select user_id query_id, event_id, event_id % 4 ascii, round(value, 3) fused, round(value / 2, 3) bm25 from events)
select query_id, event_id, row_number() over (partition by query_id order by (ascii > 0)::int desc, ascii desc, fused desc, bm25 desc, event_id)::bigint rank from h qualify rank <= 5""")
def lexical_priority(spark, sf):
    h = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), "event_id", (F.col("event_id") % 4).alias("a"), F.round("value", 3).alias("f"), F.round(F.col("value") / 2, 3).alias("b"))
    return search.lexical_first(h, "a", "f", "b", 5, "event_id").select("query_id", "event_id", "rank")


@query("select user_id query_id, event_id, row_number() over (partition by user_id order by round(value, 1) desc, event_type desc, event_id desc)::bigint rank from events qualify rank <= 5")
def deterministic_rerank(spark, sf):
    w = W.partitionBy("query_id").orderBy(F.round("value", 1).desc(), F.col("event_type").desc(), F.col("event_id").desc())
    e = table(spark, sf, "events").withColumnRenamed("user_id", "query_id")
    return e.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("query_id", "event_id", "rank")


@query("select user_id, sha256(string_agg(distinct event_type, '|' order by event_type)) revision from events group by 1")
def evidence_revision(spark, sf):
    return search.evidence_revision(table(spark, sf, "events"), "user_id", "event_type")


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) k, try_cast(json_extract_string(props, '$.none') as bigint) is null missing from events")
def json_defaults(spark, sf):
    p = F.from_json("props", "k long, none long")
    return table(spark, sf, "events").select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), p["none"].isNull().alias("missing"))


@query()
def command_evidence(spark, sf):
    from tarnweave.operators.mentions import command_table

    d = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("Run `do "), "event_type", F.lit("` then\n\n```\ngo "), F.col("user_id").cast("string"), F.lit("\n```\n")).alias("text"))
    return command_table(d)


@query("select event_id, case when event_id % 2 = 0 then '!' || event_type else event_type end mentions from events")
def ordered_mentions(spark, sf):
    from tarnweave.operators.mentions import mention_table

    words = {w: [w] for w in ("signup", "purchase", "view", "click", "error")}
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "please do not use ").otherwise("please use "), "event_type")
    return mention_table(table(spark, sf, "events").select("event_id", text.alias("text")), "event_id", words).select("event_id", F.array_join("mentions", ",").alias("mentions"))


@query("""select event_id, case event_id % 4 when 0 then event_type when 1 then '!' || event_type when 2 then 'rust' else event_type || ',rust' end mentions from events""")
def settled_mentions(spark, sf):
    from tarnweave.operators.mentions import mention_table

    k = F.col("event_id") % 4
    words = {w: [w] for w in ("signup", "purchase", "view", "click", "error", "rust")}
    text = F.concat(F.when(k == 0, "I use ").when(k == 1, "please do not use ").when(k == 2, "not ").otherwise("use "), "event_type", F.when(k == 2, " but rust").when(k == 3, F.concat(F.lit(", rust, "), "event_type")).otherwise(""))
    return mention_table(table(spark, sf, "events").select("event_id", text.alias("text")), "event_id", words, True).select("event_id", F.array_join("mentions", ",").alias("mentions"))
