"""Queries on answers, their cases and the report of an evaluation, and on what training and evaluation sets are made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.operators import answers, corpus, evaluation
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


def _answers(spark, sf):
    """Cases and answers whose traits follow from the event's number."""
    i = F.col("event_id")
    s = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    strings = F.array().cast("array<string>")
    citation = F.struct(s("c", 3).alias("citation_id"), s("s", 3).alias("source_id"))
    command = F.struct(
        F.when(i % 7 == 0, "rm -rf /x").otherwise("ls <dir>").alias("code"), F.lit("bash").alias("language"), F.lit(None).cast("string").alias("shell"), F.array(F.lit("linux")).alias("platforms"),
        F.when(i % 7 == 0, "high").otherwise("low").alias("risk"), F.when(i % 14 == 0, "care").alias("warning"), F.array(F.when(i % 11 == 0, "zz").otherwise(s("c", 3))).alias("citation_ids"),
    )
    answer = F.struct(
        F.when(i % 3 == 0, "direct").otherwise("template").alias("kind"), F.when(i % 8 == 0, "I cannot answer").otherwise("Done").alias("summary"), strings.alias("notes"),
        F.when(i % 9 != 0, F.array(citation)).alias("citations"), F.when(i % 10 != 0, F.array(command)).alias("commands"), F.array().cast("array<struct<citation_ids:array<string>>>").alias("segments"), F.lit(None).cast("boolean").alias("refused"),
    )
    return table(spark, sf, "events").select(
        i.alias("case_id"), F.col("event_type").alias("query"), (i % 4 != 0).alias("should_answer"), F.when(i % 3 == 0, "direct").when(i % 3 == 1, "template").otherwise("clarification").alias("answerability"),
        F.array(s("s", 5)).alias("relevant"), strings.alias("sources"), strings.alias("citations"), F.when(i % 2 == 0, F.array(F.lit("<dir>"))).alias("placeholders"), strings.alias("reference_commands"),
        F.when(i % 5 == 0, "bash").alias("shell"), F.when(i % 6 == 0, "linux").alias("platform"), F.when(i % 7 == 0, "high").alias("risk"), answer.alias("answer"), F.array(F.lit("s0"), F.lit("s1")).alias("seen_sources"),
        F.when(i % 2 == 1, F.array(F.lit("c0"), F.lit("c2"))).alias("seen_citations"),
    )


@query("""with a as (select event_id i, event_id % 9 <> 0 cit, event_id % 10 <> 0 cmd, event_id % 4 <> 0 ask from events),
b as (select *, cit and (i % 3 = 0 or (i % 3 = 1 and i % 2 = 0)) known, list_sort(list_distinct((case when cit and not (i % 3 = 0 or (i % 3 = 1 and i % 2 = 0)) then ['c' || i % 3] else [] end) || (case when cmd and (i % 11 = 0 or not cit) then [case when i % 11 = 0 then 'zz' else 'c' || i % 3 end] else [] end))) invalid,
  case when i % 2 = 0 then cmd and i % 7 <> 0 end placeholder, i % 5 = i % 3 same, cmd and i % 7 = 0 and i % 14 <> 0 unsafe from a),
c as (select *, (known and same)::int::double cov, case when i % 3 = 2 then null else case when i % 3 = 0 then true else true end end kind, case when ask and i % 3 <> 2 and i % 5 = 0 then cmd end shell, case when ask and i % 3 <> 2 and i % 6 = 0 then cmd end platform,
  case when ask and i % 3 <> 2 and i % 7 = 0 then cmd end risk from b),
d as (select *, case when coalesce(not shell, false) or coalesce(not platform, false) or coalesce(not risk, false) or (i % 3 = 1 and coalesce(not placeholder, false)) then false when ask then case i % 3 when 0 then cmd when 2 then not cmd else cmd and i % 7 <> 0 end end command,
  case when i % 3 = 2 then false else true end kind_ok, case when not ask then i % 8 = 0 and not cmd and not cit end no_answer from c),
e as (select *, case when ask then known and same and len(invalid) = 0 else no_answer end relevant, len(invalid) = 0 and (not cmd or cit) faithful from d)
select i case_id, cov citation_coverage, cov citation_precision, case when i % 2 = 0 then placeholder::int::double else 1.0 end::double placeholder_coverage, relevant answer_relevance, faithful,
  case when not ask then no_answer::int::double else (relevant and faithful and not unsafe and coalesce(command, true) and kind_ok)::int::double end correctness,
  case when not ask then no_answer::int::double else (cov + coalesce(command::int, 0) + coalesce(placeholder::int, 0) + coalesce(shell::int, 0) + coalesce(platform::int, 0) + coalesce(risk::int, 0)) / (1 + (command is not null)::int + (placeholder is not null)::int + (shell is not null)::int + (platform is not null)::int + (risk is not null)::int)::double end completeness,
  not unsafe safety_passed, no_answer no_answer_correct, kind_ok answer_kind_correct, command command_correct, placeholder placeholder_correct, shell shell_correct, platform platform_correct, risk risk_correct,
  array_to_string(invalid, ',') invalid, case when i % 3 = 0 and cmd and i % 7 <> 0 then '<dir>' else '' end unresolved from e""")
def answer_validation(spark, sf):
    out = answers.validate(_answers(spark, sf)).drop("leaks", "injections", "input_injections")
    return out.withColumns({"invalid": F.array_join("invalid", ","), "unresolved": F.array_join("unresolved", ",")})


@query("""select event_id, case when event_id % 3 = 0 then 1.0 else ((event_id % 2 = 0)::int + (event_id % 5 = 0)::int) / 2.0 end::double c, case when event_id % 2 = 0 and event_id % 3 <> 0 then 1.0 when event_id % 5 = 0 and event_id % 3 <> 0 then 1.0 else 0.0 end::double p from events""")
def citation_coverage(spark, sf):
    i = F.col("event_id")
    want = F.when(i % 3 != 0, F.array(F.lit("a"), F.lit("b"), F.lit("a")))
    have = F.array_compact(F.array(F.when(i % 2 == 0, "a"), F.when(i % 5 == 0, "b")))
    return table(spark, sf, "events").select("event_id", answers.coverage(want, have).alias("c"), answers.precision(want, have).alias("p"))


@query("""select event_id case_id, (event_id % 7 in (1, 2) and event_id % 4 <> 1) or event_id % 4 = 0 passed,
case when event_id % 4 = 0 then event_id % 7 in (1, 2) end retrieval_no_answer_correct from events""")
def case_results(spark, sf):
    i = F.col("event_id")
    ranked = F.when(i % 4 != 1, F.array(F.lit("d1"), F.lit("d2"), F.lit("d3")))
    rows = table(spark, sf, "events").select(i.alias("case_id"), (i % 4 != 0).alias("should_answer"), F.array(F.concat(F.lit("d"), (i % 7).cast("string"))).alias("relevant"), ranked.alias("ranked"))
    return answers.case_results(rows, 2)


def _results(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        i.alias("case_id"), (i % 50 == 0).alias("skipped"), (v > 30).alias("passed"), (i % 4 != 0).alias("should_answer"), (v / 200).alias("precision"), (v / 400).alias("recall"), (i % 3 / 2).alias("mrr"), (v / 300).alias("ndcg"),
        v.alias("latency_ms"), F.when(i % 3 == 0, v / 500).alias("citation_recall"), F.when(i % 5 == 0, i % 2 == 0).alias("shell_correct"), F.when(i % 6 == 0, "timeout").alias("fallback_reason"), (i % 11).alias("total_tokens"),
        F.col("event_type").alias("domain"), (i % 3).alias("topic"), F.when(i % 2 == 0, "linux").alias("platform"), (i % 4).alias("difficulty"),
    )


_RESULTS = """r as (select event_id i, event_id % 50 <> 0 act, value > 30 passed, event_id % 4 <> 0 ask, value v, case when event_id % 3 = 0 then value / 500 end cr, case when event_id % 5 = 0 then event_id % 2 = 0 end sc, event_type, event_id % 6 = 0 fell from events)"""


@query(f"""with {_RESULTS}, o as (from r where act) select (select count(*) from r)::bigint cases, count(*)::bigint evaluated_cases, (select count(*) from r where not act)::bigint skipped_cases, (count(*) filter (where passed))::bigint passed_cases, round(avg(passed::int), 9) pass_rate,
(count(*) filter (where ask))::bigint answerable_cases, (count(*) filter (where not ask))::bigint no_answer_cases, round(avg(passed::int) filter (where ask), 9) answerable_pass_rate, round(avg(passed::int) filter (where not ask), 9) no_answer_pass_rate,
quantile_disc(v, 0.95) p95_latency_ms, round(avg(v / 200), 9) "precision", round(avg(v / 400), 9) recall, round(avg(i % 3 / 2.0), 9) mrr, round(avg(v / 300), 9) ndcg, round(avg(v), 9) mean_latency_ms,
round(avg(v / 200) filter (where ask), 9) answerable_precision, round(avg(v / 400) filter (where ask), 9) answerable_recall, round(avg(i % 3 / 2.0) filter (where ask), 9) answerable_mrr, round(avg(v / 300) filter (where ask), 9) answerable_ndcg,
round(avg(cr), 9) citation_recall, count(cr)::bigint citation_recall_cases, count(sc)::bigint shell_cases, round(avg(sc::int), 9) shell_accuracy, (count(*) filter (where fell))::bigint fallback_cases, round(avg(fell::int), 9) fallback_rate, (count(*) filter (where fell))::bigint timeout_cases, sum(i % 11)::bigint total_tokens from o""")
def evaluation_report(spark, sf):
    out = answers.report(_results(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" and c != "p95_latency_ms" else F.col(c) for c, t in out.dtypes])


@query(f"""with {_RESULTS}, o as (select *, unnest([{{'d': 'domain', 'x': event_type}}, {{'d': 'topic', 'x': (i % 3)::varchar}}, {{'d': 'platform', 'x': case when i % 2 = 0 then 'linux' else 'unspecified' end}}, {{'d': 'difficulty', 'x': (i % 4)::varchar}}]) p from r where act)
select p.d dimension, p.x as value, count(*)::bigint cases, round(avg(passed::int), 9) pass_rate, round(avg(v / 200), 9) "precision", round(avg(v / 400), 9) recall, round(avg(i % 3 / 2.0), 9) mrr, round(avg(v / 300), 9) ndcg, round(avg(v), 9) latency_ms from o group by 1, 2""")
def evaluation_slices(spark, sf):
    out = answers.report_slices(_results(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("""select event_id case_id from events where event_id % 50 <> 0 and value <= 30 order by 1 limit 20""")
def first_failures(spark, sf):
    """A report's list of failed cases: a top 20."""
    return answers.first_failures(_results(spark, sf), 20).select("case_id")


@query("""select count(*)::bigint records, sum(2 + (p_size % 2))::bigint aliases, sum(p_size % 3)::bigint commands, sum(p_size % 5)::bigint removed, (count(*) filter (where p_size % 4 = 0))::bigint with_errors from part""")
def quality_totals(spark, sf):
    k = F.col("p_size")
    r = table(spark, sf, "part").select(
        F.array_repeat(F.lit("a"), 2 + k % 2).alias("aliases"), F.array_repeat(F.lit("c"), k % 3).alias("commands"), (k % 5).alias("removed"), F.array_repeat(F.lit("e"), F.when(k % 4 == 0, 1).otherwise(0)).alias("errors")
    )
    return answers.quality_totals(r)


@query("select distinct text from (select p_name text from part union all select p_type from part union all select trim(coalesce(text, '')) from benchmark) where text <> ''")
def protected_texts(spark, sf):
    topics = table(spark, sf, "part").select(F.col("p_name").alias("title"), F.array("p_type").alias("aliases"))
    return corpus.protected_texts(topics, table(spark, sf, "benchmark").select(F.coalesce("text", F.lit("")).alias("query")))


@query("""select user_id qid, max(event_id) pos, 's' || max(event_id) summary from events where event_type <> 'error' and event_id % 3 <> 0 and event_id % 4 <> 0 and event_id % 5 <> 0 group by 1""")
def last_good_call(spark, sf):
    i = F.col("event_id")
    content = F.when(i % 4 == 0, "no json").when(i % 5 == 0, '{"summary": " "}').otherwise(F.concat(F.lit('{"summary": "s'), i.cast("string"), F.lit('"}')))
    calls = table(spark, sf, "events").select(F.col("user_id").alias("qid"), i.alias("pos"), F.when(F.col("event_type") == "error", "judge").otherwise("answer").alias("task"), F.when(i % 3 == 0, "length").otherwise("stop").alias("finish"), content.alias("content"))
    return corpus.last_good_call(calls)


@query("""with e as (select p_partkey id, p_brand d, unnest([p_name, p_type]) q, unnest([0, 1]) pos from part), k as (select * from e where pos = 0 or d = 'Brand#12')
select d || '-' || lpad(row_number() over (partition by d order by id, pos)::varchar, 5, '0') case_id, q as query, id expected from k""")
def evaluation_cases(spark, sf):
    topics = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"), F.array("p_name", F.lit(" "), "p_type").alias("aliases"))
    return corpus.evaluation_cases(topics, "Brand#12")


@query("""with u as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) previous, text follow_up, row_number() over (partition by conv_id order by turn) n from conversations where role = 'user')
select conv_id, turn, previous, follow_up from u where n > 1""")
def follow_up_cases(spark, sf):
    return corpus.follow_up_cases(table(spark, sf, "conversations"))


@query("""with r as (select user_id run_id, user_id % 7 app, user_id % 2 = 0 ok, user_id % 10 = 0 fs, case when user_id % 3 = 0 then user_id % 6 = 0 end v from (select distinct user_id from events)),
t as (select user_id run_id, event_id pos, case event_id % 4 when 0 then [] when 1 then ['read', event_type] else ['read'] end called, event_id % 50 tokens from events)
select run_id, pos, array_to_string(called, ',') called, app, (list_reduce(list_transform(range(1, 41), lambda i: ('0x' || substr(sha1(app::varchar), i, 1))::int::bigint), lambda a, d: (a * 16 + d) % 100)) < 10 val from t join r using (run_id)
where ok and not fs and not coalesce(v, false) and len(called) > 0 and (len(called) = 1 or called[2] in ('view', 'click'))""")
def run_samples(spark, sf):
    u, i = F.col("user_id"), F.col("event_id")
    e = table(spark, sf, "events")
    runs = e.select(u.alias("run_id")).distinct().select("run_id", (F.col("run_id") % 7).alias("app"), (F.col("run_id") % 2 == 0).alias("success"), (F.col("run_id") % 10 == 0).alias("false_success"), F.when(F.col("run_id") % 3 == 0, F.col("run_id") % 6 == 0).alias("violation"))
    called = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("read"), "event_type")).otherwise(F.array(F.lit("read")))
    out = corpus.run_samples(runs, e.select(u.alias("run_id"), i.alias("pos"), called.alias("called")), ["read", "view", "click"])
    return out.select("run_id", "pos", F.array_join("called", ",").alias("called"), "app", (F.col("split") == "val").alias("val"))


@query("""with a as (select event_type metric, avg(value) v from events where event_id % 2 = 0 group by 1), b as (select event_type metric, avg(value) v from events where event_id % 2 = 1 and event_type <> 'view' group by 1),
j as (select coalesce(a.metric, b.metric) metric, a.v c, b.v b from a full join b on a.metric = b.metric)
select metric, case when c is null or b is null then 'missing' else 'changed' end as "rule" from j where not coalesce(c >= b - 0.01, false) union select metric, 'hard' from a where metric = 'click' and v < 1000 union all select 'gone', 'missing' union all select 'profile', 'profile'""")
def release_gate(spark, sf):
    e = table(spark, sf, "events")
    of = lambda rows: rows.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return evaluation.release_gate(of(e.filter("event_id % 2 = 0")), of(e.filter("event_id % 2 = 1 and event_type <> 'view'")), {"click": 1000.0, "gone": 1.0}, ("a", "b"))
