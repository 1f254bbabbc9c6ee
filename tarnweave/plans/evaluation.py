"""Evaluation queries: rankings of events against judgments made of the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.functions.scores import p95_exclusive
from tarnweave.operators import evaluation, search
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


_RANKED = """r as (select user_id query_id, event_id doc_id, row_number() over (partition by user_id order by value desc, event_id) rank from events qualify rank <= 10),
q as (select user_id query_id, event_id doc_id, case event_type when 'purchase' then 3 when 'signup' then 2 when 'click' then 1 else 0 end rel from events),
g as (select * from q where rel > 0)"""


def _ranked(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), "value", "event_type")
    rel = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return search.top_k(e, "query_id", [F.col("value").desc(), "doc_id"], 10), e.select("query_id", "doc_id", rel.alias("relevance"))


@query(f"""with {_RANKED}, h as (select * from r join g using (query_id, doc_id) where rank <= 5),
p as (select query_id, count(*) n, min(rank) f, sum((pow(2.0::double, rel) - 1) / log2(rank + 1)) dcg from h group by 1),
t as (select query_id, count(*) total from g group by 1),
i as (select query_id, sum((pow(2.0::double, rel) - 1) / log2(k + 1)) idcg from (select *, row_number() over (partition by query_id order by rel desc, doc_id) k from g qualify k <= 5) group by 1)
select query_id, round(coalesce(n / 5.0::double, 0), 6) "precision", round(coalesce(n::double / total, 0), 6) recall, round(coalesce(1.0::double / f, 0), 6) mrr, round(coalesce(dcg / idcg, 0), 6) ndcg
from t join i using (query_id) left join p using (query_id)""")
def ranking_metrics(spark, sf):
    ranking, qrels = _ranked(spark, sf)
    return evaluation.ranking_metrics(ranking, qrels, 5)


_SETS = """(select user_id, list_distinct(list(event_type) filter (where value > 50)) a, list_distinct(list(event_type) filter (where value < 20)) e from events group by 1)"""


@query(f"""select user_id, case when len(coalesce(e, [])) > 0 then round(coalesce(len(list_intersect(coalesce(a, []), e)) / nullif(len(coalesce(a, [])), 0)::double, 0), 6) end set_precision,
 case when len(coalesce(e, [])) > 0 then round(len(list_intersect(coalesce(a, []), e)) / len(e)::double, 6) end set_recall from {_SETS}""")
def set_precision_recall(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 20, F.col("event_type"))).alias("e")
    )
    return evaluation.set_precision_recall(e, "a", "e").select("user_id", "set_precision", "set_recall")


def _cases(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("value") > 30).alias("passed"), F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") / 100, 4)).alias("recall"), F.col("value").alias("latency"), "event_type",
        (F.col("event_id") % 3).alias("level"), F.when(F.col("event_id") % 2 == 0, "linux").alias("platform"),
    )


_CASES = "c as (select value > 30 passed, case when event_id % 4 <> 0 then round(value / 100, 4) end recall, value latency, event_type, event_id % 3 \"level\", case when event_id % 2 = 0 then 'linux' end platform from events)"


@query(f"with {_CASES} select count(*)::bigint cases, round(avg(passed::int::double), 6) pass_rate, round(coalesce(avg(recall), 0), 6) mean_recall, quantile_disc(latency, 0.95) p95_latency from c")
def report_metrics(spark, sf):
    return evaluation.report(_cases(spark, sf), ["recall"])


@query(f"""with {_CASES}, s as (select unnest(list_filter([event_type, 'level:' || "level"::varchar, 'platform:' || platform], lambda x: x is not null)) slice, * from c)
select slice, count(*)::bigint cases, round(avg(passed::int::double), 6) pass_rate, round(coalesce(avg(recall), 0), 6) mean_recall from s group by 1""")
def report_slices(spark, sf):
    return evaluation.slices(_cases(spark, sf), ["event_type", "level", "platform"], ["recall"])


@query("select user_id, quantile_disc(value, 0.95) p95 from events group by 1")
def p95_nearest_rank(spark, sf):
    return evaluation.latency_by(table(spark, sf, "events"), "user_id", "value")


@query("""with v as (select user_id, list_sort(list(value)) v, count(*) n from events group by 1), p as (select *, (n + 1) * 19 m, greatest(1, least(n - 1, (n + 1) * 19 // 20)) j from v)
select user_id, round(case when n = 1 then v[1] else v[j] * (1 - (m - j * 20) / 20.0::double) + v[j + 1] * ((m - j * 20) / 20.0::double) end, 6) p95 from p""")
def p95_exclusive_quantile(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    return v.select("user_id", F.round(p95_exclusive(F.col("v")), 6).alias("p95"))


_HALF = "select event_type, avg(value) mean_value, quantile_disc(value, 0.95) p95_value from events where event_id % 2 = {} group by 1"


@query(f"""with c as (unpivot (select 'mean:' || event_type m, mean_value from ({_HALF.format(0)})) on mean_value into name k value v), cb as (select m metric, v "value" from c union all select 'p95:' || event_type, p95_value from ({_HALF.format(0)})),
bb as (select 'mean:' || event_type metric, mean_value "value" from ({_HALF.format(1)}) union all select 'p95:' || event_type, p95_value from ({_HALF.format(1)}))
select metric, round(a."value", 6) candidate, round(b."value", 6) baseline, coalesce(case when starts_with(metric, 'p95') then a."value" <= b."value" * 1.2::double else a."value" >= b."value" - 0.01::double end, false) ok
from cb a full join bb b using (metric)""")
def gate_compare(spark, sf):
    def half(i):
        e = table(spark, sf, "events").filter(F.col("event_id") % 2 == i)
        m = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))
        return m.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k}:"), "event_type").alias("metric"), F.col(k).alias("value")) for k in ("mean", "p95")])).alias("x")).select("x.*")

    g = evaluation.gate(half(0), half(1))
    return g.select("metric", F.round("candidate", 6).alias("candidate"), F.round("baseline", 6).alias("baseline"), "ok")


@query("""with q as (select user_id, event_id // 2 doc, value::int rel, event_id % 9 iteration from events)
select user_id, doc, 'iteration' rule from q where iteration <> 0 union all select user_id, doc, 'relevance' from q where rel < 10
union all select user_id, doc, 'duplicate' from q group by user_id, doc having count(*) > 1""")
def golden_validation_errors(spark, sf):
    from tarnweave.sources.readers import qrels_errors

    e = table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.floor(F.col("event_id") / 2).alias("doc_id"), (F.col("event_id") % 9).cast("string").alias("iteration"),
        (F.round("value").cast("int") - 10).alias("relevance"),
    )
    return qrels_errors(e).withColumnsRenamed({"query_id": "user_id", "doc_id": "doc"})
