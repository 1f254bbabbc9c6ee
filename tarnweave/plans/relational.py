"""Joins, aggregates, filters and top-k on the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.operators import search
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


def matching(columns: list[str], text: str | None = None, ids: tuple[str, list] | None = None, **equal):
    """The conjunction of what is given: equalities, membership (none for an empty list), and a like over columns."""
    conds = [F.col(c) == v for c, v in equal.items() if v is not None]
    if ids is not None:
        conds.append(F.col(ids[0]).isin(ids[1]) if ids[1] else F.lit(False))
    if text:
        conds.append(reduce(lambda a, c: a | F.col(c).ilike(f"%{text}%"), columns, F.lit(False)))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


@query("""select n_nationkey, n_name, count(distinct c_custkey)::bigint customers, count(distinct case when c_acctbal > 0 then c_custkey end)::bigint solvent,
 coalesce((select count(*) from orders o join customer c2 on o.o_custkey = c2.c_custkey where c2.c_nationkey = n.n_nationkey), 0)::bigint orders
from nation n left join customer c on c.c_nationkey = n.n_nationkey group by n_nationkey, n_name""")
def base_rollup(spark, sf):
    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))
    per = c.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("solvent"))
    made = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("o_nationkey")).agg(F.count("*").alias("orders"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(made, F.col("n_nationkey") == F.col("o_nationkey"), "left").select("n_nationkey", "n_name", zero("customers"), zero("solvent"), zero("orders"))


@query("select c_custkey, c_name, n_name from customer left join nation on c_nationkey = n_nationkey")
def left_join_snapshot(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", "n_name")


@query("select o_orderkey, o_custkey from orders where o_orderkey in (select distinct l_orderkey from lineitem where l_quantity > 49)")
def semi_join_in_subquery(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").filter("l_quantity > 49")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@query("select doc_id from documents anti join labels using (doc_id)")
def anti_join_fk_check(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("select p_partkey, p_name, p_brand from part where p_size = 15 and (p_name ilike '%a%' or p_brand ilike '%a%' or p_type ilike '%a%')")
def dynamic_filter_search(spark, sf):
    return table(spark, sf, "part").filter(matching(["p_name", "p_brand", "p_type"], text="a", p_size=15)).select("p_partkey", "p_name", "p_brand")


@query("select user_id, arg_max(event_type, (ts, event_id)) last_type, max(ts) last_ts from events group by 1")
def latest_per_key(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


@query("select event_id, user_id from events qualify row_number() over (partition by user_id order by value desc, event_id) > 5")
def retention_beyond_n(spark, sf):
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    return table(spark, sf, "events").withColumn("n", place).filter("n > 5").select("event_id", "user_id")


@query("select source, lang, count(*)::bigint n, sum(length(text))::bigint chars from documents group by 1, 2")
def domain_histogram(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) discount, count(*)::bigint n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def priced_rollup(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"),
    )


@query("""select o.o_orderkey, o.o_custkey, r.r_name, s.n from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
 join (select l_orderkey, count(*)::bigint n from lineitem group by 1) s on s.l_orderkey = o.o_orderkey""")
def order_scan_join(spark, sf):
    o, c, n, r, li = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region", "lineitem"))
    s = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.join(s, o.o_orderkey == s.l_orderkey).select("o_orderkey", "o_custkey", "r_name", "n")


@query("select sha256(string_agg(source || '=' || n::varchar, ',' order by source)) bundle, count(*)::bigint sources from (select source, count(*) n from documents where source is not null group by 1)")
def bundle_hash(spark, sf):
    d = table(spark, sf, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return search.bundle_hash(d, "source", "n")