"""Queries on pages of command examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.operators import pages
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


def _pages(spark, sf):
    """Web pages as pages of examples: each url's path elements as labels and codes. A fifth of them is an alias of the page with a third of
    its number; every 35th points at itself, every 50th at none, and some pages are in two folders."""
    n = F.col("page_id")
    to = F.when(n % 50 == 0, "none").when(n % 35 == 0, F.concat(F.lit("p-"), n.cast("string"))).otherwise(F.concat(F.lit("-x p "), F.floor(n / 3).cast("string")))
    alias = F.concat(F.lit("# a\n\n- View the other:\n\n`see "), to, F.lit("`\n"))
    word = lambda i: F.coalesce(F.get(F.split("url", "/"), F.lit(i)), F.lit("none"))
    parts = [F.concat(F.lit(f"- Label {i} of "), word(2), F.lit(":\n\n  `run "), word(i), F.lit(" {{name}}`\n\n")) for i in (0, 2, 3, 4, 2, 3, 4, 0, 2, 3)]
    text = F.when(n % 5 == 0, alias).when(n % 11 == 0, F.lit("no examples\n- a label\n\n\n\n\n`too far`\n")).otherwise(F.concat(F.lit("# t\n> d\n\n"), *parts))
    base = table(spark, sf, "pages").select(F.concat(F.lit("p-"), n.cast("string")).alias("name"), n, text.alias("text"))
    folders = F.when(n % 4 == 0, F.array(F.lit("osx"), F.lit("linux"))).when(n % 4 == 1, F.array(F.lit("linux"), F.lit("common"), F.lit("android"))).otherwise(F.array(F.lit("windows"), F.lit("osx")))
    each = base.select("name", F.explode(folders).alias("folder"), "text")
    return each.select("name", "folder", F.concat("folder", F.lit("/"), "name").alias("path"), F.when(F.col("folder").isin("android", "windows"), "- x\n`other`").otherwise(F.col("text")).alias("text"))


@query("""with recursive b as (select page_id n, url, case page_id % 4 when 0 then 'linux' when 1 then 'common' else 'osx' end folder from pages),
a as (select n, case when n % 50 = 0 then -1 when n % 35 = 0 then n else n // 3 end t from b where n % 5 = 0),
w as (select n, n at_, 0 steps from b union all select w.n, a.t, steps + 1 from w join a on w.at_ = a.n where steps < 60),
e as (select n, arg_max(at_, steps) at_, max(steps) steps, min('p-' || at_) least_name from w group by 1),
s as (select e.n, case when steps >= 60 then least_name when at_ = -1 then 'none' else 'p-' || at_ end target, case when steps >= 60 then 'cycle' when steps = 0 then 'page' when b.n is null then 'missing' else 'alias' end status, at_ from e left join b on b.n = e.at_),
c as (select b.n, folder || '/p-' || b.n path, unnest(case when b.n % 11 = 0 then [] else [0, 2, 3, 4, 2, 3, 4, 0] end) i, generate_subscripts(case when b.n % 11 = 0 then [] else [0, 2, 3, 4, 2, 3, 4, 0] end, 1) - 1 pos, string_split(url, '/') u from b)
select 'p-' || s.n "name", target, status, case when status in ('page', 'alias') then b.folder || '/p-' || b.n end path, pos::bigint pos, 'Label ' || i || ' of ' || coalesce(u[3], 'none') "label", case when i is not null then 'run ' || coalesce(u[i + 1], 'none') || ' <name>' end code
from s left join b on status in ('page', 'alias') and b.n = s.at_ left join c on status in ('page', 'alias') and c.n = s.at_""")
def page_scan(spark, sf):
    """Pages by name over chains of aliases, with the first eight commands of each."""
    return pages.scan_pages(_pages(spark, sf), "see ").withColumn("pos", F.col("pos").cast("long"))
