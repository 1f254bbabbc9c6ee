"""Queries on what an evaluation covers, and on a catalog's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.functions.text import catalog_command, catalog_text
from tarnweave.operators import release
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


@query("""with d as (select conv_id % 7 dataset, sha256(coalesce(len(conv_id::varchar) || ':' || conv_id, '-') || coalesce(len(turn::varchar) || ':' || turn, '-') || coalesce(len(role) || ':' || role, '-') || coalesce(len(text) || ':' || text, '-')) h from conversations)
select dataset, count(*) n, sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::bigint::hugeint) || ':' || sum(('0x' || substr(h, 16, 15))::bigint::hugeint)) fingerprint from d group by 1""")
def dataset_fingerprints(spark, sf):
    c = table(spark, sf, "conversations").withColumn("dataset", F.col("conv_id") % 7)
    return release.fingerprints(c, "dataset", ["conv_id", "turn", "role", "text"])


@query("""with g as (select conv_id % 7 d, count(*) filter (where conv_id % 70 = 2 and turn = 0) changed from conversations group by 1)
select case when d = 0 then '9' else d::varchar end dataset, case when d = 0 then 'fingerprint_unknown' else 'fingerprint_differs' end rule from g where d = 0 or (d = 2 and changed > 0)
union all select '0', 'fingerprint_missing' from g where d = 0""")
def stale_datasets(spark, sf):
    """A report's fingerprints when a first turn of dataset 2 was said twice, and dataset 0 had another name."""
    c = table(spark, sf, "conversations").withColumn("dataset", F.col("conv_id") % 7)
    was = c.unionByName(c.filter("conv_id % 70 = 2 and turn = 0")).withColumn("dataset", F.when(F.col("dataset") == 0, 9).otherwise(F.col("dataset")))
    cols = ["conv_id", "turn", "role", "text"]
    return release.fingerprint_issues(release.fingerprints(c, "dataset", cols), release.fingerprints(was, "dataset", cols), "dataset")


@query("""with t as (select conv_id k, greatest(1, count(*) filter (where lower(role) = 'user' and trim(coalesce(text, '')) <> '')) n from conversations group by 1)
select (k % 7)::varchar dataset, k case_id, unnest(list_filter([case when k % 17 = 3 then 'lost' end, case when k % 17 = 5 then 'duplicate' end, case when k % 17 <> 3 and k % 13 = 0 and k % 2 = 1 then 'skipped' end,
  case when k % 17 <> 3 and k % 13 <> 0 and k % 19 = 4 then 'calls' end, case when k % 17 <> 3 and k % 13 <> 0 and k % 23 = 6 and not (k % 19 = 4 and n = 1) then 'call_invalid' end], lambda x: x is not null)) rule from t
union all select null, -k - 1, 'foreign' from t where k % 17 = 7""")
def release_issues(spark, sf):
    """Every conversation is a case. Results are lost, doubled or of other cases, skip, and lack the last call, by their number."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), "turn", "role", "text")
    k = F.col("case_id")
    cases = turns.select("case_id").distinct().select("case_id", (k % 7).alias("dataset"), F.lit(None).cast("string").alias("previous_query"), (k % 2 == 0).alias("may_skip"))
    expected = release.turns_of_cases(cases, turns.drop("turn"))
    no = F.explode(F.when(k % 17 == 3, F.array().cast("array<int>")).when(k % 17 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("result_no")
    results = expected.select("case_id", "n_turns", no, (k % 13 == 0).alias("skipped"))
    made = F.col("n_turns") - F.when(k % 19 == 4, 1).otherwise(0)
    calls = results.filter(made > 0).select("case_id", "result_no", F.explode(F.sequence(F.lit(1), made)).alias("call"))
    calls = calls.select("case_id", "result_no", F.when((k % 23 == 6) & (F.col("call") == 1), F.lit(None)).otherwise(True).alias("attempted"), F.lit("").alias("fallback_reason"))
    other = cases.filter(k % 17 == 7).select((-k - 1).alias("case_id"), F.lit(0).alias("result_no"), F.lit(False).alias("skipped"))
    return release.case_issues(expected, results.drop("n_turns").unionByName(other), calls, True)


@query("""with p as (select page_id, page_id % 6 k, coalesce(string_split(url, '/')[3], 'none') w from pages)
select page_id, case k when 0 then 'tar --create <' || w || '>' when 1 then 'ls <' || w || '/{a,b}> {{' || w || '}}' when 2 then 'docker ps --format ''{{.Names}}'' <' || w || '>'
  when 3 then 'docker ps <.Names>' when 4 then 'sort <' || w || ' x> <> 1 > 2' else 'cut --fields <' || w || '>' end code from p""")
def catalog_commands(spark, sf):
    """Commands of pages with choices, nested braces, escapes, templates and loose names; the words are those of each url."""
    w = F.coalesce(F.get(F.split("url", "/"), F.lit(2)), F.lit("none"))
    forms = [
        ("tar {{[-c|--create]}} {{", w, "}}"), ("ls {{", w, "/{a,b}}} \\{\\{", w, "\\}\\}"), ("docker ps --format '{{.Names}}' {{", w, "}}"), ("docker ps {{.Names}}",),
        ("sort <  ", w, " x > <> 1 > 2"), ("cut {{[-f|-g|--fields]}} <", w, ">"),
    ]
    k, code = F.col("page_id") % 6, F.lit(None).cast("string")
    for i, parts in enumerate(forms):
        code = F.when(k == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(code)
    return table(spark, sf, "pages").select("page_id", catalog_command(code).alias("code"))


_LINES = "list_transform(string_split(regexp_replace(replace(replace(replace({}, '>', '>' || chr(10) || chr(10) || chr(9)), '.', '. ' || chr(13) || chr(10)), '/', '/' || chr(8203)), '[\\x{{200B}}\\x{{FEFF}}]', '', 'g').replace(chr(13) || chr(10), chr(10)).replace(chr(13), chr(10)), chr(10)), lambda l: {})"


@query(f"""with l as (select page_id, {_LINES.format("nfc_normalize(html)", "rtrim(l, ' ' || chr(9) || chr(160))")} c, {_LINES.format("html", "trim(l, ' ' || chr(9))")} p from pages)
select page_id, sha256(regexp_replace(array_to_string(c, chr(10)), '^\\n+|\\n+$', '', 'g')) code_sha256, sha256(regexp_replace(regexp_replace(array_to_string(p, chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) prose_sha256 from l""")
def catalog_texts(spark, sf):
    """Every page's source as code and as prose, with line ends, tabs and zero-width signs put in."""
    h = F.replace(F.replace("html", F.lit(">"), F.lit(">\n\n\t")), F.lit("."), F.lit(". \r\n"))
    h = F.replace(h, F.lit("/"), F.lit("/​"))
    return table(spark, sf, "pages").select("page_id", F.sha2(catalog_text(h, True), 256).alias("code_sha256"), F.sha2(catalog_text(h), 256).alias("prose_sha256"))
