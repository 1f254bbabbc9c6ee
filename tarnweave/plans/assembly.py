"""Queries on answers put together from evidence, and on nested reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.functions import nested
from tarnweave.operators import assembly, records
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


def _digit(n: int):
    """A number from 0 to 15 that the n-th sign of an event's hash draws."""
    return F.conv(F.substring(F.md5(F.col("event_id").cast("string")), n, 1), 16, 10).cast("int")


def _drawn(spark, sf):
    """Events as commands: same words, with and without quotes, with one of two placeholders, an option or nothing behind."""
    e = table(spark, sf, "events")
    quote = F.when(_digit(1) < 8, '"').otherwise("")
    end = F.when(_digit(2) < 5, " <branch_name>").when(_digit(2) < 10, " <path/to/file>").when(_digit(2) < 12, " --all").otherwise("")
    return e.select("user_id", "event_id", _digit(3).alias("draw"), _digit(4).alias("source"), F.concat(F.lit("run "), quote, "event_type", quote, end).alias("code"), "event_type")


_DRAWN = """(select user_id answer_id, event_id, ('0x' || md5(event_id::varchar)[3])::int draw, ('0x' || md5(event_id::varchar)[4])::int source, event_type,
  'run ' || q || event_type || q || case when d < 5 then ' <branch_name>' when d < 10 then ' <path/to/file>' when d < 12 then ' --all' else '' end code
  from (select *, case when ('0x' || md5(event_id::varchar)[1])::int < 8 then '"' else '' end q, ('0x' || md5(event_id::varchar)[2])::int d from events))"""
_CITED = """e as (select answer_id, event_id place, code, source < 3 upload, 'c' || (event_id % 11) cid from d where draw >= 6 and event_type <> 'click'),
r as (select answer_id, cid, min(place) rank from e group by 1, 2), ev as (select e.*, rank from e join r using (answer_id, cid))"""


def _evidence(d):
    e = d.filter("draw >= 6 and event_type <> 'click'").select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("place"), "code", (F.col("source") < 3).alias("upload"), F.concat(F.lit("c"), F.col("event_id") % 11).alias("citation_id"))
    return e.join(e.groupBy("answer_id", "citation_id").agg(F.min("place").alias("rank")), ["answer_id", "citation_id"])


@query(rf"""with d as {_DRAWN}, m as (select answer_id, event_id pos, code || '  ' raw, code, regexp_replace(replace(code, '"', ''), '<.*>', '<>') k from d where draw < 6),
{_CITED},
u as (select answer_id, code, string_agg(cid, ',' order by rank) ids, min(rank) rank from (select distinct answer_id, code, cid, rank from ev where upload) group by 1, 2),
c as (select *, regexp_replace(replace(code, '"', ''), '<.*>', '<>') k from ev where not upload),
f as (select m.answer_id, m.pos, case when u.code is not null then 'u' || m.code end uk, m.raw, u.ids uids, u.rank urank,
    (select arg_min({{'code': c.code, 'cid': c.cid, 'rank': c.rank}}, c.place) from c where c.answer_id = m.answer_id and c.code = m.code) x,
    (select arg_min({{'code': c.code, 'cid': c.cid, 'rank': c.rank}}, c.place) from c where c.answer_id = m.answer_id and c.k = m.k) b
  from m left join u on u.answer_id = m.answer_id and u.code = m.code),
g as (select answer_id, pos, case when uk is not null then 0 when x is not null then 1 when b is not null then 2 end tier, coalesce(uk, 'b' || coalesce(x.code, b.code)) sk,
    case when uk is not null then raw else coalesce(x.code, b.code) end code, case when uk is not null then uids else coalesce(x.cid, b.cid) end ids, case when uk is not null then urank else coalesce(x.rank, b.rank) end rank from f),
h as (select * from g where tier is not null qualify row_number() over (partition by answer_id, sk order by pos) = 1)
select answer_id, row_number() over (partition by answer_id order by rank, pos) place, pos, code, ids citations, tier from h""")
def grounded_commands(spark, sf):
    """Commands of answers that differ from the evidence in quotes or placeholders, some of them uploaded."""
    d = _drawn(spark, sf)
    mine = d.filter("draw < 6").select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("pos"), F.concat("code", F.lit("  ")).alias("code"))
    out = assembly.ground_commands(mine, _evidence(d))
    return out.select("answer_id", "place", "pos", "code", F.array_join("citation_ids", ",").alias("citations"), "tier")


@query(rf"""with d as {_DRAWN}, {_CITED},
s as (select answer_id, event_id pos, case when source = 1 then ' ' else code end txt, ['c' || (event_id % 11), 'zz', 'c' || (source % 11), 'c' || (event_id % 11)] ids from d where draw < 4),
x as (select answer_id, pos, txt, unnest(ids) cid, generate_subscripts(ids, 1) i from s where trim(txt) <> ''),
k as (select answer_id, pos, txt, cid, min(i) i from x where (answer_id, cid) in (select answer_id, cid from r) group by 1, 2, 3, 4),
o as (select answer_id, pos, txt "text", string_agg(cid, ',' order by i) citations from k group by 1, 2, 3),
b as (select answer_id, arg_min(cid, rank) cid from r group by 1)
select * from o union all select answer_id, 0, 'summary of ' || answer_id, cid from b where answer_id not in (select answer_id from o) and answer_id % 5 <> 0""")
def grounded_segments(spark, sf):
    d = _drawn(spark, sf)
    c = lambda x: F.concat(F.lit("c"), x % 11)
    segments = d.filter("draw < 4").select(
        F.col("user_id").alias("answer_id"), F.col("event_id").alias("pos"), F.when(F.col("source") == 1, " ").otherwise(F.col("code")).alias("text"),
        F.array(c(F.col("event_id")), F.lit("zz"), c(F.col("source")), c(F.col("event_id"))).alias("citation_ids"),
    )
    said = F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.concat(F.lit("summary of "), "user_id", F.lit(" ")))
    summaries = d.select(F.col("user_id").alias("answer_id"), said.alias("summary")).distinct()
    out = assembly.ground_segments(segments, _evidence(d), summaries)
    return out.select("answer_id", "pos", "text", F.array_join("citation_ids", ",").alias("citations"))


def _reports(spark, sf):
    """Documents as nested reports: their lines four levels down."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("t"), i.alias("n")))
    body = F.struct(F.array(F.struct(lines.alias("lines"), F.struct(F.length("text").alias("password"), F.length("text").alias("total_tokens")).alias("sizes"))).alias("parts"))
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", body.alias("body"), F.struct("lang", F.array("source").alias("from")).alias("meta"))).alias("report"))


_LEAK = r"""(-----BEGIN( [A-Z]+)? PRIVATE KEY-----|\b(sk-(proj-)?|[rps]k_)[A-Za-z0-9_-]{16,}\b|\b[gG][hH][pP]_[A-Za-z0-9_]{16,}\b|\b(?i:github_pat)_[A-Za-z0-9_]{16,}\b|\bAKIA[0-9A-Z]{16}\b|(?i:\b(authorization\s*:\s*bearer|bearer)\s+[a-z0-9._~+/=-]{16,})|(?i:\b(api[_-]?key|token|password|secret)\s*[=:]\s*['"]?[a-z0-9._~+/=-]{12,}))"""
_LINES = "(select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents)"


@query(f"""select doc_id, '$.body.parts[0].lines[' || i || '].t' path from {_LINES} where regexp_matches(t, '{_LEAK.replace("'", "''")}')""")
def report_leaks(spark, sf):
    """Paths of credentials in nested JSON."""
    return nested.find_leaks(_reports(spark, sf), "report", ["doc_id"])


@query(f"""select d.doc_id, sha256(string_agg(regexp_replace(t, '{_LEAK.replace("'", "''")}', '[REDACTED]', 'g'), chr(10) order by i)) lines_sha256, '[REDACTED]' password, any_value(length(text))::varchar total_tokens
from documents d join {_LINES} l using (doc_id) group by 1""")
def redacted_reports(spark, sf):
    """Copies of nested JSON without credentials and fields named as secrets; counts of tokens stay."""
    out = _reports(spark, sf).select("doc_id", nested.redact_json("report").alias("report"))
    shape = "body struct<parts: array<struct<lines: array<struct<t: string>>, sizes: struct<password: string, total_tokens: string>>>>"
    part = F.from_json("report", shape)["body"]["parts"][0]
    return out.select("doc_id", part.alias("p")).select("doc_id", F.sha2(F.array_join("p.lines.t", "\n"), 256).alias("lines_sha256"), "p.sizes.password", "p.sizes.total_tokens")


@query(r"""with m as (select p_partkey, unnest([1, 2, 3]) i, unnest(['<' || split_part(p_name, ' ', 1) || '-file>', '<' || split_part(p_name, ' ', 2) || '_port>', '<' || p_brand || '>']) raw from part),
n as (select *, lower(raw[2:-2]) n from m), f as (select * from n qualify row_number() over (partition by p_partkey, n order by i) = 1)
select p_partkey, string_agg(raw || '=' || case when n like '%\_port' escape '\' then 'port' when n ~ '.*(file|dir|path).*' then 'path' when n ~ '.*(branch|tag|key|host|user|field).*' then 'identifier' else 'value' end, ' ' order by i) marks from f group by 1""")
def typed_placeholders(spark, sf):
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    code = F.concat(F.lit("cp <"), word(0), F.lit("-file> <"), word(1), F.lit("_port> <<EOF <"), "p_brand", F.lit("> <"), F.upper(word(0)), F.lit("-FILE>"))
    marks = F.transform(records.typed_placeholders(code), lambda m: F.concat(m["raw"], F.lit("="), m["kind"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(marks, " ").alias("marks"))
