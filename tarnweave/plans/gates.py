"""Queries on whole reports, turns in two forms and contradicted facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.functions import slots
from tarnweave.functions.text import estimate_tokens
from tarnweave.operators import gate, memory
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


def _reports(spark, sf, half: int):
    """A report for each user over their even or odd events; a fault goes by the user's number, baselines have but another profile."""
    e = table(spark, sf, "events").filter(F.col("event_id") % 2 == half)
    if half:
        e = e.filter("user_id % 5 <> 0")
    d = F.col("user_id") % 12
    fault = lambda n: F.lit(not half) & (d == n)
    case = F.struct(F.col("event_id").cast("string").alias("case_id"), (F.col("value") > 30).alias("passed"), F.when(fault(8), "timeout").alias("fallback_reason"))
    g = e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 30).alias("ok"), F.max("value").alias("top"), F.min("value").alias("low"),
        F.collect_list(case).alias("cases"), F.collect_list(F.when(F.col("value") <= 30, F.col("event_id").cast("string"))).alias("failed"),
    )
    quality = F.col("ok") / F.col("n")
    counts = F.struct(
        (F.col("n") + F.when(fault(3), 1).otherwise(0)).alias("cases"), F.col("n").alias("evaluated_cases"), F.lit(0).alias("skipped_cases"), F.col("ok").alias("passed_cases"),
        F.when(fault(4), 1).otherwise(0).alias("error_cases"), quality.alias("pass_rate"),
    )
    profile = F.when(~fault(1), F.when(F.lit(bool(half)) & (d == 10), "short").otherwise("full"))
    report = F.struct(
        profile.alias("profile"), F.when(~fault(2), quality).alias("quality"), F.when(fault(2), "good").alias("quality_score"), (F.col("top") * F.when(fault(9), 2).otherwise(1)).alias("p95_ms"),
        F.col("low").alias("cost_usd"), counts.alias("metrics"), "cases", F.col("failed").alias("failed_case_ids"), F.when(fault(5), F.array(F.lit("c9"))).alias("citation_errors"),
        F.lit("abc").alias("commit"), F.when(fault(6), "abd").otherwise("abc").alias("expected_commit"), F.array(F.struct(F.when(fault(7), "token=abcdefghijklmnop1234").alias("x"))).alias("notes"),
    )
    return g.select("user_id", F.when(fault(11), "{broken").otherwise(F.to_json(report)).alias("report"))


@query("""with h as (select user_id, event_id % 2 half, count(*) n, count(*) filter (where value > 30) ok, max(value) top, min(value) low from events group by 1, 2),
c as (select user_id, user_id % 12 d, c.n, c.ok, c.ok / c.n::double q, c.top * case when user_id % 12 = 9 then 2 else 1 end p, c.low, b.n bn, b.ok bok, b.ok / b.n::double bq, b.top bp, b.low bl
  from (from h where half = 0) c left join (from h where half = 1 and user_id % 5 <> 0) b using (user_id)),
o as (select *, case when d = 11 then ['schema:schema:not_an_object'] else list_filter([case when d = 1 then 'profile:schema:missing' end, case when d = 2 then 'quality:schema:missing' end,
  case when d = 3 then 'metrics:schema:list_length' end, case when d = 3 then 'metrics:schema:skipped' end, case when ok = 0 then 'metrics:schema:none_passed' end, case when d = 4 then 'execution_errors:hard:errors' end,
  case when d = 5 then 'invalid_citations:hard:reported' end, case when d = 6 then 'commit_mismatch:hard:differs' end, case when d = 7 then 'credential_leakage:hard:found' end,
  case when d = 8 then 'provider_failures:hard:hidden' end, case when bn is null and ok < n then 'failed_cases_without_baseline:hard:failed' end, case when bn is null and ok = 0 and d <> 2 then 'zero_quality:hard:zero' end], lambda x: x is not null) end own,
  list_filter([case when q < bq - 0.01::double then 'quality:tolerance:fell' end, case when bp = 0 and p > 0 or bp <> 0 and p > bp * 1.2::double then 'p95:tolerance:grew' end,
  case when bl = 0 and low > 0 or bl <> 0 and low > bl * 1.2::double then 'cost:tolerance:grew' end], lambda x: x is not null) moved from c)
select user_id, case when len(own) > 0 then 'fail' when bn is null then 'pass' when bok = 0 then 'fail' when d = 10 then 'not_comparable' when len(moved) > 0 then 'fail' else 'pass' end status,
  len(own) = 0 and (bn is null or (bok > 0 and d <> 10)) comparable,
  array_to_string(list_sort(case when len(own) > 0 then own when bn is null then [] when bok = 0 then ['metrics:schema:none_passed'] when d = 10 then [] else moved end), ',') issues from o""")
def report_gate(spark, sf):
    """Every reason against a release, from whole JSON reports and their baselines."""
    out = gate.report_issues(_reports(spark, sf, 0), _reports(spark, sf, 1), "user_id")
    said = F.transform("issues", lambda x: F.concat_ws(":", x["gate"], x["kind"], x["reason"]))
    return out.select("user_id", "status", "comparable", F.array_join(said, ",").alias("issues"))


def _estimate(c: str) -> str:
    return f"greatest(1, ceil(octet_length(encode({c})) / 4.0))"


@query(f"""with recursive p as (select conv_id, turn, text, role, lead(role) over w nr, lead(text) over w nt from conversations where role in ('user', 'assistant') and trim(coalesce(text, '')) <> '' window w as (partition by conv_id order by turn)),
k as (select conv_id, turn, ({_estimate('text')} + {_estimate('nt')})::bigint f, ({_estimate('text[:240]')} + {_estimate('nt[:160]')})::bigint c, 1752 - conv_id % 5 * 400 start from p where role = 'user' and nr = 'assistant'),
o as (select *, row_number() over (partition by conv_id order by turn desc) i, case when count(*) over (partition by conv_id) > 1 then 360 else 0 end aside from k),
r as (select conv_id, 0::bigint i, null::bigint turn, ''::varchar form, 0::bigint tokens, start::bigint rest, false stop from o where i = 1 union all
  select conv_id, i, turn, form, case when tokens <= free then tokens end, rest - case when tokens <= free then tokens else 0 end, i > 2 and tokens > free from (
    select o.conv_id, o.i, o.turn, r.rest, greatest(0, r.rest - case when o.i = 1 then o.aside else 0 end) free, o.i <= 2 and o.f > free small, case when small then 'compact' else 'full' end form, case when small then o.c else o.f end tokens
    from r join o on o.conv_id = r.conv_id and o.i = r.i + 1 where not r.stop))
select conv_id, turn, form, tokens from r where turn is not null and tokens is not null""")
def turns_two_forms(spark, sf):
    """Newest turns that fit beside a summary, the first two in compact form where they must."""
    p = memory.turn_pairs(table(spark, sf, "conversations"))
    cost = lambda q, a: estimate_tokens(q) + estimate_tokens(a)
    q, a = F.col("question"), F.col("answer")
    return memory.two_form_turns(p.select("conv_id", F.col("user_turn").alias("turn"), cost(q, a).alias("full"), cost(F.substring(q, 1, 240), F.substring(a, 1, 160)).alias("compact"), (F.col("conv_id") % 5 * 400).alias("base")))


#: What the events' facts and mentions say, by slot.
_SAID = {"os": ["linux", "windows", "macos", "ubuntu 22"], "shell": ["bash", "powershell 7", "zsh", "cmd"], "runtime": ["python", "python 3.12", "java", "java 17"], "language": ["en", "de", "en us", "fr"]}
_FACTS = f"""f as (select event_id, user_id, [{", ".join(f"'{s}'" for s in _SAID)}][event_id % 4 + 1] slot,
  [{", ".join("[" + ", ".join(f"'{v}'" for v in vs) + "]" for vs in _SAID.values())}][event_id % 4 + 1][('0x' || md5(event_id::varchar)[1])::int % 4 + 1] v, ('0x' || md5(event_id::varchar)[2])::int < 4 off from events)"""


@query(f"""with {_FACTS}, j as (select f.event_id, f.slot, f.v, m.slot ms, m.v mv, m.off off, m.slot = f.slot and (f.v = m.v or f.slot <> 'language' and (starts_with(f.v, m.v || ' ') or starts_with(m.v, f.v || ' '))) agrees
  from f left join (from f where event_id % 23 = 0) m using (user_id)),
g as (select event_id, slot, v, bool_or(off and agrees) ruled_out, bool_or(not off and ms = slot) asked, bool_or(not off and agrees) met, bool_or(not off and ms = 'os') has_os,
  bool_or(not off and ms = 'os' and mv not in ('linux', 'macos')) not_unix, bool_or(not off and ms = 'shell' and mv in ('bash', 'zsh')) unix_shell, bool_or(not off and ms = 'shell' and mv = 'cmd') windows_shell from j group by all)
select event_id, coalesce(ruled_out, false) or coalesce(asked and not coalesce(met, false), false)
  or coalesce(slot = 'shell' and has_os and case when not_unix then v in ('bash', 'zsh') else v in ('powershell 7', 'cmd') end, false)
  or coalesce(slot = 'os' and (unix_shell and v = 'windows' or windows_shell and v in ('linux', 'macos')), false) conflict from g""")
def slot_conflicts(spark, sf):
    """Facts that what their user said outright contradicts: families and versions agree, systems and shells must fit."""
    digit = lambda n: F.conv(F.substring(F.md5(F.col("event_id").cast("string")), n, 1), 16, 10).cast("int")
    values = F.array(*[F.array(*map(F.lit, vs)) for vs in _SAID.values()])
    at = F.col("event_id") % 4
    f = table(spark, sf, "events").select("event_id", "user_id", F.get(F.array(*map(F.lit, _SAID)), at).alias("slot"), F.get(F.get(values, at), digit(1) % 4).alias("value"), (digit(2) < 4).alias("off"))
    said = F.concat(F.when(F.col("off"), "!").otherwise(""), "value")
    by_slot = f.filter("event_id % 23 = 0").groupBy("user_id", "slot").agg(F.collect_set(said).alias("said"))
    explicit = by_slot.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "said"))).alias("explicit"))
    return f.join(explicit, "user_id", "left").select("event_id", slots.contradicted(F.col("slot"), F.col("value"), F.col("explicit")).alias("conflict"))
