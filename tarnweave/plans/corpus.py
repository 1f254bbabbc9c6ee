"""Training-set queries on the documents, vectors and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.functions import safety
from tarnweave.functions.scores import hash_bucket
from tarnweave.functions.text import CJK
from tarnweave.operators import corpus
from tarnweave.plans.text import _SQL_RULES
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


_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"select doc_id from documents where text is not null and {_NORM.format('text')} not in (select {_NORM.format('text')} from documents where source = 'src1' and text is not null)")
def decontaminate_exact(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return corpus.drop_exact(d, "text", d.filter("source = 'src1'"), "text").select("doc_id")


@query("""with v as (select vec_id, embedding::double[] e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) l from v),
s as (select q.vec_id, c.vec_id nearest, round(list_dot_product(q.e, c.e) / (q.l * c.l), 6) cosine from n q, n c where q.vec_id % 50 = 0 and c.vec_id % 50 = 1)
select vec_id, nearest, cosine, cosine < 0.85 kept from s qualify row_number() over (partition by vec_id order by cosine desc, nearest) = 1""")
def decontaminate_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    best = corpus.nearest_protected(e.filter("vec_id % 50 = 0"), e.filter("vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), "embedding"))
    return best.withColumn("kept", F.col("cosine") < 0.85)


@query("""with v as (select vec_id, embedding::double[] e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) l from v),
s as (select c.vec_id, q.vec_id nearest, round(list_dot_product(q.e, c.e) / (q.l * c.l), 6) cosine from n c, n q where q.vec_id % 50 = 0)
select vec_id, nearest, cosine, cosine < 0.85 kept from s qualify row_number() over (partition by vec_id order by cosine desc, nearest) = 1""")
def decontaminate_cosine_all(spark, sf):
    """Every vector against the protected ones, vec_id % 50 = 0."""
    e = table(spark, sf, "embeddings")
    best = corpus.nearest_of_protected(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return best.withColumn("kept", F.coalesce(F.col("cosine") < 0.85, F.lit(True)))


@query()
def greedy_neardup(spark, sf):
    return corpus.greedy_near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query("""with d as (select doc_id, sha1(coalesce(source, '')) h from documents)
select doc_id, list_reduce(list_transform(string_split(regexp_replace(h, '(.)', '\\1 ', 'g').trim(), ' '), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 100)::int bucket from d""")
def hash_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hash_bucket(F.coalesce("source", F.lit(""))).alias("bucket"))


@query("select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type from events group by 1 having arg_max(event_type, (ts, event_id)) = 'purchase'")
def last_wins_filter(spark, sf):
    return corpus.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).filter("event_type = 'purchase'").select("user_id", "event_id", "event_type")


@query("""with u as (select doc_id, 'labelled' origin, 0 p from labels union all select doc_id, 'raw', 1 from documents)
select doc_id, origin from u qualify p = min(p) over (partition by doc_id)""")
def priority_merge(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("origin"))
    b = table(spark, sf, "documents").select("doc_id", F.lit("raw").alias("origin"))
    return corpus.first_source_wins([a, b], "doc_id").select("doc_id", "origin")


@query("""with t as (select *, count(*) over w n_context, coalesce(sum(len(text)) over w, 0)::bigint context_chars from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))
select conv_id, turn, n_context, context_chars, case when list_reduce(list_transform(string_split(regexp_replace(sha1(conv_id::varchar), '(.)', '\\1 ', 'g').trim(), ' '), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 100) < 4 then 'val' else 'train' end split
from t where role = 'assistant' and n_context > 0 and len(text) + context_chars <= 2000""")
def trajectory_samples(spark, sf):
    return corpus.trajectories(table(spark, sf, "conversations"), 2000)


_UNSAFE = " or ".join(f"regexp_matches(text, '{p}')" for p in [*(p for p, _ in _SQL_RULES), *("(?i)" + p for p in [safety.INSTRUCTION, *safety.HIGH_RISK.values()])])
_TOKENS = f"case when coalesce(text, '') = '' then 0 else greatest(1, len(regexp_replace(text, '[^{CJK[1:-1]}]', '', 'g')) + ceil(octet_length(encode(regexp_replace(text, '{CJK}', '', 'g'))) / 4.0)) end::bigint"


@query(f"""with s as (select *, {_TOKENS} tokens from conversations where conv_id not in (select conv_id from conversations where {_UNSAFE})),
t as (select *, count(*) over w n_context, coalesce(sum(tokens) over w, 0)::bigint context_tokens from s window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))
select conv_id, turn, n_context, context_tokens, case when list_reduce(list_transform(string_split(regexp_replace(sha1(conv_id::varchar), '(.)', '\\1 ', 'g').trim(), ' '), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 100) < 4 then 'val' else 'train' end split
from t where role = 'assistant' and text is not null and n_context > 0 and tokens + context_tokens <= 12288""")
def trajectory_samples_safe(spark, sf):
    return corpus.safe_trajectories(table(spark, sf, "conversations"))


@query("""with e as (select vec_id, embedding::double[] e from embeddings), v as (select a.vec_id, list_transform(list_zip(b.e, a.e), lambda x: x[1] + 0.27::double * x[2]) e from e a join e b on b.vec_id = a.vec_id - a.vec_id % 5),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) l, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') k, ('0x' || substr(sha1(vec_id::varchar), 1, 15))::bigint h from v left join documents on doc_id = vec_id),
p as (select * from n where vec_id % 50 = 0), r as (select * from n where vec_id % 50 <> 0),
x as (select vec_id from r where k in (select k from p where k is not null)),
c as (select distinct r.vec_id from r, p where round(list_dot_product(r.e, p.e) / (r.l * p.l), 6) >= 0.85 and r.vec_id not in (from x)),
f as (select * from r where vec_id not in (from x) and vec_id not in (from c)),
l as (select b.vec_id, any_value(b.h) h, list(a.vec_id) early from f a join f b on (a.h, a.vec_id) < (b.h, b.vec_id) and list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.93 group by 1),
o as (select list_reduce(list_prepend({'i': -1::bigint, 'early': []::bigint[], 'gone': []::bigint[]}, coalesce(list({'i': vec_id, 'early': early, 'gone': []::bigint[]} order by h, vec_id), [])),
  lambda s, y: {'i': y.i, 'early': y.early, 'gone': case when len(list_filter(y.early, lambda z: not list_contains(s.gone, z))) > 0 then list_append(s.gone, y.i) else s.gone end}).gone gone from l)
select vec_id, case when vec_id in (from x) then 'exact_eval' when vec_id in (from c) then 'near_eval' when list_contains((select gone from o), vec_id) then 'near_duplicate' else 'kept' end verdict from r""")
def decontaminate_chain(spark, sf):
    """Texts and vectors of all documents against those of ids divisible by 50; a vector leans on that of the first of its five."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    lean = F.zip_with("b", "e", lambda b, a: b + F.lit(0.27) * a)
    v = e.withColumn("first", F.col("vec_id") - F.col("vec_id") % 5).join(e.select(F.col("vec_id").alias("first"), F.col("e").alias("b")), "first").select("vec_id", lean.alias("embedding"))
    v = v.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    order = F.conv(F.substring(F.sha1(F.col("vec_id").cast("string")), 1, 15), 16, 10).cast("long")
    return corpus.decontaminated(v.filter("vec_id % 50 <> 0"), v.filter("vec_id % 50 = 0"), order=order)
