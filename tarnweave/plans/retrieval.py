"""Whole retrievals: documents as topics, benchmark passages and source names as queries, embeddings as both sides' vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnweave.operators import retrieval, search
from tarnweave.sources.tables import table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TOKEN = "[a-zA-Z0-9_+.#:/-]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _topics(spark, sf):
    d = table(spark, sf, "documents")
    words = F.split(F.coalesce("text", F.lit("")), "[ \\n]+")
    return d.select(
        "doc_id", "text", F.concat_ws(" ", F.slice(words, 1, 2)).alias("title"), F.array("source").alias("aliases"),
        F.array(F.concat(F.lit("lang:"), "lang")).alias("tags"), F.floor(F.col("doc_id") / 4).cast("long").alias("parent_id"), (F.col("doc_id") % 97).alias("document_id"),
    )


def _asked(spark, sf, variants: bool = False):
    """A query for each passage; every fourth asks for a source by name, every third wants English, every fifth has no vector."""
    i = F.col("item_id")
    b = table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.when(i % 4 == 0, F.concat(F.lit("src"), (i % 20).cast("string"))).otherwise(F.col("text")).alias("text"),
        F.when(i % 3 == 0, F.array(F.lit("lang:en"))).otherwise(F.array().cast("array<string>")).alias("wanted"),
    )
    v = table(spark, sf, "embeddings").filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("query_id"), "embedding")
    b = b.join(v, "query_id", "left")
    if not variants:
        return b
    short = b.filter("query_id % 2 = 1").withColumns({"variant": F.lit(1), "text": F.concat_ws(" ", F.slice(F.split("text", " "), 1, 8))})
    return b.withColumn("variant", F.lit(0)).unionByName(short)


def _searcher(spark, sf):
    return retrieval.Searcher.build(_topics(spark, sf), table(spark, sf, "embeddings").select("vec_id", "embedding"))


_Q = """q0 as (select item_id query_id, case when item_id % 4 = 0 then 'src' || (item_id % 20)::varchar else text end text, item_id % 3 = 0 en, case when item_id % 5 <> 0 then (select any_value(embedding) from embeddings where vec_id = item_id) end e from benchmark)"""
_V = _Q + """, q as (select query_id * 16 query_id, text, en, e from q0 union all select query_id * 16 + 1, array_to_string(string_split(text, ' ')[1:8], ' '), en, e from q0 where query_id % 2 = 1)"""


def hits_sql(asked: str, k: int) -> str:
    """CTEs that end in h: the hits of the queries in q."""
    return f"""with {asked},
t as (select doc_id, coalesce(text, '') text, lower(replace(array_to_string(string_split_regex(coalesce(text, ''), '[ \\n]+')[1:2], ' '), ' ', '')) title, source alias, lang from documents),
tok as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) token from t),
tf as (select doc_id, token, count(*) tf from tok group by 1, 2),
dl as (select doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) dl from t),
st as (select count(*)::double n, avg(dl) avgdl from dl),
i0 as (select token, ln(st.n - count(*) + 0.5) - ln(count(*) + 0.5) idf from tf, st group by token, st.n),
i as (select token, case when idf < 0 then 0.25 * (select avg(idf) from i0) else idf end idf from i0),
qt as (select query_id, token, count(*) qtf from (select query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) token from q) group by 1, 2),
ok as (select q.query_id, t.doc_id, case when qn in (title, alias) then 25 when contains(title, qn) or contains(alias, qn) then 8 else 0 end bonus
       from (select *, lower(regexp_replace(text, '\\s+', '', 'g')) qn from q) q join t on not en or lang = 'en'),
s as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) s, count(*) filter (where regexp_full_match(token, '[a-z0-9][a-z0-9._-]*')) n_ascii
      from qt join i using (token) join tf using (token) join dl using (doc_id), st group by 1, 2),
d as (select query_id, doc_id, round(coalesce(s, 0) + bonus, 6) bm25, coalesce(n_ascii, 0) n_ascii, s is not null or bonus > 0 lexical from ok left join s using (query_id, doc_id)),
l as (select query_id, doc_id, bm25 score, row_number() over (partition by query_id order by bm25 desc, doc_id) rank from d where lexical qualify rank <= 20),
c as (select q.query_id, v.vec_id doc_id, round(list_dot_product(q.e::double[], v.embedding::double[]) / sqrt(list_dot_product(q.e::double[], q.e::double[]) * list_dot_product(v.embedding::double[], v.embedding::double[])), 6) score
      from q join embeddings v on q.e is not null join ok on ok.query_id = q.query_id and ok.doc_id = v.vec_id),
n as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from c qualify rank <= 20),
f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) score from (from l union all from n) group by 1, 2),
g as (select query_id from q left join (select query_id, score b from l where rank = 1) using (query_id) left join (select query_id, max(score) c from n group by 1) using (query_id) where coalesce(b, 0) > 0 or coalesce(c, 0) >= 0.42),
h as (select query_id, doc_id, f.score, d.bm25, coalesce(c.score, 0.0)::double cosine, row_number() over (partition by query_id order by n_ascii desc, f.score desc, bm25 desc, doc_id)::bigint rank
      from f join d using (query_id, doc_id) left join c using (query_id, doc_id) where query_id in (select query_id from g) qualify rank <= {k})"""


_PLAIN = _Q + ", q as (from q0)"


@query(hits_sql(_PLAIN, 4) + " from h")
def retrieve_single(spark, sf):
    return retrieval.retrieve(_searcher(spark, sf), _asked(spark, sf), 4)


@query(hits_sql(_V, 20) + """, e as (select query_id // 16 query_id, query_id % 16 variant, doc_id, score, bm25, cosine, rank, count(distinct query_id % 16) over (partition by query_id // 16) many from h),
w as (select query_id, doc_id, round(sum(case when variant = 0 then 1.0::double else 0.7::double end / (60 + rank)), 6) score, arg_min(bm25, variant) bm25, arg_min(cosine, variant) cosine from e where query_id % 2 = 1 group by 1, 2),
nt as (select doc_id, list_distinct(regexp_extract_all(lower(array_to_string(string_split_regex(text, '[ \n]+')[1:2], ' ') || ' ' || alias), '""" + TOKEN + """')) words, title, alias from t),
qd as (select query_id, lower(regexp_replace(text, '\\s+', '', 'g')) qn, list_distinct(regexp_extract_all(lower(text), '""" + TOKEN + """')) asked from q0),
r as (select query_id, doc_id, score, bm25, cosine, row_number() over (partition by query_id order by score desc, bm25 desc, cosine desc, (qn in (title, alias))::int desc, len(list_intersect(asked, words)) / greatest(len(asked), 1) desc, doc_id desc)::bigint rank
      from w join nt using (doc_id) join qd using (query_id) qualify rank <= 4)
from r union all select query_id, doc_id, score, bm25, cosine, rank from e where query_id % 2 = 0 and rank <= 4""")
def retrieve_variants(spark, sf):
    return retrieval.retrieve_variants(_searcher(spark, sf), _asked(spark, sf, True), _topics(spark, sf), 4)


@query(hits_sql(_PLAIN, 20) + """, u as (select query_id, (doc_id // 4)::varchar unit, min(rank)::bigint as "position", round(max(score) + least(count(*) - 1, 3) * 0.000001, 6) score, min(doc_id % 97) document_id, count(*)::bigint n_children from h group by 1, 2),
v as (select *, row_number() over (partition by query_id, document_id order by "position", unit) turn from u)
select query_id, unit, "position", score, document_id, n_children, row_number() over (partition by query_id order by "position", unit)::bigint rank from v where turn <= 2 qualify rank <= 4""")
def retrieve_managed(spark, sf):
    return retrieval.retrieve_parents(_searcher(spark, sf), _asked(spark, sf), _topics(spark, sf), 4)


@query(hits_sql(_PLAIN, 4) + """, sure as (select query_id, round(greatest(1 - exp(-greatest(max(bm25), 0) / 4), least(1.0, greatest(0.0, (greatest(max(cosine), 0) - 0.42) / 0.58))), 6) confidence from h group by 1)
select *, confidence >= 0.05 sufficient from sure""")
def confidence_gate(spark, sf):
    return retrieval.retrieval_confidence(retrieval.retrieve(_searcher(spark, sf), _asked(spark, sf), 4))


@query(f"""select count(*)::bigint n_topics, sum(len(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')))::bigint n_tokens, count(distinct lang)::bigint n_tags,
(select count(*) from embeddings where vec_id in (select doc_id from documents))::bigint n_vectors, 'hybrid' as mode from documents""")
def index_status(spark, sf):
    return retrieval.index_status(_searcher(spark, sf))


@query(hits_sql(_PLAIN, 20) + """, m as (select * exclude (rank), case when query_id % 2 = 0 then (doc_id * 7919 % 101)::double / 100 end model from h),
nt as (select doc_id, list_distinct(regexp_extract_all(lower(array_to_string(string_split_regex(text, '[ \n]+')[1:2], ' ') || ' ' || alias), '""" + TOKEN + """')) words, title, alias from t),
qd as (select query_id, lower(regexp_replace(text, '\\s+', '', 'g')) qn, list_distinct(regexp_extract_all(lower(text), '""" + TOKEN + """')) asked from q0)
select query_id, doc_id, row_number() over (partition by query_id order by model desc nulls last, score desc, bm25 desc, case when model is null then cosine end desc nulls last, case when model is null then (qn in (title, alias))::int end desc nulls last,
  case when model is null then len(list_intersect(asked, words)) / greatest(len(asked), 1) end desc nulls last, doc_id desc)::bigint rank from m join nt using (doc_id) join qd using (query_id) qualify rank <= 5""")
def rerank_with_model(spark, sf):
    """Even queries have a score of a model for every hit, odd ones for none: they fall back."""
    hits = written(retrieval.retrieve(_searcher(spark, sf), _asked(spark, sf), 20).drop("rank"), "hits")
    hits = hits.withColumn("model", F.when(F.col("query_id") % 2 == 0, (F.col("doc_id") * 7919 % 101) / 100.0))
    return retrieval.rerank(hits, _asked(spark, sf), _topics(spark, sf), 5, "model").select("query_id", "doc_id", "rank")


@query("""select doc_id, query_id, r from (select e.vec_id query_id, d.doc_id, d.lang, row_number() over (partition by e.vec_id order by d.doc_id) r from embeddings e join documents d on d.doc_id % 500 = e.vec_id where e.vec_id % 50 = 0) where r <= 3""")
def hits_with_topics(spark, sf):
    """Hits joined to their topics: ids were ranked, texts come last."""
    hits = table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 500).alias("query_id"))
    return search.top_k(hits.join(d, "query_id"), "query_id", ["doc_id"], 3).select("doc_id", "query_id", F.col("rank").alias("r"))


@query("""select user_id query_id, event_id % 20 doc_id, string_agg(distinct (event_id % 3)::varchar, ',' order by (event_id % 3)::varchar) chunks from events group by 1, 2""")
def matched_union(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 20).alias("doc_id"), F.array((F.col("event_id") % 3).cast("string")).alias("chunks"), "event_id")
    out = search.matched_union([e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")])
    return out.withColumn("chunks", F.array_join("chunks", ","))
