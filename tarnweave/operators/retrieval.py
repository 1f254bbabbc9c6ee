"""Whole retrievals over batches of queries: one wording, several wordings, and down to parents.

topics: doc_id, text (what is searched), title, aliases, tags. A query carries ``wanted``: tags such
as ``domain:git`` that a topic must have. Vectors are columns that come from outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.scores import confidence
from tarnweave.functions.text import exact_name, exact_names, tokenize
from tarnweave.operators import search
from tarnweave.sources.tables import written


@dataclass(frozen=True)
class Searcher:
    """A term index of topics, with their vectors (vec_id, embedding) if there are any."""

    index: DataFrame
    vectors: DataFrame | None = None
    candidates: int = 20

    @classmethod
    def build(cls, topics: DataFrame, vectors: DataFrame | None = None, candidates: int = 20) -> Searcher:
        names = exact_names(F.array_compact(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))))
        tags = F.coalesce("tags", F.array().cast("array<string>"))
        rows = topics.select("doc_id", "text", names.alias("names"), tags.alias("tags"))
        return cls(search.term_index(rows, ("names", "tags")), vectors, candidates)


def _details(s: Searcher, pairs: DataFrame, terms: DataFrame, queries: DataFrame, n: int, avgdl: float) -> DataFrame:
    """pairs (query_id, doc_id) plus bm25 with its bonus, n_ascii (shared ASCII tokens) and n_shared."""
    asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("token", "qtf", "idf")).alias("asked"), F.count("*").alias("n_asked"))
    q = queries.select("query_id", exact_name(F.col("text")).alias("q")).join(asked, "query_id", "left")
    k1, b = search.K1, search.B
    both = pairs.join(F.broadcast(q), "query_id").join(s.index, "doc_id")
    tf = F.map_from_arrays("terms", "tfs")
    weigh = lambda t, f: t["qtf"] * t["idf"] * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    shared = F.filter(F.transform("asked", lambda t: F.struct(t["token"].alias("token"), weigh(t, F.try_element_at(tf, t["token"])).alias("w"))), lambda x: x["w"].isNotNull())
    both = both.withColumn("shared", F.coalesce(shared, F.array().cast("array<struct<token:string,w:double>>")))
    n_shared = F.size("shared")
    weak = 4.0 * n_shared / F.greatest("n_asked", F.lit(1)) if n <= 4 else F.lit(0.0)
    bonus = F.when(F.array_contains("names", F.col("q")), 25.0).when((F.col("q") != "") & F.exists("names", lambda x: F.contains(x, F.col("q"))), 8.0).otherwise(weak)
    return both.select(
        "query_id", "doc_id", F.round(F.aggregate("shared", F.lit(0.0), lambda a, x: a + x["w"]) + bonus, 6).alias("bm25"),
        F.size(F.filter("shared", lambda x: x["token"].rlike(search.ASCII_TOKEN))).alias("n_ascii"), n_shared.alias("n_shared"),
    )


def retrieve(s: Searcher, queries: DataFrame, k: int = 4) -> DataFrame:
    """queries (query_id, text, wanted, embedding) -> query_id, doc_id, score, bm25, cosine, rank.

    The best candidates by BM25 with its bonus and by cosine are fused; topics that share ASCII words
    with the query come first. A query whose best BM25 is not positive and whose best cosine is
    under .42 has no hits, unless a corpus of four topics shares a word with it.
    """
    terms, n, avgdl = search.query_terms(s.index, queries)
    terms = written(terms, "asked")
    lists = [(search.lexical(s.index, terms, n, avgdl, s.candidates, queries), 1.0)]
    if s.vectors is not None:
        asked = queries.filter("embedding is not null")
        vectors = s.vectors.join(s.index.select(F.col("doc_id").alias("vec_id"), "tags"), "vec_id")
        near = search.dense(asked, vectors, s.candidates, wanted=True).withColumnRenamed("vec_id", "doc_id")
        lists.append((near, 1.0))
    lists = [(written(d, "list"), w) for d, w in lists]
    fused = search.rrf(lists)
    hits = fused.join(_details(s, fused.select("query_id", "doc_id"), terms, queries, n, avgdl), ["query_id", "doc_id"])
    top = lists[0][0].filter("rank = 1").select("query_id", F.col("score").alias("best_bm25"))
    if s.vectors is not None:
        q, v = queries.select("query_id", F.col("embedding").alias("eq")), s.vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("ev"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
        hits = hits.join(F.broadcast(q), "query_id", "left").join(v, "doc_id", "left")
        hits = hits.withColumn("cosine", F.coalesce(F.round(F.try_divide(dot("eq", "ev"), F.sqrt(dot("eq", "eq") * dot("ev", "ev"))), 6), F.lit(0.0))).drop("eq", "ev")
        best = lists[1][0].groupBy("query_id").agg(F.max("score").alias("best_cosine"))
    else:
        hits, best = hits.withColumn("cosine", F.lit(0.0)), queries.select("query_id", F.lit(0.0).alias("best_cosine"))
    hits = hits.join(top, "query_id", "left").join(best, "query_id", "left")
    enough = (F.coalesce("best_bm25", F.lit(0.0)) > 0) | (F.coalesce("best_cosine", F.lit(0.0)) >= 0.42)
    if n <= 4:
        enough |= F.col("n_shared") > 0
    order = [F.col("n_ascii").desc(), F.col("score").desc(), F.col("bm25").desc(), "doc_id"]
    return search.top_k(hits.filter(enough).select("query_id", "doc_id", "score", "bm25", "cosine", "n_ascii"), "query_id", order, k).drop("n_ascii")


def rerank(hits: DataFrame, queries: DataFrame, topics: DataFrame, k: int, scored: str | None = None) -> DataFrame:
    """hits (query_id, doc_id, score, bm25, cosine) by a model's score if column ``scored`` has one for all hits of a query,
    else by score, bm25, cosine, equal name, shared name tokens and id, all descending."""
    names = exact_names(F.array_compact(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))))
    words = tokenize(F.concat_ws(" ", F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    t = topics.select("doc_id", names.alias("__names"), F.array_distinct(words).alias("__words"))
    q = queries.select("query_id", exact_name(F.col("text")).alias("__q"), F.array_distinct(tokenize(F.col("text"))).alias("__asked"))
    h = hits.join(F.broadcast(q), "query_id").join(t, "doc_id")
    h = h.withColumns({
        "__exact": F.array_contains("__names", F.col("__q")).cast("int"),
        "__overlap": F.size(F.array_intersect("__asked", "__words")) / F.greatest(F.size("__asked"), F.lit(1)),
    })
    plain = [F.col(c).desc() for c in ("score", "bm25", "cosine", "__exact", "__overlap", "doc_id")]
    if scored is None:
        return search.top_k(h, "query_id", plain, k).drop("__names", "__words", "__q", "__asked", "__exact", "__overlap")
    whole = h.groupBy("query_id").agg((F.count(scored) == F.count("*")).alias("__whole"))
    h = h.join(whole, "query_id").withColumn("__model", F.when(F.col("__whole"), F.col(scored)))
    model = [F.col("__model").desc(), F.col("score").desc(), F.col("bm25").desc()]
    rest = [F.when(~F.col("__whole"), F.col(c)).desc() for c in ("cosine", "__exact", "__overlap")]
    return search.top_k(h, "query_id", [*model, *rest, F.col("doc_id").desc()], k).drop("__names", "__words", "__q", "__asked", "__exact", "__overlap", "__whole", "__model")


def retrieve_variants(s: Searcher, queries: DataFrame, topics: DataFrame, k: int = 4) -> DataFrame:
    """queries (query_id, variant, text, wanted, embedding), variant 0 the user's own wording -> hits of all wordings fused.

    A query with one wording keeps its own order; others are searched deeper, fused with weight 1 for
    variant 0 and .7 for the rest, and ranked again.
    """
    key = F.col("query_id") * 16 + F.col("variant")
    each = retrieve(s, queries.withColumn("query_id", key), max(2 * k, s.candidates))
    each = written(each.withColumns({"variant": F.pmod("query_id", F.lit(16)), "query_id": F.shiftright("query_id", 4)}), "variants")
    many = queries.groupBy("query_id").agg((F.count("*") > 1).alias("many"))
    each = each.join(F.broadcast(many), "query_id")
    alone = each.filter(~F.col("many") & (F.col("rank") <= k)).select("query_id", "doc_id", "score", "bm25", "cosine", "rank")
    weight = F.when(F.col("variant") == 0, 1.0).otherwise(0.7)
    fused = each.filter("many").groupBy("query_id", "doc_id").agg(
        F.round(F.sum(weight / (search.RRF + F.col("rank"))), 6).alias("score"), F.min_by("bm25", "variant").alias("bm25"), F.min_by("cosine", "variant").alias("cosine")
    )
    return alone.unionByName(rerank(fused, queries.filter("variant = 0"), topics, k).select(*alone.columns))


def retrieve_parents(s: Searcher, queries: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """chunks (doc_id, parent_id, document_id): the best max(20, k) chunks collapsed to parents, two of a document at most."""
    hits = retrieve(s, queries, max(20, k)).join(chunks.select("doc_id", "parent_id", "document_id"), "doc_id")
    return search.collapse_parents(hits.withColumnRenamed("doc_id", "chunk_id"), k)


def retrieval_confidence(hits: DataFrame, least: float = 0.05) -> DataFrame:
    """query_id, confidence and whether it is enough to answer from these hits."""
    best = hits.groupBy("query_id").agg(F.max("bm25").alias("b"), F.max("cosine").alias("c"))
    sure = best.select("query_id", confidence(F.col("b"), F.col("c")).alias("confidence"))
    return sure.withColumn("sufficient", F.col("confidence") >= least)


def index_status(s: Searcher) -> DataFrame:
    """One row: topics, tokens, distinct tags, topics with a vector, and the mode of search."""
    tags = s.index.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("n_tags"))
    out = s.index.agg(F.count("*").alias("n_topics"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")).join(F.broadcast(tags))
    n = 0 if s.vectors is None else s.vectors.join(s.index, s.vectors["vec_id"] == s.index["doc_id"], "left_semi").count()
    return out.withColumns({"n_vectors": F.lit(n).cast("long"), "mode": F.lit("hybrid" if n else "lexical")})
