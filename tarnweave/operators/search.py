"""Lexical and dense ranking, fusion, collapse and citations over batches of queries."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.functions.scores import citation_id
from tarnweave.functions.text import exact_name, tokenize
from tarnweave.sources.tables import written

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60


def top_k(scored: DataFrame, query: str, order: list, k: int) -> DataFrame:
    """``scored`` with rank from 1, at most k for each query."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


#: Documents scored at once in a task, documents sent to Python at once, and vectors compared at once: a task's memory doesn't grow with its rows.
CHUNK, BATCH, VECTORS = 128, 512, 256
ASCII_TOKEN = r"^[a-z0-9][a-z0-9._-]*$"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH):
    """What is run in here sends at most so many rows to Python at once, as rows with whole texts are long; the setting before comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _best(k: int, best: list, now: list, floor: np.ndarray) -> list:
    """The first k of each query of two lists (query, id, score); ``floor`` gets the score that a further one needs."""
    q, d, s = (np.concatenate(x) for x in zip(best, now, strict=True))
    order = np.lexsort((d, -np.round(s, 6), q))
    q, d, s = q[order], d[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(floor)))[q]
    floor[q[place == k - 1]] = np.round(s[place == k - 1], 6)
    keep = place < k
    return [q[keep], d[keep], s[keep]]


def term_index(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, dl, terms, tfs and the columns ``carry``: a document's distinct tokens with their counts.

    One pass over the texts without a shuffle, written out; everything lexical works on it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        for b in batches:
            n = b["tokens"].value_lengths().to_numpy(zero_copy_only=False)
            words = b["tokens"].flatten().dictionary_encode()
            size = max(1, len(words.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, term = np.divmod(key, size)
            at = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            terms, tfs = pa.ListArray.from_arrays(at, words.dictionary.take(pa.array(term))), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), terms, tfs, *[b[c] for c in carry]], ["doc_id", "dl", "terms", "tfs", *carry])

    tokens = docs.select("doc_id", tokenize(F.col("text")).alias("tokens"), *carry)
    with small_batches(docs.sparkSession):
        return written(tokens.mapInArrow(run, f"doc_id {kind}, dl long, terms array<string>, tfs array<long>{extra}"), "terms")


def query_terms(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, int, float]:
    """(query_id, token, qtf, idf) of queries (query_id, text) against all documents, their number and mean length.

    A token that most documents have counts a quarter of the mean idf.
    """
    n, avgdl = index.agg(F.count("*"), F.avg("dl")).first()
    df = index.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = written(df.withColumn("idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    idf = idf.select("token", F.when(F.col("idf") < 0, F.lit(EPSILON * mean)).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    return asked.join(idf, "token", "left").select("query_id", "token", "qtf", F.coalesce("idf", F.lit(0.0)).alias("idf")), n, avgdl or 1.0


def _bonus(query: str, names: pa.ListArray, rows: int) -> np.ndarray:
    """25 for the documents one of whose names is the query, else 8 where a name holds it."""
    out = np.zeros(rows)
    if query and len(names.values):
        flat = names.flatten()
        row = np.repeat(np.arange(rows), names.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out[row[pc.match_substring(flat, query).fill_null(False).to_numpy(zero_copy_only=False)]] = 8.0
        out[row[pc.equal(flat, query).fill_null(False).to_numpy(zero_copy_only=False)]] = 25.0
    return out


def lexical(index: DataFrame, terms: DataFrame, n: int, avgdl: float, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the best k of ``index`` by BM25 for the queries of ``terms`` (of query_terms).

    The query terms are a stated set and go to all tasks; a document is scored where it lies against all
    queries as a matrix, and a task hands on k rows for each query. Documents without a
    shared token are not ranked. With ``queries`` (query_id, text, wanted) and columns names
    and tags in the index, names add their bonus and documents without all wanted tags are out;
    in a corpus of at most four documents the share of shared tokens adds up to 4.
    """
    spark, small = index.sparkSession, n <= 4
    rows = terms.collect()  # bounded by the query set
    texts = {} if queries is None else {r["query_id"]: (r["q"], r["wanted"] or []) for r in queries.select("query_id", exact_name(F.col("text")).alias("q"), "wanted").collect()}
    ids = sorted({r["query_id"] for r in rows} | set(texts))
    vocabulary, tags = sorted({r["token"] for r in rows}), sorted({t for _, w in texts.values() for t in w})
    q_at, t_at = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(vocabulary)}
    weight, asked, wanted = np.zeros((len(ids), len(vocabulary))), np.zeros((len(ids), len(vocabulary))), np.zeros((len(ids), len(tags)))
    for r in rows:
        weight[q_at[r["query_id"]], t_at[r["token"]]], asked[q_at[r["query_id"]], t_at[r["token"]]] = r["qtf"] * r["idf"], 1
    for q, (_, want) in texts.items():
        wanted[q_at[q], [tags.index(t) for t in want]] = 1
    shared = spark.sparkContext.broadcast((np.array(ids), vocabulary, weight, asked, [texts[q][0] for q in ids if q in texts], tags, wanted))
    named = queries is not None

    def counted(lists: pa.ListArray, among: pa.Array, size: int, values: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((size, len(lists)))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = pc.index_in(lists.flatten(), value_set=among).to_numpy(zero_copy_only=False)
        hit = ~np.isnan(at)
        out[at[hit].astype(np.int64), row[hit]] = 1 if values is None else values[hit]
        return out

    def run(batches):
        ids, vocabulary, weight, asked, names, tags, wanted = shared.value
        words, marks = pa.array(vocabulary, pa.string()), pa.array(tags, pa.string())
        best, floor = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.full(len(ids), -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                tf = counted(b["terms"], words, len(vocabulary), b["tfs"].flatten().to_numpy(zero_copy_only=False))
                dl = b["dl"].to_numpy(zero_copy_only=False)
                score = weight @ (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))
                common = asked @ (tf > 0)
                fits = common > 0
                if named:
                    bonus = np.stack([_bonus(q, b["names"], b.num_rows) for q in names]) if names else np.zeros_like(score)
                    if small:
                        bonus = np.where(bonus > 0, bonus, 4.0 * common / np.maximum(asked.sum(axis=1, keepdims=True), 1))
                    score, fits = score + bonus, (fits | (bonus > 0))
                    if len(tags):
                        fits &= wanted @ counted(b["tags"], marks, len(tags)) == wanted.sum(axis=1, keepdims=True)
                q, d = np.nonzero(fits & (np.round(score, 6) >= floor[:, None]))
                if len(q):
                    best = _best(k, best, [q, b["doc_id"].to_numpy(zero_copy_only=False)[d], score[q, d]], floor)
        yield pa.record_batch([pa.array(ids[best[0]], pa.int64()) if len(ids) else pa.array([], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], ["query_id", "doc_id", "score"])

    cols = ["doc_id", "dl", "terms", "tfs", *(["names", "tags"] if named else [])]
    with small_batches(spark):
        found = written(index.select(*cols).mapInArrow(run, "query_id long, doc_id long, score double"), "found").withColumn("score", F.round("score", 6))
    return top_k(found, "query_id", [F.col("score").desc(), "doc_id"], k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text), queries (query_id, text) -> query_id, doc_id, score, rank.

    Frequencies and lengths are of all documents; ``allowed`` (doc_id) filters only what is
    ranked. Query tokens count as often as they occur. Only ids and scores are ranked; join
    texts afterwards.
    """
    index = term_index(docs)
    terms, n, avgdl = query_terms(index, queries)
    if allowed is not None:
        index = index.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    return lexical(index, terms, n, avgdl, k)


def dense(queries: DataFrame, corpus: DataFrame, k: int = 10, block: int = 2048, wanted: bool = False) -> DataFrame:
    """queries (query_id, embedding), corpus (vec_id, embedding) -> query_id, vec_id, score, rank by cosine.

    With ``wanted`` a query names tags in that column, and only vectors with all of them in ``tags`` are ranked.

    The queries are a stated set and go out in blocks of bounded size; each task keeps its best
    k for each query as it goes through its vectors, so the last step ranks k rows for each query and task.
    """
    spark, out, rows = queries.sparkSession, None, queries.select("query_id", "embedding", *(["wanted"] if wanted else [])).toLocalIterator()
    while part := [r for _, r in zip(range(block), rows, strict=False)]:
        q = np.array([r["embedding"] for r in part], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        need: dict[frozenset, list[int]] = {}
        for i, r in enumerate(part):
            if wanted and r["wanted"]:
                need.setdefault(frozenset(r["wanted"]), []).append(i)
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in part]), q, need))

        def run(batches, shared=shared):
            ids, q, need = shared.value
            best, floor = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.full(len(ids), -1.5)
            for whole in batches:
                for at in range(0, whole.num_rows, VECTORS):
                    b = whole.slice(at, VECTORS)
                    c = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
                    s = np.round(q @ c.T, 6)
                    has = [set(t or ()) for t in b["tags"].to_pylist()] if need else []
                    for tags, rows in need.items():
                        s[np.ix_(rows, [i for i, t in enumerate(has) if not tags <= t])] = -2.0
                    i, j = np.nonzero(s >= floor[:, None])
                    if len(i):
                        best = _best(k, best, [i, b["vec_id"].to_numpy(zero_copy_only=False)[j], s[i, j]], floor)
            yield pa.record_batch([pa.array(ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], ["query_id", "vec_id", "score"])

        found = corpus.select("vec_id", "embedding", *(["tags"] if wanted else [])).mapInArrow(run, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    return top_k(out, "query_id", [F.col("score").desc(), "vec_id"], k)


def rrf(lists: list[tuple[DataFrame, float]], constant: int = RRF) -> DataFrame:
    """Ranked lists (query_id, doc_id, rank) with weights -> query_id, doc_id, score: sum of weight / (constant + rank)."""
    parts = [d.select("query_id", "doc_id", (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("s")) for d, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def contextual_merge(raw: DataFrame, contextual: DataFrame, k: int) -> DataFrame:
    """Raw list at .35, contextual one at 1; the contextual top hit gets 1/61 on top."""
    anchor = contextual.filter("rank = 1").withColumn("rank", F.lit(1))
    return top_k(rrf([(raw, 0.35), (contextual, 1.0), (anchor, 1.0)]), "query_id", [F.col("score").desc(), "doc_id"], k)


def collapse_parents(hits: DataFrame, k: int, per_document: int = 2) -> DataFrame:
    """hits (query_id, rank, chunk_id, parent_id, document_id, score) -> a row for each parent in list order.

    A parent stands where its best-placed child stood, with its best child's score plus a
    millionth for each further child up to three; a document fills ``per_document`` places at most.
    """
    unit = F.coalesce(F.col("parent_id").cast("string"), F.concat(F.lit("single:"), F.col("chunk_id").cast("string")))
    grouped = hits.groupBy("query_id", unit.alias("unit")).agg(
        F.min("rank").alias("position"), F.round(F.max("score") + F.least(F.count("*") - 1, F.lit(3)) * 0.000001, 6).alias("score"),
        F.min("document_id").alias("document_id"), F.count("*").alias("n_children"),
    )
    turn = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("position", "unit"))
    kept = grouped.withColumn("turn", turn).filter(F.col("document_id").isNull() | (F.col("turn") <= per_document)).drop("turn")
    return top_k(kept, "query_id", ["position", "unit"], k)


def no_hit_gate(hits: DataFrame, least_cosine: float = 0.42) -> DataFrame:
    """Hits of the queries whose best BM25 is positive or whose best cosine reaches the bound."""
    best = hits.groupBy("query_id").agg(F.max("bm25").alias("b"), F.max("cosine").alias("c"))
    return hits.join(best.filter((F.col("b") > 0) | (F.col("c") >= least_cosine)), "query_id", "left_semi")


def evidence(hits: DataFrame) -> DataFrame:
    """One record for each citation id: the best placed one. hits: query_id, rank, source_id, chunk_id, text."""
    c = hits.withColumn("citation_id", citation_id(F.col("source_id").cast("string"), F.col("chunk_id").cast("string")))
    first = F.row_number().over(W.partitionBy("query_id", "citation_id").orderBy("rank"))
    return c.withColumn("n", first).filter("n = 1").select("query_id", "rank", "citation_id", F.substring("text", 1, 360).alias("excerpt"))


def metadata_filter(topics: DataFrame, domain: str | None = None, platform: str | None = None, shell: str | None = None) -> DataFrame:
    """topics with an array ``commands`` of (platforms, shell, language); a topic without the platform never matches."""
    cond = F.lit(True)
    if domain:
        cond &= F.col("domain") == domain
    if platform:
        cond &= F.exists("commands", lambda c: F.array_contains(c["platforms"], platform))
    if shell:
        name = lambda c: F.coalesce(c["shell"], F.when(c["language"] == "bash", "posix").otherwise(c["language"]))
        cond &= F.exists("commands", lambda c: name(c) == shell)
    return topics.filter(cond)


def lexical_first(hits: DataFrame, ascii_overlap: str, fused: str, bm25: str, k: int, key: str = "doc_id") -> DataFrame:
    """Hits that share ASCII words with the query first, then by how many, fused score, BM25 and id."""
    order = [(F.col(ascii_overlap) > 0).cast("int").desc(), F.col(ascii_overlap).desc(), F.col(fused).desc(), F.col(bm25).desc(), key]
    return top_k(hits, "query_id", order, k)


def cap_per_document(hits: DataFrame, per_document: int, k: int | None = None) -> DataFrame:
    """At most so many hits of a document in rank order, and then at most k; hits without one are not counted."""
    turn = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("rank"))
    kept = hits.withColumn("__turn", turn).filter(F.col("document_id").isNull() | (F.col("__turn") <= per_document)).drop("__turn")
    if k is None:
        return kept
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def context_budget(hits: DataFrame, length: str, budget: int) -> DataFrame:
    """Adds chars: how much of each hit, in rank order, still fits the budget."""
    used = F.coalesce(F.sum(length).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("chars", F.greatest(F.lit(0), F.least(F.col(length), F.lit(budget) - used)).cast("long"))


def evidence_revision(rows: DataFrame, key: str, item: str) -> DataFrame:
    """A hash of the sorted distinct items of each key: equal evidence has one revision."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(item)), "|"), 256).alias("revision"))


def bundle_hash(items: DataFrame, name: str, value: str) -> DataFrame:
    """One row: a hash over name=value of all items in order, and their number. Items are few: files or sources of a bundle."""
    said = F.transform(F.array_sort(F.collect_list(F.struct(name, value))), lambda x: F.concat(x[name], F.lit("="), x[value].cast("string")))
    return items.agg(F.sha2(F.array_join(said, ","), 256).alias("bundle"), F.count("*").alias("sources"))


def parent_evidence(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (query_id, rank, chunk_id, parent_id, source_id, text) of the parents that collapse_parents kept -> a record for each matched chunk.

    Records are in order of their parent, then of the chunk's own rank; a citation id occurs once a query.
    """
    unit = F.coalesce(F.col("parent_id").cast("string"), F.concat(F.lit("single:"), F.col("chunk_id").cast("string")))
    kept = parents.select("query_id", "unit", F.col("rank").alias("place"))
    j = hits.withColumn("unit", unit).join(kept, ["query_id", "unit"])
    j = j.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place", "rank", "chunk_id")).cast("long"))
    return evidence(j)


def matched_union(lists: list[DataFrame]) -> DataFrame:
    """Hits (query_id, doc_id, chunks) of several lists -> query_id, doc_id and all distinct chunks that matched, sorted."""
    out = lists[0].select("query_id", "doc_id", "chunks")
    for x in lists[1:]:
        out = out.unionByName(x.select("query_id", "doc_id", "chunks"))
    return out.groupBy("query_id", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"))
