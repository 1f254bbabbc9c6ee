"""Ranking in small pieces: the same results, and no more rows at once than stated."""

import numpy as np
import pyarrow as pa

from tarnweave.operators import search

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(spark, n):
    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    return [r["n"] for r in spark.range(n, numPartitions=1).mapInArrow(run, "n long").collect()]


def test_python_gets_few_rows_at_once(spark):
    before = spark.conf.get(KEY)
    with search.small_batches(spark):
        assert max(sizes(spark, 3000)) <= search.BATCH
        with search.small_batches(spark, 100):
            assert max(sizes(spark, 3000)) <= 100
        assert max(sizes(spark, 3000)) == search.BATCH
    assert spark.conf.get(KEY) == before


def test_documents_in_small_chunks_are_ranked_as_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 12))) for i in range(300)], "doc_id long, text string").coalesce(2)
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(9)], "query_id long, text string")
    rank = lambda: sorted(map(tuple, search.bm25(docs, asked, 7).collect()))
    whole = rank()
    assert len(whole) == 63
    monkeypatch.setattr(search, "CHUNK", 5)
    monkeypatch.setattr(search, "BATCH", 11, raising=False)
    assert rank() == whole


def test_vectors_in_small_chunks_are_ranked_as_at_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = np.round(rng.normal(size=(230, 6)), 1)
    m[50:90] = m[0]  # ties go by id
    e = spark.createDataFrame([(i, [float(x) for x in v], ["a"] if i % 3 else ["a", "b"]) for i, v in enumerate(m)], "vec_id long, embedding array<double>, tags array<string>").coalesce(2)
    q = e.filter("vec_id % 20 = 0").selectExpr("vec_id query_id", "embedding", "case when vec_id % 40 = 0 then array('b') when vec_id = 20 then array('none') else array() end wanted")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 6)
    for tagged in (False, True):
        want = set()
        for i in range(0, 230, 20):
            can = [j for j in range(230) if not tagged or (j % 3 == 0 if i % 40 == 0 else i != 20)]
            want |= {(i, j, r) for r, j in enumerate(sorted(can, key=lambda j: (-s[i, j], j))[:5], 1)}
        for size, block in ((256, 2048), (7, 3)):
            monkeypatch.setattr(search, "VECTORS", size, raising=False)
            got = search.dense(q if tagged else q.drop("wanted"), e if tagged else e.drop("tags"), 5, block, tagged).collect()
            assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want
