"""Texts with nearly equal neighbours: the registered SQL keeps them, the queries of the whole job take them out."""

import duckdb
import pytest

from tarnweave.plans import registry

LONG = " ".join(f"term{i}" for i in range(120))


@pytest.mark.parametrize("name", ["clean_document", "rebuilt_offsets"])
def test_nearly_equal_neighbours(spark, tmp_path, name):
    rows = [(1, f"{LONG}\n{LONG} term1\n{LONG} term1\nend"), (2, f"{LONG}\n{LONG} term1"), (3, "a\nA\nb")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    near = registry.queries()[name + "_near"](spark, str(tmp_path))
    if name == "clean_document":
        assert {r["doc_id"]: (r["clean_blocks"], r["removed_exact"], r["removed_near"]) for r in near.collect()} == {1: (2, 0, 2), 2: (1, 0, 1), 3: (2, 1, 0)}
    else:
        assert {(r["doc_id"], r["idx"]) for r in near.collect()} == {(1, 0), (1, 3), (2, 0), (3, 0), (3, 2)}
