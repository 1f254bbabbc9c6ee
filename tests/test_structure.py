"""Cleaning in stages and chunks that keep structure: cases by hand, and invariants against the plain text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import cleaning, structure
from tarnweave.operators.chunking import Sizes

LONG = "word " * 9


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, k, p, t) for i, (k, p, t) in enumerate(rows)], "doc_id long, idx long, kind string, page long, text string")


def test_exact_copies_go_but_code_and_tables_stay(spark):
    rows = [("paragraph", None, "Run   this."), ("paragraph", None, "run this."), ("code", None, "```\nx\n```"), ("code", None, "```\nx\n```"), ("table_row", None, "a | b"), ("table_row", None, "a | b"), ("paragraph", None, "")]
    r = cleaning.clean_documents(blocks(spark, rows)).first()
    assert (r["removed_exact"], r["removed_near"], r["clean_blocks"], r["status"]) == (1, 0, 5, "warning")
    out = {x["idx"]: (x["text"], x["char_start"], x["char_end"]) for x in cleaning.clean_blocks(blocks(spark, rows)).filter("fate = 'kept'").collect()}
    assert out[0] == ("Run   this.", 0, 11) and out[2][:2] == ("```\nx\n```", 13) and out[4][1] == 13 + 2 * 11


def test_near_copies_are_held_to_a_high_bound(spark):
    a = " ".join(f"term{i}" for i in range(120))
    rows = [("paragraph", None, a), ("paragraph", None, a + " end"), ("paragraph", None, "show the active PID"), ("paragraph", None, "show the new PID")]
    r = cleaning.clean_documents(blocks(spark, rows)).first()
    assert (r["removed_near"], r["clean_blocks"]) == (1, 3)


def test_edges_of_pages(spark):
    rows = [("paragraph", p, t) for p in range(3) for t in ("Header", f"Body {p} of the page", "Footer")]
    r = cleaning.clean_documents(blocks(spark, rows)).first()
    assert (r["removed_edges"], r["clean_blocks"]) == (6, 3)
    assert cleaning.clean_documents(blocks(spark, rows[:6])).first()["removed_edges"] == 0


def test_line_normalize_and_verdicts(spark):
    rows = [("paragraph", None, "\ufeffﬁne\r\nｔｅｘｔ  \n\n\n\n\nend\x01"), ("code", None, "```\n    ﬁ  \n```")]
    got = [x["text"] for x in cleaning.clean_blocks(blocks(spark, rows)).orderBy("idx").collect()]
    assert got == ["fine\ntext\n\n\nend", "```\n    ﬁ\n```"]
    assert cleaning.clean_documents(blocks(spark, [("paragraph", None, "a" + "\ufffd" * 9)])).first()["status"] == "rejected"
    assert cleaning.clean_documents(blocks(spark, [("paragraph", None, " "), ("paragraph", None, None)])).first()["status"] == "rejected"
    assert cleaning.clean_documents(blocks(spark, [("paragraph", None, "plain")])).first()["status"] == "clean"
    assert cleaning.clean_documents(blocks(spark, rows).limit(0)).count() == 0


def test_adjacent_lines_of_code_and_tables_stay(spark):
    d = spark.createDataFrame([(1, "same\nsame\n```\nx\nx\n```\n| a |\n| a |\nsame")], "doc_id long, text string")
    assert [r["pos"] for r in cleaning.adjacent_duplicates(d).filter("removed").collect()] == [1]
    assert cleaning.near_duplicate_fold(d).first()["n_removed"] == 1


def test_fences_are_cut_at_lines_and_closed_again():
    text = "# Title\n\n```bash\n" + "\n".join(f"echo {i:03d} {'x' * 60}" for i in range(60)) + "\n" + "y" * 3000 + "\n```\nafter"
    ps = structure.pieces(text, Sizes())
    code = [p for p in ps if p.kind == "code"]
    assert len(code) > 2 and all(p.text.startswith("```bash\n") and p.text.endswith("\n```") for p in code)
    body = [x for p in code for x in p.text.split("\n")[1:-1]]
    assert body == text.split("```")[1].split("\n")[1:-1]
    assert all(text.split("\n")[p.line_start - 1] == p.text.split("\n")[1] for p in code)


@pytest.mark.parametrize("seed", range(6))
def test_chunks_cover_the_text(seed):
    rng, lines = random.Random(seed), []
    for _ in range(rng.randint(1, 60)):
        k = rng.random()
        lines += [f"{'#' * rng.randint(1, 3)} Head {rng.randint(0, 9)}"] if k < 0.15 else [""] if k < 0.4 else ["```", "code   line", "```"] if k < 0.45 else [LONG * rng.randint(1, 90) + "end."]
    text, s = "\n".join(lines), Sizes()
    ps = structure.pieces(text, s)
    assert all(text[p.start : p.end] == p.text for p in ps if p.kind != "code")
    assert all(text.split("\n")[p.line_start - 1].strip().startswith(p.text.split("\n")[0][:5].strip()) or p.text.split("\n")[0][:5] in text.split("\n")[p.line_start - 1] for p in ps)
    parents = structure.pack_parents(ps, s)
    assert [p for g in parents for p in g] == ps
    for g in parents:
        assert structure.joined(g) <= s.parent_max or len(g) == 1
        children = structure.pack_children(g, s)
        new = []
        for c in children:
            assert structure.joined(c) <= s.child_max or len(c) == 1
            new.append("".join(p.text for p in c))
        whole = re.sub(r"\s", "", "".join(p.text for p in structure.split_pieces(g, s.child, s.child_max)))
        assert all(re.sub(r"\s", "", p.text) in whole for c in children for p in c)
        held = "".join(re.sub(r"\s", "", p.text) for i, c in enumerate(children) for p in c[len(c) - 1 :])
        assert held and len(re.sub(r"\s", "", "".join(new))) >= len(whole)


def test_chunk_rows(spark):
    text = "# A\n\n## B\n\n" + LONG * 40 + "\n\n## C\n\nshort"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = structure.document_chunks(d).orderBy("child").collect()
    assert {r["doc_id"] for r in rows} == {1} and len({r["chunk_id"] for r in rows}) == len(rows)
    assert rows[1]["retrieval_text"].startswith("A > B\n") and rows[-1]["line_end"] == 9
    parents = structure.document_parents(d).collect()
    assert {r["parent_id"] for r in parents} == {r["parent_id"] for r in rows} and sum(r["n_children"] for r in parents) == len(rows)


def test_plain_chunks(spark):
    text = "\n\n".join(["short one", "w " * 300, "tiny", "v " * 390, "tiny", "short one"])
    rows = structure.plain_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("idx").collect()
    assert all(len(r["text"]) <= 800 for r in rows) and len({r["text"] for r in rows}) == len(rows) > 1
    assert rows[1]["text"].startswith("tiny")
    every = "".join(r["text"] for r in rows)
    assert every.count("w ") >= 299 and every.count("v ") >= 389


def made(spark):
    rng = random.Random(4)
    texts = ["", None, "```\n" + "x = 1\n" * 900 + "```", *("\n\n".join(rng.choice(["# Head", "## Part", LONG * 30, LONG * 200, "```sh\nls\n```", "a | b"]) for _ in range(rng.randint(1, 25))) for _ in range(30))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_parents_move_no_text(spark):
    d = made(spark)
    got = structure.document_parents(d)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    p = structure.document_pieces(d).groupBy("doc_id", "parent").agg(F.max("parent_text"), F.countDistinct("child"), F.min("line_start"), F.max("line_end"))
    assert sorted(map(tuple, p.collect())) == sorted(tuple(r)[1:] for r in got.collect())


def test_chunks_move_no_text(spark):
    d = made(spark)
    got = structure.document_chunks(d)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    p = structure.document_pieces(d).groupBy("doc_id", "child").agg(
        structure.common_path(F.transform(F.array_sort(F.collect_list(F.struct("piece", "path"))), lambda x: x["path"])).alias("path"), F.min("char_start"), F.max("char_end"), F.min("line_start"), F.max("line_end")
    )
    assert sorted(map(tuple, p.collect())) == sorted(tuple(r) for r in got.select("doc_id", "child", "path", "char_start", "char_end", "line_start", "line_end").collect())
