"""Pages of examples on hand-made texts: preference, chains of aliases and circles."""

from pyspark.sql import functions as F

from tarnweave.operators import pages

SCHEMA = "name string, folder string, path string, text string"


def page(name, text, folder="common"):
    return (name, folder, f"{folder}/{name}", text)


def scan(spark, rows):
    out = {}
    for r in pages.scan_pages(spark.createDataFrame(rows, SCHEMA), "see ").orderBy("name", "pos").collect():
        out.setdefault(r["name"], (r["target"], r["status"], []))[2].append(r["code"])
    return out


def test_examples_of_a_page(spark):
    text = "# t\r\n\r\n- One:\r\n\r\n`run {{x}}`\r\n- Two：\n\n\n\n\n`too far`\n- Three\n`a`\n`b`\nno\n -x\n`c`\n- Four\n  `d [-a|--all]`  "
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(pages.page_examples(F.col("t")).alias("e")).collect()
    assert [tuple(x) for x in got[0]["e"]] == [("One", "run <x>"), ("Three", "a"), ("Four", "d --all")]
    assert got[1]["e"] == [] and got[2]["e"] == []


def test_chains_circles_and_missing_pages(spark):
    see = lambda to: f"- View\n`see {to}`\n"
    chain = [page(f"a{i}", see(f"--long a{i + 1}")) for i in range(20)] + [page("a20", "- go\n`run`\n- also\n`see a0`\n" + "- more\n`m`\n" * 10)]
    rows = chain + [page("c1", see("c2")), page("c2", see("c3")), page("c3", see("c1")), page("into", see("c3")), page("self", see("self")), page("lost", see("no such")), page("bare", "nothing")]
    rows += [page("twice", "- x\n`osx`", "osx"), page("twice", "- x\n`linux`", "linux"), page("twice", "- x\n`zos`", "zos"), page("two", see("twice"), "zos"), (None, "common", "p", "- x\n`y`")]
    got = scan(spark, rows)
    assert all(got[f"a{i}"] == ("a20", "alias" if i < 20 else "page", ["run", *["m"] * 7]) for i in range(21))
    assert {n: got[n] for n in ("c1", "c2", "c3", "into", "self")} == {n: ("self" if n == "self" else "c1", "cycle", [None]) for n in ("c1", "c2", "c3", "into", "self")}
    assert got["lost"] == ("no-such", "missing", [None]) and got["bare"] == ("bare", "page", [None])
    assert got["twice"] == ("twice", "page", ["linux"]) and got["two"] == ("twice", "alias", ["linux"])
    assert None not in got and scan(spark, []) == {}
