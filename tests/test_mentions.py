from tarnweave.operators.mentions import commands, mention_table, ordered_mentions, settled_mentions


def test_commands():
    t = "Use `git status` first.\n\n```sh\ngit push\n# note\n  ls -la\n```\n\n$ make all\nand `git status` again"
    got = commands(t)
    assert [(k, c) for k, c, _ in got] == [("inline", "git status"), ("fenced", "git push"), ("fenced", "ls -la"), ("line", "make all")]
    assert all(t[at : at + len(c)] == c for _, c, at in got)
    assert commands("") == []


def test_mentions(spark):
    words = {"python": ["python", "py"], "rust": ["rust"]}
    assert ordered_mentions("I like Rust, not python; pyx is no py", words) == ["rust", "!python", "!python"]
    df = spark.createDataFrame([(1, "rust"), (2, None)], "id long, text string")
    assert {r["id"]: r["mentions"] for r in mention_table(df, "id", words).collect()} == {1: ["rust"], 2: []}


def test_settled_mentions():
    words = {"python": ["python", "py"], "npm": ["npm"], "pnpm": ["pnpm"], "中文": ["中文"]}
    assert settled_mentions("I like python, and python, no py", words) == ["python", "!python"]
    assert settled_mentions("not npm but pnpm", words) == ["pnpm"]
    assert settled_mentions("there is no reason to leave npm", words) == ["npm"]
    assert settled_mentions("不要用npm，用pnpm", words) == ["!npm", "pnpm"]
    assert settled_mentions("", words) == []


def test_standalone_commands_and_long_code():
    t = "git push origin\nThen it is done.\n`" + "x" * 300 + "`"
    assert [(k, len(c)) for k, c, _ in commands(t)] == [("standalone", 15), ("inline", 300)]
