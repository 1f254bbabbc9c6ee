"""Episodes that are alike, against a plain loop."""

import time

import numpy as np

from tarnweave.operators import memory


def episodes(spark, rows):
    return spark.createDataFrame(rows, "id long, project string, outcome string, symptom string, keys array<string>")


def plain(rows, least=0.8):
    said = [(i, p, o, frozenset(k), frozenset(s.split())) for i, p, o, s, k in rows]
    out = {}
    for i, p, o, k, t in said:
        alike = [j for j, p2, o2, k2, t2 in said if j < i and (p, o, k) == (p2, o2, k2) and (2.0 * len(t & t2) / (len(t) + len(t2)) >= least if t or t2 else True)]
        out[i] = min(alike, default=i)
    return out


def test_first_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = np.array([f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)])
    base = [set(rng.choice(words, n, replace=False)) for n in (1, 2, 5, 9, 30, 31, 60, 200)]
    rows = []
    for i in range(1, 400):
        b = base[rng.integers(len(base))]
        kept = [w for w in sorted(b) if rng.random() > rng.choice([0, 0.05, 0.2, 0.35])] + list(rng.choice(words, rng.integers(0, 4)))
        rows.append((i * 3, f"p{i % 2}", "ok", " ".join(kept), ["b", "a"] if i % 3 else ["a", "b", "b"]))
    rows += [(5000 + i, "p0", "ok", "", ["a"]) for i in range(3)]
    want = plain(rows)
    assert len(set(want.values())) < 300
    for most in (1 << 19, 40, 0):  # the table of frequencies only decides what is compared
        monkeypatch.setattr(memory, "FREQUENT", most, raising=False)
        assert {r["id"]: r["first"] for r in memory.episode_duplicates(episodes(spark, rows)).collect()} == want


def test_no_row_is_lost_and_no_text_is_joined(spark):
    rows = [(1, None, "ok", "same words here", ["a"]), (2, None, "ok", "same words here", ["a"]), (3, "p", "ok", None, ["a"]), (4, "p", "ok", "x_long " * 900, ["a"]), (5, "p", "ok", "x_long " * 900, ["a"])]
    assert {r["id"]: r["first"] for r in memory.episode_duplicates(episodes(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    sets = spark.createDataFrame([(i, 7, list(range(i, i + 3000))) for i in range(20)], "id long, grp long, t array<long>")
    rare = memory._rarest(sets, 0.8)
    assert rare.dtypes == [("key", "bigint"), ("id", "bigint"), ("n", "int")]
    assert memory._met(rare, 0.8).count() == 190


def shuffled(spark):
    """Bytes that all tasks so far have shuffled."""
    time.sleep(1)  # until the last tasks are counted
    rows = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.length()))


def test_shared_tokens_move_no_pairs(spark):
    """Episodes that share a third of their tokens but aren't alike: what moves grows with the episodes, not with their pairs."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(180)])
    rows = [(i, "p", "ok", " ".join(rng.choice(words, 60, replace=False)), ["a"]) for i in range(1500)]
    before = shuffled(spark)
    assert memory.episode_duplicates(episodes(spark, rows)).filter("id <> first").count() == 0
    assert shuffled(spark) - before < 1500 * 600


def test_blocks_of_any_size_lose_no_pair(spark):
    from tarnweave.operators import likeness

    rng = np.random.default_rng(4)
    whole = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 3000)]
    rows = []
    for i in range(300):
        n = int(rng.choice([1, 2, 3, 10, 32, 33, 40, 64, 65, 90, 500, 700, 2000]))
        rows.append((i, i % 2, sorted({whole[j] for j in rng.choice(int(n * 1.15) + 1, n, replace=False)})))
    want = set()
    for i, g, t in rows:
        want |= {(i, j) for j, g2, t2 in rows[:i] if g == g2 and 2.0 * len(set(t) & set(t2)) / (len(t) + len(t2)) >= 0.8}
    assert len(want) > 1000
    sets = spark.createDataFrame([*rows, (900, 0, [])], "id long, grp long, t array<long>")
    for block in (4096, 7, 1):
        got = [tuple(r) for r in likeness.may_be_alike(likeness.sketches(sets), 0.8, block).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and 900 not in {x for r in got for x in r}
