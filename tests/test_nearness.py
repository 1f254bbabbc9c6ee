"""Cosine neighbours by pivots and the chained decontamination against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.operators import corpus, nearness


def _clusters(seed, n=400, groups=25, wide=(0.05, 0.4)):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, 24))
    return base[rng.integers(0, groups, n)] + rng.normal(size=(n, 24)) * rng.uniform(*wide, (n, 1))


def _table(spark, m):
    return spark.createDataFrame([(i, (i * 7919) % 101, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, h long, embedding array<double>")


@pytest.mark.parametrize("block,pivots", [(16, 8), (64, 1), (2048, 20)])
def test_no_neighbour_is_lost_and_far_blocks_are_not_multiplied(spark, block, pivots):
    m = _clusters(3, wide=(0.02, 0.25))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    p = u[:pivots]
    blocks = nearness.blocks_of(nearness.celled(_table(spark, m), p), p, block)
    n, met = blocks.count(), nearness.block_pairs(blocks, blocks, 0.93, True).count()
    if block == 16:
        assert met < 0.5 * n * (n + 1) / 2
    key = [((i * 7919) % 101, i) for i in range(len(m))]
    near = u @ u.T >= 0.93
    want = {}
    for i in range(len(m)):
        others = [j for j in np.nonzero(near[i])[0] if j != i]
        if others:
            want[i] = (any(key[j] < key[i] for j in others), any(key[j] > key[i] for j in others))
    assert {r["vec_id"]: (r["early"], r["late"]) for r in nearness.order_flags(blocks, 0.93).collect()} == want and want


def test_chain_equals_a_plain_loop(spark):
    m = _clusters(9, 300)
    texts = [f"Text, {i}!" if i % 11 else f"text {(i // 11) % 4 * 110}" for i in range(300)]
    texts[5] = texts[17] = None
    m[8] = 0
    rows = [(i, texts[i], None if i == 23 else [float(x) for x in m[i]]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, text string, embedding array<double>")
    h = [(i * 7919) % 101 for i in range(300)]
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    u[23] = 0
    held = [i for i in range(300) if i % 10 == 0]
    plain = lambda t: None if t is None else "".join(c for c in t.lower() if c.isalnum())
    known = {plain(texts[i]) for i in held} - {None}
    want, kept = {}, []
    for i in sorted((i for i in range(300) if i % 10), key=lambda i: (h[i], i)):
        if plain(texts[i]) in known:
            want[i] = "exact_eval"
        elif round(float((u[held] @ u[i]).max()), 6) >= 0.85:
            want[i] = "near_eval"
        elif kept and (u[kept] @ u[i]).max() >= 0.93:
            want[i] = "near_duplicate"
        else:
            want[i] = "kept"
            kept.append(i)
    assert set(want.values()) == {"exact_eval", "near_eval", "near_duplicate", "kept"}
    got = corpus.decontaminated(d.filter("vec_id % 10 <> 0"), d.filter("vec_id % 10 = 0"), order=F.col("vec_id") * 7919 % 101).collect()
    assert {r["vec_id"]: r["verdict"] for r in got} == want and len(got) == len(want)


def test_nothing_protected_and_nothing_at_all(spark):
    d = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.01]), (3, None, None)], "vec_id long, text string, embedding array<double>")
    none = d.limit(0)
    got = {r["vec_id"]: r["verdict"] for r in corpus.decontaminated(d, none, order=F.col("vec_id")).collect()}
    assert got == {1: "kept", 2: "near_duplicate", 3: "kept"}
    assert corpus.decontaminated(none, d).collect() == []


def test_groups_of_blocks_are_bounded():
    sizes = [3, 0, 12, 2, 40, 1, 16, 1, 15, 17]
    places = nearness._groups(sizes)
    held: dict[int, float] = {}
    for n, (first, k) in zip(sizes, places, strict=True):
        for g in range(first, first + k):
            held[g] = held.get(g, 0) + n / k
    assert max(held.values()) <= nearness.PER_GROUP and set(held) == set(range(len(held)))
    assert places[4][1] == 3 and places[0] == places[1] == (0, 1)
