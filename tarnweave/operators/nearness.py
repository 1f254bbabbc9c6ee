"""Cosine neighbours by pivots: blocks of vectors whose angles to all pivots overlap are multiplied, no others.

The angle is a metric, so two vectors at a cosine of ``most`` or more differ by arccos(most) at most in
their angle to any pivot. Rows are sorted by (nearest pivot, angle to it) in ranges, which also splits a
cell that holds a large part of all rows, and are cut into blocks that never cross a cell. A block knows
the least and the greatest angle of its rows to each pivot. It goes to the cells that it may reach, and
there, by groups of blocks, meets those it may reach; matrices are multiplied for these alone.

The pivots are few (64 here) and any choice is exact; what they change is how much is skipped. Vectors
without structure (independent directions in many dimensions) have no block that can be skipped, and the
work is then quadratic in the blocks. Pairs of rows are never listed: each product of two blocks gives
flags of its rows, at most two rows of output a row of input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.sources.tables import written

SLACK = 1e-6
PER_GROUP = 16
ROWS = "vec_id long, h long, cell int, angle double, embedding array<double>"
BLOCKS = "block long, cell int, ids binary, h binary, m binary, lo array<double>, hi array<double>"


def units(rows) -> np.ndarray:
    """The vectors of an iterable, scaled to length 1."""
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def celled(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors (vec_id, h, embedding) -> with cell (nearest pivot) and the angle to it; embeddings scaled to length 1."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(frames):
        for whole in frames:
            for at in range(0, len(whole), 1024):
                f = whole.iloc[at : at + 1024]
                m = units(f["embedding"])
                c = m @ shared.value.T
                cell = c.argmax(axis=1)
                angle = np.arccos(np.clip(c[np.arange(len(c)), cell], -1, 1))
                yield pd.DataFrame({"vec_id": f["vec_id"].to_numpy(), "h": f["h"].to_numpy(), "cell": cell.astype(np.int32), "angle": angle, "embedding": list(m)})

    return vectors.select("vec_id", "h", "embedding").mapInPandas(run, ROWS)


def blocks_of(rows: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """Rows of ``celled`` -> blocks of one cell each, with their bounds to the pivots; written."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def pack(frames):
        def one(f):
            m = np.stack(f["embedding"].to_numpy())
            a = np.arccos(np.clip(m @ shared.value.T, -1, 1))
            ids, h = (f[c].to_numpy(np.int64) for c in ("vec_id", "h"))
            return pd.DataFrame({"cell": f["cell"].to_numpy()[:1], "ids": [ids.tobytes()], "h": [h.tobytes()], "m": [m.tobytes()], "lo": [a.min(axis=0)], "hi": [a.max(axis=0)]})

        held = None
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            while len(held):
                same = int((held["cell"] == held["cell"].iloc[0]).sum())
                if same < block and same == len(held):
                    break
                yield one(held.iloc[: min(same, block)])
                held = held.iloc[min(same, block) :].reset_index(drop=True)
        if held is not None and len(held):
            yield one(held)

    ordered = rows.repartitionByRange("cell", "angle", "vec_id").sortWithinPartitions("cell", "angle", "vec_id")
    packed = ordered.mapInPandas(pack, BLOCKS.removeprefix("block long, "))
    return written(packed.withColumn("block", F.monotonically_increasing_id()).select("block", "cell", "ids", "h", "m", "lo", "hi"), "blocks")


def _groups(sizes: list[int]) -> list[tuple[int, int]]:
    """First group and number of groups of each cell: small cells share a group of PER_GROUP blocks, large ones have several."""
    out, group, held = [], 0, 0
    for n in sizes:
        if held and held + n > PER_GROUP:
            group, held = group + 1, 0
        k = max(1, -(-n // PER_GROUP))
        out.append((group, k))
        group, held = (group + k, 0) if k > 1 else (group, held + n)
    return out


def block_pairs(left: DataFrame, right: DataFrame, most: float, itself: bool) -> DataFrame:
    """Blocks of ``left`` beside those blocks of ``right`` (columns ..2) that may hold a neighbour; ``itself``: each pair once.

    What reaches the driver is a bound for each pair of a cell and a pivot, and a count for each cell.
    """
    span = float(np.arccos(most)) + SLACK
    edge = right.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("pivot", "b")).groupBy("cell", "pivot").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    bounds: dict[int, dict[int, tuple[float, float]]] = {}
    for r in edge.collect():
        bounds.setdefault(r["cell"], {})[r["pivot"]] = (r["lo"], r["hi"])
    n = {r["cell"]: r["n"] for r in right.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cells = sorted(bounds)
    places = _groups([n[c] for c in cells])
    lo, hi = (np.array([[bounds[c][p][k] for p in range(len(bounds[c]))] for c in cells]) for k in (0, 1))
    shared = left.sparkSession.sparkContext.broadcast((lo, hi, places))

    def reach(lows: pd.Series, highs: pd.Series) -> pd.Series:
        lo, hi, places = shared.value
        near = lambda a, b: ((a[None] - span <= hi) & (b[None] + span >= lo)).all(axis=1)
        return pd.Series([sorted({g for i in np.nonzero(near(a, b))[0] for g in range(places[i][0], sum(places[i]))}) if places else [] for a, b in zip(lows, highs, strict=True)])

    a = left.withColumn("at", F.explode(F.pandas_udf(reach, "array<int>")("lo", "hi")))
    of = lambda k: F.create_map(*[x for c, p in zip(cells, places, strict=True) for x in (F.lit(c), F.lit(p[k]))])[F.col("cell2")] if cells else F.lit(0)
    b = right.select(*[F.col(c).alias(f"{c}2") for c in right.columns]).withColumn("at2", (of(0) + F.pmod(F.xxhash64("block2"), of(1))).cast("int"))
    apart = F.exists(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda x: (x["lo"] - span > x["hi2"]) | (x["hi"] + span < x["lo2"]))
    on = F.col("at") == F.col("at2")
    if itself:
        on = on & (F.col("block") <= F.col("block2"))
    return a.join(b, on & ~apart).select("block", "ids", "h", "m", "block2", "ids2", "h2", "m2")


def _read(r):
    at = lambda i, h, m: (np.frombuffer(i, np.int64), np.frombuffer(h, np.int64), np.frombuffer(m, np.float64))
    (ids, h, m), (ids2, h2, m2) = at(r.ids, r.h, r.m), at(r.ids2, r.h2, r.m2)
    return ids, h, m.reshape(len(ids), -1), ids2, h2, m2.reshape(len(ids2), -1)


def order_flags(blocks: DataFrame, most: float) -> DataFrame:
    """(vec_id, early, late) of rows with a neighbour: whether one comes before it by (h, vec_id), and whether one comes after."""

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                ids, h, m, ids2, h2, m2 = _read(r)
                flags = np.zeros((2, len(ids)), bool), np.zeros((2, len(ids2)), bool)
                for at in range(0, len(ids), 512):
                    i, j = np.nonzero(m[at : at + 512] @ m2.T >= most)
                    i += at
                    if r.block == r.block2:
                        i, j = i[i != j], j[i != j]
                    first = (h[i] < h2[j]) | ((h[i] == h2[j]) & (ids[i] < ids2[j]))
                    flags[0][1][i[first]] = flags[1][0][j[first]] = True
                    flags[0][0][i[~first]] = flags[1][1][j[~first]] = True
                for k, g in ((ids, flags[0]), (ids2, flags[1])):
                    any_ = g.any(axis=0)
                    if any_.any():
                        yield pd.DataFrame({"vec_id": k[any_], "early": g[0][any_], "late": g[1][any_]})

    found = block_pairs(blocks, blocks, most, True).mapInPandas(run, "vec_id long, early boolean, late boolean")
    return found.groupBy("vec_id").agg(F.bool_or("early").alias("early"), F.bool_or("late").alias("late"))


def near_any(blocks: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """vec_id of the rows of ``targets`` (blocks) that have a neighbour in ``blocks``."""

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                ids, _, m, ids2, _, m2 = _read(r)
                hit = np.zeros(len(ids2), bool)
                for at in range(0, len(ids), 512):
                    hit |= (m[at : at + 512] @ m2.T >= most).any(axis=0)
                if hit.any():
                    yield pd.DataFrame({"vec_id": ids2[hit]})

    return block_pairs(blocks, targets, most, False).mapInPandas(run, "vec_id long").distinct()


def removed_in_order(rows: DataFrame, pivots: np.ndarray, most: float, block: int) -> DataFrame:
    """vec_id of the rows of ``celled`` that go: taken in order of (h, vec_id), a row goes if it is near one that stays.

    In each round the rows with no earlier neighbour among those still open stay, and what is near them
    goes. Rows without a neighbour are settled by the first round. With a random order the number of
    rounds grows as the logarithm of the rows.
    """
    gone = None
    while True:
        flags = written(order_flags(blocks_of(rows, pivots, block), most), "flags")
        if flags.isEmpty():
            break
        held = rows.join(flags.select("vec_id", "early"), "vec_id").select(*rows.columns, "early")
        stay, rest = (written(held.filter(c).drop("early"), n) for c, n in ((~F.col("early"), "stay"), (F.col("early"), "open")))
        out = written(near_any(blocks_of(stay, pivots, block), blocks_of(rest, pivots, block), most), "gone")
        gone = out if gone is None else gone.unionByName(out)
        rows = rest.join(out, "vec_id", "left_anti")
    return rows.select("vec_id").limit(0) if gone is None else gone
