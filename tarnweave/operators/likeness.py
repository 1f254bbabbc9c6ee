"""Sets of 64-bit tokens that may be alike (Dice), by sketches: blocks of sketches are compared, no token is joined.

A sketch has a bit for each class of tokens, two to four classes a token: whether the set has an odd number
of tokens of that class. Two sets differ in at least as many tokens as their sketches do in bits, and
alike sets differ in few, so a pair whose sketches differ in more bits is not alike, and no pair is lost.
Sketches of different lengths are compared at the shorter one: its classes are unions of the longer one's.

Rows are sorted by group and size and cut into blocks of one group and one length of sketch. A block goes
to the blocks of its group whose sizes it may reach. What moves is the sketches, once for each pair of
blocks, and what comes out are the pairs of ids that pass; the pairs of rows that are compared grow with the square
of a group, in memory and word by word, and are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.operators.search import small_batches
from tarnweave.sources.tables import written

#: Rows of a block and bytes of its sketches at most; sizes of sketches in bits. They decide what work costs, not what comes out.
BLOCK, BLOCK_BYTES, LEAST_BITS, MOST_BITS = 4096, 1 << 19, 64, 1 << 15
SLACK = 1e-9


def sketches(sets: DataFrame) -> DataFrame:
    """sets (id, grp, t) -> grp, n, bits, id, s: the size of each set with tokens and its sketch."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n = b["t"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
                end, row = np.cumsum(bits), np.repeat(np.arange(len(n)), n)
                odd = np.bincount((end - bits)[row] + (b["t"].flatten().to_numpy(zero_copy_only=False) & (bits[row] - 1)), minlength=end[-1]) & 1
                place = np.concatenate([[0], end // 8]).astype(np.int32)
                s = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(place), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])
                yield pa.record_batch([b["grp"], pa.array(n.astype(np.int32)), pa.array(bits.astype(np.int32)), b["id"], s], ["grp", "n", "bits", "id", "s"])

    return sets.filter(F.size("t") > 0).select("id", "grp", "t").mapInArrow(run, "grp long, n int, bits int, id long, s binary")


def _cuts(grp: np.ndarray, bits: np.ndarray, block: int) -> np.ndarray:
    """Where blocks of at most so many rows begin."""
    runs = np.concatenate([[0], np.flatnonzero((grp[1:] != grp[:-1]) | (bits[1:] != bits[:-1])) + 1, [len(grp)]])
    return np.concatenate([np.arange(a, b, max(1, min(block, BLOCK_BYTES * 8 // int(bits[a])))) for a, b in zip(runs[:-1], runs[1:], strict=True)])


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``sketches`` -> block, grp, bits, lo, hi (the sizes), ids, n, s; written."""

    def run(batches):
        def packed(table, begin, end):
            cols = {c: table[c].to_numpy() for c in ("grp", "n", "bits", "id")}
            out = [(cols["grp"][a], cols["bits"][a], cols["n"][a], cols["n"][z - 1], cols["id"][a:z].tobytes(), cols["n"][a:z].tobytes(), b"".join(table["s"].slice(a, z - a).to_pylist())) for a, z in zip(begin, end, strict=True)]
            names = ["grp", "bits", "lo", "hi", "ids", "n", "s"]
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        held = None
        for b in batches:
            if b.num_rows:
                now = pa.Table.from_batches([b])
                held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
                begin = _cuts(held["grp"].to_numpy(), held["bits"].to_numpy(), block)
                if len(begin) > 1:
                    yield packed(held, begin[:-1], begin[1:])
                held = held.slice(begin[-1])  # the last block may go on in the next batch
        if held is not None:
            yield packed(held, [0], [held.num_rows])

    ordered = rows.repartitionByRange("grp", "n", "id").sortWithinPartitions("grp", "n", "id")
    out = ordered.mapInArrow(run, "grp long, bits int, lo int, hi int, ids binary, n binary, s binary")
    return written(out.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _close(left: tuple, right: tuple, itself: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, other) of the pairs of two blocks (ids, n, sketches) that may be alike, the larger id first."""
    (ids, n, s), (ids2, n2, s2) = left, right
    while s.shape[1] > s2.shape[1]:
        s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
    while s2.shape[1] > s.shape[1]:
        s2 = s2[:, : s2.shape[1] // 2] ^ s2[:, s2.shape[1] // 2 :]
    share = least / (2 - least)
    far = lambda x: np.minimum(np.ceil(x * (1 - least)) + 1, 30_000).astype(np.uint16)
    words, words2, far2, found = np.ascontiguousarray(s.T), np.ascontiguousarray(s2.T), far(n2), []
    for at in range(0, len(ids), 32):
        to = min(at + 32, len(ids))
        a, z = np.searchsorted(n2, n[at] * share - SLACK), np.searchsorted(n2, n[to - 1] / share + SLACK, side="right")
        a = max(a, at) if itself else a
        if a >= z:
            continue
        apart, x, c = np.zeros((to - at, z - a), np.uint16), np.empty((to - at, z - a), np.uint64), np.empty((to - at, z - a), np.uint8)
        for w, w2 in zip(words, words2, strict=True):
            np.bitwise_xor(w[at:to, None], w2[None, a:z], out=x)
            np.add(apart, np.bitwise_count(x, out=c), out=apart)
        i, j = np.nonzero(apart <= far(n[at:to])[:, None] + far2[None, a:z])
        d = apart[i, j].astype(np.int64)
        i, j = i + at, j + a
        p, q = n[i].astype(np.int64), n2[j].astype(np.int64)
        fits = (d <= p + q - 2 * np.ceil((p + q) * (least / 2) - SLACK)) & (np.minimum(p, q) >= np.maximum(p, q) * share - SLACK)
        if itself:
            fits &= i < j
        found.append((ids[i[fits]], ids2[j[fits]]))
    p, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return np.maximum(p, q), np.minimum(p, q)


def may_be_alike(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Rows of ``sketches``, ids unique, cheap to read twice -> id, other: all pairs of a group, the larger id first, that are alike by ``least`` or more, and few others; written."""
    blocks = blocks_of(rows, block)
    share = least / (2 - least)
    of = blocks.select("block", "grp", "lo", "hi")
    to = of.select(*[F.col(c).alias(f"{c}2") for c in of.columns])
    reach = (F.col("hi2") >= F.col("lo") * share - SLACK) & (F.col("hi") >= F.col("lo2") * share - SLACK)
    pairs = of.join(to, (F.col("grp") == F.col("grp2")) & (F.col("block") <= F.col("block2")) & reach).select("block", "block2")
    data = ["bits", "ids", "n", "s"]
    sides = pairs.join(blocks.select("block", *data), "block").join(blocks.select(F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in data]), "block2")

    def run(batches):
        def side(b, k, i):
            bits, ids, n, s = (b[f"{c}{k}"][i].as_py() for c in data)
            return np.frombuffer(ids, np.int64), np.frombuffer(n, np.int32), np.frombuffer(s, np.uint64).reshape(-1, bits // 64)

        for b in batches:
            for i in range(b.num_rows):
                id_, other = _close(side(b, "", i), side(b, "2", i), b["block"][i].as_py() == b["block2"][i].as_py(), least)
                yield pa.record_batch([pa.array(id_), pa.array(other)], ["id", "other"])

    with small_batches(rows.sparkSession, 8):
        return written(sides.mapInArrow(run, "id long, other long"), "met")
