"""N-gram Jaccard join by parity sketches (operator 2).

Each set of shingles becomes a bit sketch: every shingle flips one bit, so the
Hamming distance of two sketches is at most the symmetric difference of their
sets. Two sets with Jaccard similarity t or more and sizes in one size band differ
in at most d shingles; a sketch cut into more than d slices agrees on at least
one. Slices are joined by their hash and all candidates verified on whole sets.

* Size bands: band g holds the sizes [L(g), L(g+1)), L growing by 1/t. A set
  takes part in its own band and in the lower bands whose members it may exceed.
* Slices with fewer than c bits set (c is 1 or 2) would join sets that share but one
  common shingle. There are 1 + e slices more than d, so if at most e slices of a set
  are that light, some agreeing slice is not, and only the others are joined. The few
  sets with more light slices also join by prefix shingles (the |S| - ceil(t|S|) + 1
  least hashes, one of which similar sets share); if all agreeing slices of a pair are
  light, both sets are such.
* Equal sets are one class before anything is joined, so copies cost a row each.
* Sets of a band are first cut, by shingle, into parts of about 400 shingles. Similar sets
  differ in no more than d / parts of them in some part, and slices are of parts. Each part
  has a second sketch as a whole, 512 bits, whose distance must stay within that bound.

Pairs are never listed by group. They are settled in two steps, and neither makes more
rows than there are classes or roots in slice groups:

1. Election: the least class of a slice group is its centre. Every class takes the one
   centre it shares most slices with; the pair is verified, and verified pairs are joined
   into components. So a group of near copies falls to its centre at one pair a member.
2. Closing: slice groups that still hold several components are searched by sketches for
   pairs across components, outliers against all others. What may link is gathered in
   clusters of components, and within a cluster every pair across components is
   compared on its whole sets, in blocks of bounded size. Only pairs that join two
   components leave a task.

Every link is a pair of some slice group that passes its sketches there, so it is inside a
component after step 1 or compared exactly in step 2. Large slice groups and clusters are
cut into blocks, and pairs of blocks are dealt to tasks.

Shingles are 64-bit hashes throughout; a class is known by a 64-bit sum of them, so among
10^9 different sets two are taken for one with a probability of about 3 %.
Cases: null and empty texts have no shingles and link with nothing, not even with
each other; a null id never becomes a component's id unless a class has no other;
repeated rows are copies; other columns are not touched.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import _K, mix, shingle_sets
from .common import WS_CHARS, cut, text_or_empty
from .components import connected_components

SLICE_BITS = 512
#: Shingles that a part of a large set has, about.
PART = 400
#: So many pairs of sketches are compared at once.
PAIRS = 200_000
#: Slice groups beyond so many rows are compared in pairs of blocks, one a task ...
GROUP_ROWS = 4096
#: ... and clusters beyond so many shingles likewise.
CLUSTER_SHINGLES = 1_000_000
SKETCH = [f"s{i}" for i in range(SLICE_BITS // 64)]
#: So many ids are broadcast at most, to pick the texts whose sets are verified.
BROADCAST_ROWS = 500_000


def _bands(largest: int, pct: int) -> list[int]:
    """L(0), L(1), ...: lower bounds of the size bands up to ``largest``."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // pct)))
    return bounds


def _class_of(s: np.ndarray) -> int:
    return int(mix(mix(s ^ _K[20]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


@lru_cache(maxsize=4096)
def _content(least: int, d: int) -> tuple[int, int]:
    """(c, e): bits that a joined slice has at least, and slices to spare for lighter ones.

    e is 2.5 standard deviations above the number of light slices to expect in a set of
    ``least`` shingles; a poor guess costs prefix keys, not links.
    """
    for c in (2, 1):
        for e in range(1, 2 * d + 4):
            m = d + 1 + e
            p = math.exp(-least / m) * (1 + (c > 1) * least / m)
            if p * m + 2.5 * math.sqrt(m * p * (1 - p)) <= e:
                return c, e
    return 1, 1 + d // 25


def parts_of(s: np.ndarray, pct: int, bounds: list[int]):
    """(band and part, number of parts, shingles of the part, their largest difference, their usual number) for each part of each band of a set."""
    n = len(s)
    while bounds[-1] <= n:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // pct)))
    g = int(np.searchsorted(bounds, n, side="right")) - 1
    while g >= 0 and pct * n <= 100 * (_upper(bounds, g, pct) - 1):
        top = _upper(bounds, g, pct) - 1
        d = (100 - pct) * (top + 100 * top // pct) // (100 + pct)
        if d > 0:  # else only equal sets are similar
            parts = max(1, bounds[g] // PART)
            of = mix(s ^ _K[26]) % np.uint64(parts) if parts > 1 else np.zeros(n, np.uint64)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(parts + 1, dtype=np.uint64))
            for p in range(parts):
                tag = (g << 20) + p
                yield tag, parts, s[order[ends[p] : ends[p + 1]]], d // parts, bounds[g] // parts
        g -= 1


def slice_keys(t: np.ndarray, tag: int, d: int, usual: int, s: np.ndarray, pct: int) -> np.ndarray:
    """Keys of the slices of one part ``t`` of the set ``s``, any two of which differ in d shingles at most."""
    least, spare = _content(usual, d)
    m = d + 1 + spare
    bits, times = np.unique(mix(t ^ _K[21]) % np.uint64(m * SLICE_BITS), return_counts=True)
    bits = bits[times % 2 == 1]
    place = (bits // np.uint64(SLICE_BITS)).astype(np.int64)
    slices = np.zeros(m, np.uint64)
    np.bitwise_xor.at(slices, place, mix(bits ^ _K[22]))
    heavy = np.flatnonzero(np.bincount(place, minlength=m) >= least)
    keys = mix(slices[heavy] ^ mix((heavy.astype(np.uint64) + np.uint64(1)) * _K[23] + np.uint64(tag)))
    if m - len(heavy) <= spare:
        return keys
    prefix = s[: len(s) - -(-pct * len(s) // 100) + 1]
    return np.r_[keys, mix(prefix ^ mix(np.array([tag], np.uint64) + _K[24]))]


def _upper(bounds: list[int], g: int, pct: int) -> int:
    return bounds[g + 1] if g + 1 < len(bounds) else max(bounds[g] + 1, -(-bounds[g] * 100 // pct))


def part_sketch(s: np.ndarray) -> bytes:
    """64 bytes: the parity of each of 512 bits over a part of a set."""
    bits = (mix(s ^ _K[25]) % np.uint64(SLICE_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SLICE_BITS).astype(np.uint8) & 1).tobytes()


def _members(docs: DataFrame, words: int, pct: int) -> DataFrame:
    """(doc_id, th, n_shingles, cls, sketches) of every row; a task gives the sketches of a class once."""
    kind = pa.struct([("part", pa.int32()), ("parts", pa.int32()), *((c, pa.int64()) for c in SKETCH)])

    def run(batches):
        bounds, seen = _bands(1000, pct), set()
        for b in batches:
            n, cls, many, tags = [], [], [0], []
            bits: list[bytes] = []
            for _, s in shingle_sets(b["text"], words):
                n.append(len(s))
                cls.append(c := _class_of(s))
                if len(s) and c not in seen:
                    seen.add(c)
                    for tag, parts, t, _, _ in parts_of(s, pct, bounds):
                        tags.append((tag, parts))
                        bits.append(part_sketch(t))
                many.append(len(tags))
            x = np.frombuffer(b"".join(bits), np.int64).reshape(-1, len(SKETCH))
            t = np.array(tags, np.int32).reshape(-1, 2)
            one = pa.StructArray.from_arrays([pa.array(c) for c in (*t.T, *x.T)], fields=list(kind))
            sketches = pa.ListArray.from_arrays(pa.array(many, pa.int32()), one)
            yield pa.record_batch([b["doc_id"], b["th"], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), sketches], ["doc_id", "th", "n_shingles", "cls", "sketches"])

    sketch = ",".join(f"{c}:bigint" for c in SKETCH)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n_shingles long, cls long, sketches array<struct<part:int,parts:int,{sketch}>>"
    return docs.mapInArrow(run, schema)


def _slices(docs: DataFrame, words: int, pct: int) -> DataFrame:
    """(k, cls, part): a row for each slice of each class, once a task."""

    def run(batches):
        bounds, seen = _bands(1000, pct), set()
        for b in batches:
            rows, size = [], 0
            for _, s in shingle_sets(b["text"], words):
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                seen.add(c)
                for tag, _, part, d, usual in parts_of(s, pct, bounds):
                    rows.append((slice_keys(part, tag, d, usual, s, pct), c, tag))
                    size += len(rows[-1][0])
                if size > 200_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        n = [len(k) for k, _, _ in rows]
        cls, tag = (np.repeat(np.array([r[i] for r in rows], np.int64), n) for i in (1, 2))
        return pa.record_batch([pa.array(np.concatenate([k for k, _, _ in rows]).view(np.int64)), pa.array(cls), pa.array(tag.astype(np.int32))], ["k", "cls", "part"])

    return docs.select("text").mapInArrow(run, "k long, cls long, part int")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(cls, s): the sets themselves, as arrays of hashes."""

    def run(batches):
        for b in batches:
            rows = [(_class_of(s), s.view(np.int64)) for _, s in shingle_sets(b["text"], words) if len(s)]
            for i in range(0, len(rows), 500):
                part = rows[i : i + 500]
                offsets = np.r_[0, np.cumsum([len(s) for _, s in part])].astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s for _, s in part])))
                yield pa.record_batch([pa.array([c for c, _ in part], pa.int64()), arrays], ["cls", "s"])

    return docs.select("text").mapInArrow(run, "cls long, s array<long>")


def _first(*cols: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in some column."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return out


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; ``label`` holds the least row of each row's set."""
    while len(i):
        a, b = label[i], label[j]
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (next_ := label[label]).tobytes() != label.tobytes():
            label[:] = next_


def roots_that_may_link(g, side, root, n, parts, sketch, pct) -> tuple[np.ndarray, np.ndarray]:
    """Roots (a, b) of rows of one group g with passing sketches: enough of them to connect all such roots.

    Rows are sorted by g. Those of a group's commonest root are compared with the others only;
    rows of one side are not compared where a group has two sides.
    """
    order = np.lexsort((root, g))
    runs = np.flatnonzero(_first(g[order], root[order]))
    length = np.diff(np.r_[runs, len(g)])
    number = np.cumsum(_first(g)) - 1
    by = np.lexsort((length, number[order][runs]))
    last = by[np.r_[np.flatnonzero(_first(number[order][runs][by]))[1:], len(by)] - 1] if len(by) else by
    common = root[order][runs][last]
    outlier = root != common[number]
    order = np.lexsort((~outlier, g))
    g, side, root, n, parts, sketch, outlier, number = (x[order] for x in (g, side, root, n, parts, sketch, outlier, number))
    head = np.flatnonzero(_first(g))
    start = head[number]
    before = np.minimum(np.arange(len(g)) - start, np.bincount(number, outlier, minlength=len(head)).astype(np.int64)[number])
    two = (np.maximum.reduceat(side, head) != np.minimum.reduceat(side, head))[number] if len(head) else side
    order = np.lexsort((root, g))
    runs = np.flatnonzero(_first(g[order], root[order]))
    label = np.empty(len(g), np.int64)
    label[order] = np.repeat(np.minimum.reduceat(order, runs), np.diff(np.r_[runs, len(g)])) if len(runs) else order
    own, at, ends = label.copy(), 0, np.cumsum(before)
    while at < len(g):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        times = before[at:stop]
        i = np.repeat(np.arange(at, stop), times)
        j = np.repeat(start[at:stop] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        fit = (low * 100 >= high * pct) & (label[i] != label[j]) & ~(two[i] & (side[i] == side[j]))
        i, j = i[fit], j[fit]
        h = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        fit = h * (100 + pct) * parts[i] <= (n[i] + n[j]) * (100 - pct)
        join_labels(label, i[fit], j[fit])
        at = stop
    moved = np.flatnonzero((own == np.arange(len(g))) & (label != own))
    return root[moved], root[label[moved]]


def _whole_groups(batches, keys: list[str], cols: list[str], rows: int):
    """Columns as arrays, of about ``rows`` rows and never a part of a group; rows come sorted by ``keys``."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            held.append([np.asarray(b[c]) for c in cols])
        if sum(len(x[0]) for x in held) >= rows:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.flatnonzero(_first(*whole[: len(keys)]))[-1])  # the last group may go on
            if last:
                yield [x[:last] for x in whole]
            held = [[x[last:] for x in whole]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _cells(cls: Column, common: Column, size: Column, n_common: Column) -> Column:
    """Where a row of a slice group is compared: array of (p, side); in a cell with two sides only rows of different sides meet.

    A small group is one cell. In a large one, rows of the commonest root do not meet each other: each is dealt to one
    cell (p < 0), and only the others, its outliers, are copied to all of these. Outliers meet each other in cells
    (x, y) of their blocks, x <= y.
    """
    whole = size <= GROUP_ROWS
    inner, outer = (F.greatest(F.ceil(n / GROUP_ROWS), F.lit(1)).cast("int") for n in (n_common, size - n_common))
    cell = lambda p, side: F.struct(p.cast("int").alias("p"), side.cast("int").alias("side"))
    mine = F.pmod(F.xxhash64(cls), outer).cast("int")
    met = F.transform(F.sequence(F.lit(0), outer - 1), lambda y: cell(F.least(mine, y) * outer + F.greatest(mine, y), mine))
    copied = F.transform(F.sequence(F.lit(1), inner), lambda x: cell(-x, F.lit(1)))
    once = F.array(cell(-1 - F.pmod(F.xxhash64(cls), inner), F.lit(0)))
    return F.when(whole, F.array(cell(F.lit(0), F.lit(0)))).when(common, once).otherwise(F.concat(met, copied))


def _open_roots(groups: DataFrame, sketches: DataFrame, roots: DataFrame, pct: int) -> DataFrame:
    """(a, b): pairs of different roots that classes of one slice group may link; they connect all roots that may be linked."""
    here = groups.join(roots, "cls").select("k", "cls", "part", "root")
    # A group's commonest root, from sums; groups of one root have nothing to add.
    of_group = here.groupBy("k", "root").agg(F.count("*").alias("n")).groupBy("k").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top"))
    of_group = of_group.filter("roots > 1").select("k", "size", F.col("top.root").alias("common"), F.col("top.n").alias("n_common"))
    here = cut(here.join(of_group, "k"), "open").join(sketches, ["cls", "part"])
    dealt = here.select("k", F.explode(_cells(F.col("cls"), F.col("root") == F.col("common"), F.col("size"), F.col("n_common"))).alias("c"), "root", "n", "parts", *SKETCH)
    dealt = dealt.select("k", F.col("c.p").alias("p"), F.col("c.side").alias("side"), "root", "n", "parts", *SKETCH)

    def run(batches):
        for k, p, side, root, n, parts, *sketch in _whole_groups(batches, ["k", "p"], ["k", "p", "side", "root", "n", "parts", *SKETCH], 50_000):
            g = np.cumsum(_first(k, p))
            a, b = roots_that_may_link(g, side, root, n, parts, np.stack(sketch, axis=1).view(np.uint64), pct)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.repartition("k", "p").sortWithinPartitions("k", "p").mapInArrow(run, "a long, b long").distinct()


def links_across(root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """(root, root) of similar sets, only those that join two components; exact, on whole sets."""
    if len(set(root.tolist())) < 2:
        return []
    names, of, times = np.unique(root, return_inverse=True, return_counts=True)
    label, common = np.arange(len(names)), int(times.argmax())
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    held, two, out = np.zeros(int(ids.max()) + 1, bool), len(set(side.tolist())) > 1, []
    for i in np.flatnonzero(of != common):
        other = (label[of] != label[of[i]]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * pct)
        if two:
            other &= side != side[i]
        if not other.any():
            continue
        mine = ids[ends[i] - n[i] : ends[i]]
        held[mine] = True
        both = np.add.reduceat(held[ids], ends - n, dtype=np.int64)
        held[mine] = False
        for j in np.flatnonzero(other & (both * 100 >= (n + n[i] - both) * pct)):
            a, b = label[of[i]], label[of[j]]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                out.append((int(root[i]), int(root[j])))
    return out


def _closing_links(members: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """members (q, root, cls, n) of clusters q, sets (cls, s) -> (a, b): roots that some link joins."""
    by_root = members.groupBy("q", "root").agg(F.sum("n").alias("w"))
    by_q = by_root.groupBy("q").agg(F.max(F.struct("w", "root")).alias("top"), F.sum("w").alias("all"))
    # The largest component of a large cluster is only compared with the others.
    small = F.col("all") <= CLUSTER_SHINGLES
    rest = F.when(small, F.col("all")).otherwise(F.col("all") - F.col("top.w"))
    by_q = by_q.select(
        "q", F.when(~small, F.col("top.root")).alias("top"), F.ceil(rest / CLUSTER_SHINGLES).cast("int").alias("nx"),
        F.when(small, 0).otherwise(F.ceil(F.col("top.w") / CLUSTER_SHINGLES)).cast("int").alias("ny"),
    )
    m = members.join(by_q, "q").withColumn("is_top", F.coalesce(F.col("root") == F.col("top"), F.lit(False)))
    h = F.xxhash64("cls")
    m = m.withColumn("mine", F.when(F.col("is_top"), F.col("nx") + F.pmod(h, F.greatest("ny", F.lit(1)))).otherwise(F.pmod(h, F.col("nx"))).cast("int"))
    xs = F.sequence(F.lit(0), F.col("nx") - 1)
    task = lambda z: F.struct(F.least("mine", z).alias("x"), F.greatest("mine", z).alias("y"))
    ys = F.when(F.col("is_top") | (F.col("ny") == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.col("nx"), F.col("nx") + F.col("ny") - 1))
    m = m.select("q", "cls", "root", "mine", F.explode(F.transform(F.concat(xs, ys), task)).alias("t")).select("q", "t.x", "t.y", "cls", "root", "mine")
    dealt = m.join(sets, "cls").select("q", "x", "y", "root", "mine", "s")

    def run(batches):
        now, held = None, []
        for b in batches:
            keys = zip(b["q"].to_pylist(), b["x"].to_pylist(), b["y"].to_pylist(), strict=True)
            for i, key in enumerate(keys):
                if key != now and held:
                    yield _links(held)
                    held = []
                now = key
                held.append((b["root"][i].as_py(), b["mine"][i].as_py(), np.asarray(b["s"][i].values)))
        if held:
            yield _links(held)

    def _links(held):
        root, side = (np.array([h[i] for h in held]) for i in (0, 1))
        found = links_across(root, side, [h[2] for h in held], pct)
        return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.repartition("q", "x", "y").sortWithinPartitions("q", "x", "y").mapInArrow(run, "a long, b long")


def _sets_of(wanted: DataFrame, texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cls, s) of the classes ``wanted``, each from one of its texts."""
    rows = cut(classes.join(wanted, "cls", "left_semi").select(F.col("r.doc_id").alias("w_id"), F.col("r.th").alias("w_th")), "wanted")
    near = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    chosen = texts.join(near, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")), "left_semi")
    return cut(_sets(chosen, words).dropDuplicates(["cls"]), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, words: int, pct: int) -> DataFrame:
    """The pairs whose whole sets are similar."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), texts, classes, words)
    a = sets.select(F.col("cls").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("cls").alias("b"), F.col("s").alias("sb"))
    na, nb, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(a, "a").join(b, "b").withColumn("i", both)
    return cut(found.filter(F.col("i") * 100 >= (na + nb - F.col("i")) * pct).select("a", "b"), "links")


def _elected(groups: DataFrame, sketches: DataFrame, pct: int) -> DataFrame:
    """(a, b): each class with the centre it shares most slices with, if their sketches allow a link."""
    votes = groups.filter("cls <> lo").groupBy("cls", "lo", "part").agg(F.count("*").alias("votes"))
    best = votes.groupBy("cls").agg(F.max(F.struct("votes", "lo", "part")).alias("v")).select("cls", F.col("v.lo").alias("lo"), F.col("v.part").alias("part"))
    other = sketches.select(F.col("cls").alias("lo"), "part", F.col("n").alias("n2"), *[F.col(c).alias(f"{c}b") for c in SKETCH])
    both = best.join(sketches, ["cls", "part"]).join(other, ["lo", "part"])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}b"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"{SKETCH[0]}b"))))
    fit = (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * pct) & (apart * (100 + pct) * F.col("parts") <= (F.col("n") + F.col("n2")) * (100 - pct))
    return both.filter(fit).select(F.col("cls").alias("a"), F.col("lo").alias("b"))


def ngram_components(docs: DataFrame, words: int = 4, pct: int = 85) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls, root (class that stands for its component) and component_id of every row of ``docs``."""
    texts = docs.select("doc_id", text_or_empty("text").alias("text"), F.xxhash64(text_or_empty("text")).alias("th"))
    members = cut(_members(texts, words, pct), "members")
    full = members.filter("n_shingles > 0")
    # One row a class, with one of its texts to make the set from: copies are added up here, before any join.
    one = F.min(F.struct("doc_id", "th")).alias("r")
    classes = cut(full.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), one), "classes")
    sketches = full.select("cls", F.col("n_shingles").alias("n"), F.explode("sketches").alias("x")).select("cls", "n", "x.*").dropDuplicates(["cls", "part"])
    sketches = cut(sketches, "sketches")
    # Keys that more than one class has, from sums by key: copies of a text, and keys that are everywhere, shrink before they are shuffled.
    slices = cut(_slices(texts, words, pct), "slices")
    # They are written, so that the shuffle of the sums is gone before the join, and the join can split a frequent key.
    shared = cut(slices.groupBy("k").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("k", "lo"), "shared")
    groups = cut(slices.join(shared, "k").select("k", "cls", "part", "lo").distinct(), "groups")
    pairs = cut(_elected(groups, sketches, pct), "pairs")
    links = _verified(pairs, texts, classes, words, pct)
    placed = _placed(classes.select("cls", "first_id", "n", F.col("cls").alias("root")), links)
    open_ = cut(_open_roots(groups, sketches, placed.select("cls", "root"), pct), "may-link")
    if not open_.isEmpty():
        clusters = connected_components(open_).select(F.col("node").alias("root"), F.col("root").alias("q"))
        in_clusters = cut(placed.join(clusters, "root").select("q", "root", "cls", "n"), "clusters")
        sets = _sets_of(in_clusters.select("cls"), texts, classes, words)
        placed = _placed(placed, cut(_closing_links(in_clusters, sets, pct).distinct(), "links"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = placed.select("cls", "root").join(least, "root")
    return members.drop("sketches").join(of_class, "cls", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    )


def _placed(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (cls, root, ...) after joining the roots that ``links`` (a, b) join."""
    joined = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("__r"))
    return cut(placed.join(joined, "root", "left").withColumn("root", F.coalesce("__r", "root")).drop("__r"), "placed")


def keep_one(docs: DataFrame, words: int = 5, pct: int = 80) -> DataFrame:
    """The documents with only one of each component, of least id (null last), then least text hash; textless ones all stay.

    Components count, not their ids: where ids repeat, one document of each component stays.
    """
    found = ngram_components(docs, words, pct).filter("n_shingles > 0")
    rows = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n")).alias("r"))
    kept = cut(kept.select(F.col("r.doc_id").alias("__id"), F.col("r.th").alias("__th"), F.col("r.n").alias("n")), "kept")
    # One struct holds the helper values, so columns of the same names stay as they are.
    t = text_or_empty("text")
    whole = docs.select(F.struct(*docs.columns).alias("d"), F.col("doc_id").alias("id"), F.xxhash64(t).alias("h"), F.length(F.btrim(t, F.lit(WS_CHARS))).alias("n"))
    some = whole.filter("n > 0").join(kept.drop("n"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__th")), "left_semi")
    if not kept.filter("n > 1").isEmpty():  # rows with one id and equal words: only then they need sorting out
        some = some.dropDuplicates(["id", "h"])
    return some.select("d.*").unionByName(whole.filter("n = 0").select("d.*"))


def op2_ngram_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_components(docs).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES = {
    "op2_ngram_join": r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[p:p+3], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) p from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
i as (select x.doc_id a, y.doc_id b, count(*) i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from i join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * i >= 85 * (na.n + nb.n - i)),
r as (select doc_id, doc_id c from d union select e.b, r.c from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.c)::bigint component_id
from d left join n using (doc_id) join r using (doc_id) group by 1
"""
}
