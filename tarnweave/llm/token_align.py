"""Cross-tokenizer alignment by elementary intervals (operator 12).

Two vocabularies cut the same bytes. The ends of both, united and sorted, bound the elementary
intervals; ``searchsorted`` gives each interval its owner on either side. As no end lies inside
an interval, each one is the overlap of one token pair, and each overlapping pair has one. An end that
both have closes a group; the product of a group's sizes says how many pairs it would expand to.

How often the corpus links an id pair is counted from blocks: a block is some
``BLOCK`` links of whole documents, in which equal pairs are one row with a number. Blocks are written once.
Their pairs are added up by pair, each pair is compared with the highest count of its B id
(at most as many rows as vocabulary A has), and the counts return to the blocks, where numbers that
documents keep for their pairs point at them. So a pair that is everywhere is one row a block,
and no row is a single link.

Cases: a text that is null, empty, or not given back byte for byte by both vocabularies has no tokens: zeros
and an empty string of groups; repeated rows agree, and each counts in the corpus; a very long text is a block
of its own; an empty table gives no rows; a null id stays; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .vocab import Vocabulary, tokenizer_path, vocabulary

#: Code points encoded at once, and links of a block; only a longer text goes beyond.
SLICE, BLOCK = 1 << 19, 1 << 21
_TOTALS = ["n_a", "n_b", "n_groups", "n_links", "n_products"]


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner in A, owner in B, does it close a group) of every elementary interval, in order.

    Both end arrays rise strictly and have the same last entry.
    """
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


class Aligned:
    """The texts of a slice, one behind the other; ends never fall together across texts as each text is whole on both sides."""

    def __init__(self, texts: list[str], va: Vocabulary, vb: Vocabulary):
        ids_a, ids_b, self.at = [], [], []
        put = [i for i, t in enumerate(texts) if t]
        for i, a, b in zip(put, va.encode([" " + texts[i] for i in put]), vb.encode([texts[i] for i in put]), strict=True):
            a, b, want = np.array(a, np.int64), np.array(b, np.int64), (" " + texts[i]).encode()
            if b"".join(va.bytes[a]) == want == b"".join(vb.bytes[b]):
                self.at.append(i)
                ids_a.append(a)
                ids_b.append(b)
        self.n_a, self.n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        none = np.zeros(0, np.int64)
        self.a, self.b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
        ends_a, ends_b = np.cumsum(va.lengths[self.a]), np.cumsum(vb.lengths[self.b])
        self.of_a, self.of_b, self.closes = elementary(ends_a, ends_b)
        # Where each text's tokens, links and groups end.
        self.end_a, self.end_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.end_link = np.searchsorted(self.of_a, self.end_a)
        closed = np.flatnonzero(self.closes)
        self.group_a, self.group_b = self.of_a[closed] + 1, self.of_b[closed] + 1  # first tokens of the next groups
        self.end_group = np.searchsorted(self.group_a, self.end_a, side="right")
        sizes = np.diff(self.group_a, prepend=0) * np.diff(self.group_b, prepend=0)
        self.products = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, self.end_group)])

    @property
    def pairs(self) -> np.ndarray:
        """Each link's ids: A's in the upper 32 bits, B's in the lower."""
        return (self.a[self.of_a] << 32) | self.b[self.of_b]

    def totals(self) -> dict[str, np.ndarray]:
        size = lambda ends: np.diff(ends, prepend=0)
        return dict(zip(_TOTALS, [self.n_a, self.n_b, size(self.end_group), size(self.end_link), self.products], strict=True))

    def groups(self, names: tuple[np.ndarray, ...]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        a_comma, a_bar, b_comma, b_semi = names
        out = np.empty(len(self.a) + len(self.b), object)
        group_of_a = np.searchsorted(self.group_a, np.arange(len(self.a)), side="right")
        group_of_b = np.searchsorted(self.group_b, np.arange(len(self.b)), side="right")
        # In front of an A token stand the B tokens of the groups before, of a B token the A tokens up to its group.
        at_a = np.arange(len(self.a)) + np.append(0, self.group_b)[group_of_a]
        at_b = np.arange(len(self.b)) + np.append(self.group_a, 0)[group_of_b]
        out[at_a], out[at_b] = a_comma[self.a], b_comma[self.b]
        last_a, last_b = self.group_a - 1, self.group_b - 1
        out[at_a[last_a]], out[at_b[last_b]] = a_bar[self.a[last_a]], b_semi[self.b[last_b]]
        ends = np.append(0, self.end_a + self.end_b).tolist()
        return ["".join(out[s:e].tolist())[:-1] for s, e in zip(ends, ends[1:], strict=False)]


def _names(va: Vocabulary, vb: Vocabulary) -> tuple[np.ndarray, ...]:
    made = lambda v, end: np.array([f"{i}{end}" for i in range(len(v.bytes))], object)
    return made(va, ","), made(va, "|"), made(vb, ","), made(vb, ";")


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > SLICE:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def align_tokens(docs: DataFrame, model_a: str = "byte_bpe_50k.json", model_b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_products, groups, links of every row; one pass, no shuffle.

    groups: the ids of every group as text. links: the id pair of each overlap in order, A's id in the upper 32 bits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        va, vb = vocabulary(tokenizer_path(model_a)), vocabulary(tokenizer_path(model_b))
        names = _names(va, vb)
        for batch in batches:
            for at, texts in _slices(batch["text"].to_pylist()):
                al, n = Aligned(texts, va, vb), len(texts)
                cols = []
                for values in al.totals().values():
                    full = np.zeros(n, np.int64)
                    full[al.at] = values
                    cols.append(pa.array(full))
                groups, lengths = [""] * n, np.zeros(n + 1, np.int32)
                for i, g in zip(al.at, al.groups(names), strict=True):
                    groups[i] = g
                lengths[np.array(al.at, np.int64) + 1] = np.diff(al.end_link, prepend=0)
                links = pa.ListArray.from_arrays(np.cumsum(lengths, dtype=np.int32), pa.array(al.pairs))
                yield pa.record_batch([batch["doc_id"].slice(at, n), *cols, pa.array(groups, pa.string()), links], ["doc_id", *_TOTALS, "groups", "links"])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in _TOTALS)}, groups string, links array<long>"
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, schema)


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, compressed."""
    kind = np.min_scalar_type(int(numbers.max()) if len(numbers) else 0)
    return bytes([kind.itemsize]) + pa.compress(numbers.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    kind = np.dtype(f"<u{data[0]}")
    return np.frombuffer(pa.decompress(data[1:], n * kind.itemsize, codec="zstd"), kind).astype(np.int64)


def _block(links: np.ndarray, lengths: np.ndarray) -> tuple:
    """(distinct pairs, how often each stands, per text: how many of them, packed: their numbers, how often)."""
    pairs, number = np.unique(links, return_inverse=True)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    keys, times = np.unique(doc * len(pairs) + number, return_counts=True)
    doc, number = np.divmod(keys, max(1, len(pairs)))
    kept = np.bincount(doc, minlength=len(lengths)) if len(lengths) else np.zeros(0, np.int64)
    total = np.bincount(number, times, len(pairs)).astype(np.int64)
    # Numbers rise within a text: what is kept is how far each is behind the one before.
    step = np.diff(number, prepend=0)
    first = np.append(0, np.cumsum(kept)[:-1])[kept > 0]
    step[first] = number[first]
    return pairs, total, kept, _packed(step), _packed(times)


def _blocks(aligned: DataFrame) -> DataFrame:
    """Rows of whole documents' links: block, pairs, counts, and of its documents (named as in ``aligned``) columns of arrays."""
    kept = [f for f in aligned.schema if f.name != "links"]
    docs = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept)
    schema = f"block long, pairs array<long>, counts array<long>, docs array<struct<{docs}>>, sizes array<long>, steps binary, times binary"

    def rows(block: int, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        links = table["links"].combine_chunks() if table["links"].num_chunks != 1 else table["links"].chunk(0)
        flat, lengths = links.flatten().to_numpy(), np.diff(links.offsets.to_numpy()).astype(np.int64)
        pairs, total, sizes, steps, times = _block(flat, lengths)
        columns = [table[f.name].combine_chunks() for f in kept]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        held = pa.StructArray.from_arrays(columns, [f.name for f in kept])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.record_batch(
            [pa.array([block]), one(pa.array(pairs)), one(pa.array(total)), one(held), one(pa.array(sizes.astype(np.int64))), pa.array([steps], pa.binary()), pa.array([times], pa.binary())],
            ["block", "pairs", "counts", "docs", "sizes", "steps", "times"],
        )

    def run(batches):
        task, n, parts, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ends = np.cumsum(np.diff(batch["links"].offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                z = max(at + 1, int(np.searchsorted(ends, before + BLOCK - held, side="right")))
                z = min(z, batch.num_rows)
                parts.append(batch.slice(at, z - at))
                held += int(ends[z - 1]) - before
                at = z
                if held >= BLOCK or z < batch.num_rows:
                    yield rows(task << 32 | n, parts)
                    n, parts, held = n + 1, [], 0
        if parts:
            yield rows(task << 32 | n, parts)

    return aligned.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: how many links hold an id pair, and whether no pair of its B id has more."""
    every = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    counts = every.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count"))
    # A B id has no more pairs than vocabulary A has ids.
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counts.withColumn("best", F.col("count") == most)


def score_links(aligned: DataFrame) -> DataFrame:
    """Columns of ``aligned`` but links, with n_best and count_sum: links of a best pair, and the corpus counts of its links added up.

    Two shuffles of a block's distinct pairs: by pair, where they meet their counts, and back by block.
    """
    blocks = cut(_blocks(aligned), "links")
    counts = cut(pair_counts(blocks), "pairs")
    asked = blocks.select(F.col("block").alias("asking"), F.explode("pairs").alias("pair")).join(counts, "pair")
    held = blocks.select("block", "docs", "sizes", "steps", "times")
    kept = [f for f in aligned.schema if f.name != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"

    def join(asked: pa.Table, held: pa.Table) -> pa.Table:
        order = np.argsort(asked["pair"].to_numpy())
        count, best = asked["count"].to_numpy()[order], asked["best"].to_numpy()[order].astype(np.int64)
        sizes = held["sizes"].combine_chunks().flatten().to_numpy()
        docs = held["docs"].combine_chunks().flatten()
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        steps, times = _unpacked(held["steps"][0].as_py(), n), _unpacked(held["times"][0].as_py(), n)
        run = np.cumsum(steps)
        before = np.append(0, run)[ends - sizes]  # what the steps of earlier texts add up to
        number = run - np.repeat(before, sizes)
        add = lambda values: np.diff(np.append(0, np.cumsum(values))[np.append(0, ends)])
        sums = [pa.array(add(times * best[number]).astype(np.int64)), pa.array(add(times * count[number]).astype(np.int64))]
        return pa.table([docs.field(f.name) for f in kept] + sums, [*[f.name for f in kept], "n_best", "count_sum"])

    return asked.groupBy("asking").cogroup(held.groupBy("block")).applyInArrow(join, schema)


def op12_token_align(spark, sf_dir):
    aligned = align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("")
    return score_links(aligned.withColumn("groups_sha256", digest).drop("groups"))


QUERIES = {"op12_token_align": op12_token_align}
ORACLES = {}
