"""Benchmark decontamination by q-gram lemma filtering (operator 7).

Each benchmark item is cut into overlapping windows of ``window`` bytes (a shorter
item is one window). A region of a document leaks a window if their edit distance
is at most k, ``errors_pct`` percent of the window's length. By the q-gram lemma such a
region shares at least m + 1 - q(k + 1) q-grams with the window, all on diagonals
that differ by at most k; shared q-grams are counted in diagonal bands of width 2k
that overlap by k, first for whole items, then for the windows of the bands that reach
the bound, and a banded alignment verifies the windows that reach it. As a phrase that many items
hold reaches the bound everywhere, full bands are looked at once more before anything is aligned: an edit spoils
at most 4 of a window's 4-grams, so if more than 4k of them are missing around the region, by bit sketches of both,
no alignment can be good. Alignments stop when all of a row is over the budget. Windows start
every 2k bytes, so any verbatim stretch of ``window`` bytes of an item is within k edits
of one of them.

Texts are compared as UTF-8 bytes, A-Z lower-cased, runs of white space as one
space. The benchmark is a stated query set: it is handled in blocks of at most
``block_bytes``, each sent to all tasks, so what is broadcast is bounded; each block is
one more scan of the documents.

Cases: null and empty texts and items match nothing. An item shorter than ``min_bytes``
leaks where it stands verbatim between white space or ends of the text, and one shorter
than a q-gram only as a whole text. Repeated rows each give their own result rows; null
ids are carried along; extra columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytewords import _LOWER, _SPACE, text_chunks
from .common import text_or_empty

Q = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
#: Length of the grams that sketches hold, their bits, and how far apart stretches of text are sketched.
_GRAM, _WIDE, _APART = 4, 512, 16
#: Shared q-grams, and bands with windows, that are handled at once.
_HITS, _PAIRS = 1 << 21, 1 << 15


@dataclass(frozen=True)
class LeakRules:
    window: int = 80
    errors_pct: int = 10
    min_bytes: int = 40
    block_bytes: int = 1 << 21


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of white space as one space, trimmed; and the new offsets."""
    low = _LOWER[data]
    space = _SPACE[low]
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = offsets[:-1][offsets[:-1] < len(low)]
    keep[first] = ~space[first]
    low = np.where(space, np.uint8(32), low)
    new = np.r_[0, np.cumsum(keep)][offsets]
    return low[keep], new


def codes(b: np.ndarray) -> np.ndarray:
    """The q-gram at each place as one 64-bit integer (Q is 8 bytes)."""
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def _gram_bits(b: np.ndarray) -> np.ndarray:
    """The sketch's bit of the 4-gram at each place; three places less than bytes."""
    x = b.astype(np.uint32)
    x = x[:-1] | x[1:] << np.uint32(8)
    x = x[:-2] | x[2:] << np.uint32(16)
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(23)).astype(np.int64)


def _sketches(bits: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each row of bits."""
    wide = np.zeros((len(bits), _WIDE), bool)
    wide[np.arange(len(bits))[:, None], bits] = True
    return np.packbits(wide, axis=1).view(np.uint64)


class ItemIndex:
    """The items of a block with an index of their q-grams; short ones in an automaton."""

    def __init__(self, items: list[tuple[object, str]], rules: LeakRules):
        self.item, self.text, size, k, step, short = [], [], [], [], [], {}
        code, of, place = [], [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            b, new = squeeze(raw, np.array([0, len(raw)]))
            b = b[: new[1]]
            b = b[:-1] if len(b) and b[-1] == 32 else b
            if len(b) < rules.min_bytes:
                if len(b):
                    short.setdefault(b.tobytes().decode("latin-1"), []).append(item)
                continue
            size.append(min(rules.window, len(b)))
            k.append(size[-1] * rules.errors_pct // 100)
            step.append(max(1, 2 * k[-1]))
            c = codes(b)
            code.append(c)
            of.append(np.full(len(c), len(self.item), np.int32))
            place.append(np.arange(len(c), dtype=np.int32))
            self.item.append(item)
            self.text.append(b)
        self.size, self.k, self.step = (np.array(x, np.int64) for x in (size, k, step))
        self.need = np.maximum(1, self.size + 1 - Q * (self.k + 1))
        self.length = np.array([len(t) for t in self.text], np.int64)
        #: Added to diagonals so that none is negative.
        self.shift = int(self.length.max(initial=0)) + 1
        code = np.concatenate(code) if code else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.of, self.place = (np.concatenate(x)[order] if x else np.zeros(0, np.int32) for x in (of, place))
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.posting = np.repeat(np.arange(len(self.code)), self.count) * max(1, len(self.item)) + self.of
        self.windows = np.array([-(-int(n - m) // s) + 1 for n, m, s in zip(self.length, self.size, self.step, strict=True)], np.int64)
        self.window_at = np.cumsum(self.windows) - self.windows
        self.sketch = np.concatenate([np.zeros((0, _WIDE // 64), np.uint64), *map(self._sketched, range(len(self.item)))])
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.code * _MUL) >> np.uint64(64 - _BITS)] = True
        self.short = ahocorasick.Automaton()
        for text, ids in short.items():
            self.short.add_word(f" {text} ", (len(text), ids))
        if short:
            self.short.make_automaton()

    def _sketched(self, p: int) -> np.ndarray:
        """The sketches of the windows of an item."""
        starts = np.minimum(np.arange(self.windows[p]) * self.step[p], self.length[p] - self.size[p])
        bits, inside = _gram_bits(self.text[p]), np.arange(self.size[p] - _GRAM + 1)
        rows = [_sketches(bits[starts[i : i + _PAIRS, None] + inside]) for i in range(0, len(starts), _PAIRS)]
        return np.concatenate(rows)

    def hits(self, b: np.ndarray):
        """(place in b, item, place in item) of all shared q-grams, in parts of whole items with some _HITS each."""
        c = codes(b)
        at = np.flatnonzero(self.seen[(c * _MUL) >> np.uint64(64 - _BITS)]) if len(self.code) else np.zeros(0, np.int64)
        if not len(at):
            return
        i = np.searchsorted(self.code, c[at])
        i[i == len(self.code)] = 0
        real = self.code[i] == c[at]
        at, i = at[real], i[real]
        ends = [len(self.item)]
        if self.count[i].sum() > _HITS:
            used, times = np.unique(i, return_counts=True)
            n = self.count[used]
            spread = np.repeat(self.first[used] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            each = np.bincount(self.of[spread], np.repeat(times, n), len(self.item))
            part = np.cumsum(each) // _HITS
            ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), *ends]
        begin = 0
        for end in ends:
            low = np.searchsorted(self.posting, i * len(self.item) + begin)
            n = np.searchsorted(self.posting, i * len(self.item) + end) - low
            spread = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            yield np.repeat(at, n), self.of[spread].astype(np.int64), self.place[spread].astype(np.int64)
            begin = end

    def short_in(self, text: bytes):
        """(item, start) of the short items that stand in a text."""
        if len(self.short) and (text := text.strip(b" ")):
            for end, (n, ids) in self.short.iter(f" {text.decode('latin-1')} "):
                if n >= Q or n == len(text):
                    for item in ids:
                        yield item, end - n - 1


def _align(patterns: np.ndarray, regions: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best occurrence of each pattern in its region, a row for each pair; where that has more than ``budget`` edits, some number above it."""
    places = np.arange(regions.shape[1] + 1, dtype=np.int16)
    edits, end = budget + 1, np.zeros(len(regions), np.int64)
    alive, row = np.arange(len(regions)), np.zeros((len(regions), len(places)), np.int16)
    for i in range(patterns.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (regions != patterns[:, i : i + 1]), row[:, 1:] + np.int16(1), out=new[:, 1:])
        new -= places
        np.minimum.accumulate(new, axis=1, out=new)
        row = np.add(new, places, out=new)
        if i % 8 == 7:  # the least of a row never falls
            good = row.min(axis=1) <= budget[alive]
            if not good.all():
                alive, row, patterns, regions = alive[good], row[good], patterns[good], regions[good]
                if not len(alive):
                    return edits, end
    end[alive] = row.argmin(axis=1)
    edits[alive] = row[np.arange(len(row)), end[alive]]
    return edits, end


def _hopeful(ix: ItemIndex, b: np.ndarray, of: np.ndarray, cell: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which bands have a window that misses few enough 4-grams of the text around it. least, most: places of a band's q-grams in its item."""
    k, bound, last = np.maximum(ix.k[of], 1), _GRAM * ix.k[of], ix.length[of] - ix.size[of]
    low = -(-np.maximum(least + Q - ix.size[of], 0) // ix.step[of])
    high = np.where(most >= last, ix.windows[of] - 1, most // ix.step[of])
    low = np.minimum(low, high)
    wide = int((ix.size + 4 * np.maximum(ix.k, 1)).max()) + _APART
    bits = _gram_bits(np.r_[b, np.zeros(wide + _APART, np.uint8)])
    good = np.zeros(len(of), bool)
    ends = np.cumsum(high - low + 1)
    at = 0
    while at < len(of):
        z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS)))
        times = (high - low + 1)[at:z]
        band = np.repeat(np.arange(at, z), times)
        window = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[band]
        p = of[band]
        start = np.minimum(window * ix.step[p], last[band])
        first = np.clip(cell[band] * k[band] - ix.shift - k[band] + start, 0, len(b)) // _APART
        spots, which = np.unique(first, return_inverse=True)
        around = _sketches(bits[np.minimum(spots[:, None] * _APART + np.arange(wide - _GRAM + 1), len(bits) - 1)])
        missing = np.bitwise_count(ix.sketch[ix.window_at[p] + window] & ~around[which]).sum(axis=1)
        good[band[missing <= bound[band]]] = True
        at = z
    return good


def leaks_in(ix: ItemIndex, b: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, window's start, edits, start, end) of the verified regions of the texts in b."""
    return sorted(x for hits in ix.hits(b) for x in _leaks_of(ix, b, offsets, *hits))


def _leaks_of(ix: ItemIndex, b: np.ndarray, offsets: np.ndarray, at: np.ndarray, of: np.ndarray, place: np.ndarray):
    """The same of some items, from their shared q-grams."""
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + Q <= offsets[doc + 1]
    at, of, place, doc = at[inside], of[inside], place[inside], doc[inside]
    if not len(at):
        return []
    k = np.maximum(ix.k[of], 1)
    # Band j holds the cells j and j + 1: width 2k, neighbours overlap by k. One sortable number for each.
    cell, cells = (at - place + ix.shift) // k, int(len(b) + 2 * ix.shift)
    key = (doc * len(ix.text) + of) * cells + cell
    key = np.r_[key, key - 1]
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    bands, n, places = key[order[first]], np.diff(np.r_[first, len(key)]), np.r_[place, place][order]
    full = n >= ix.need[bands // cells % len(ix.text)]
    least, most = np.minimum.reduceat(places, first)[full], np.maximum.reduceat(places, first)[full]
    bands = bands[full]
    bands = bands[_hopeful(ix, b, bands // cells % len(ix.text), bands % cells, least, most)]
    if not len(bands):
        return []
    band = np.searchsorted(bands, key)  # of each shared q-gram in a full band
    band[band == len(bands)] = 0
    inside = bands[band] == key
    # A q-gram of the item counts once in a band, however often the band of the text repeats it.
    band, place = np.divmod(np.unique(band[inside] * ix.shift + np.r_[place, place][inside]), ix.shift)
    pair, cell = np.divmod(bands, cells)
    doc, of = np.divmod(pair, len(ix.text))
    # The windows that hold a shared q-gram whole: every step-th start, and the last one.
    o = of[band]
    last = ix.length[o] - ix.size[o]
    low = -(-np.maximum(place + Q - ix.size[o], 0) // ix.step[o])
    high = np.minimum(place, last) // ix.step[o]
    times = np.maximum(high - low + 1, 0)
    start = (np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())) * np.repeat(ix.step[o], times)
    tail = (last % ix.step[o] != 0) & (place >= last)
    band, start = np.r_[np.repeat(band, times), band[tail]], np.r_[start, last[tail]]
    key, n = np.unique(band * ix.shift + start, return_counts=True)
    band, start = np.divmod(key, ix.shift)
    full = n >= ix.need[of[band]]
    band, start = band[full], start[full]
    doc, of, cell = doc[band], of[band], cell[band]
    out: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    for m in np.unique(ix.size[of]):
        same = np.flatnonzero(ix.size[of] == m)
        for i in range(0, len(same), 2048):
            t, p, j, w = (x[same[i : i + 2048]] for x in (doc, of, cell, start))
            k = np.maximum(ix.k[p], 1)
            first = j * k - ix.shift - k + w
            spots = first[:, None] + np.arange(m + 4 * int(k.max()))
            valid = (spots >= offsets[t][:, None]) & (spots < offsets[t + 1][:, None])
            regions = np.where(valid, b[np.where(valid, spots, 0)], np.uint8(255))
            edits, end = _align(np.stack([ix.text[x][y : y + m] for x, y in zip(p, w, strict=True)]), regions, ix.k[p])
            for r in np.flatnonzero(edits <= ix.k[p]):
                stop = int(first[r] + end[r] - offsets[t[r]])
                found = (int(edits[r]), max(0, stop - int(m)), stop)
                where = (int(t[r]), int(p[r]), int(w[r]))
                out[where] = min(found, out.get(where, found))
    return [(*where, *x) for where, x in out.items()]


def _found(ix: ItemIndex, texts: pa.Array) -> dict[tuple[int, object], list[tuple[int, int]]]:
    """(row, item) -> (edits, start) of each leaking window."""
    found: dict[tuple[int, object], list[tuple[int, int]]] = {}
    for row, data, offsets in text_chunks(texts):
        b, new = squeeze(data, offsets)
        for t, p, _, edits, start, _ in leaks_in(ix, b, new):
            found.setdefault((row + t, ix.item[p]), []).append((edits, start))
        if len(ix.short):
            for t in range(len(new) - 1):
                for item, start in ix.short_in(b[new[t] : new[t + 1]].tobytes()):
                    found.setdefault((row + t, item), []).append((0, start))
    return found


def _blocks(items, size: int):
    block, n = [], 0
    for r in items:
        block.append((r[0], r[1]))
        n += len((r[1] or "").encode())
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """doc_id, item_id, n_windows, min_edits, first_start: a row for each document and item it leaks.

    Starts are bytes of the squeezed text.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(kind)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, n_windows long, min_edits long, first_start long"
    texts = docs.select("doc_id", text_or_empty("text").alias("text"))
    out = None
    for block in _blocks(benchmark.select("item_id", "text").toLocalIterator(), rules.block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ix = ItemIndex(shared.value, rules)
            for batch in batches:
                found = _found(ix, batch["text"])
                numbers = [(len(v), min(v)[0], min(x[1] for x in v)) for v in found.values()]
                yield pa.record_batch(
                    [
                        batch["doc_id"].take(pa.array([k[0] for k in found], pa.int64())), pa.array([k[1] for k in found], item_type),
                        *(pa.array([n[i] for n in numbers], pa.int64()) for i in range(3)),
                    ],
                    ["doc_id", "item_id", "n_windows", "min_edits", "first_start"],
                )

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """The documents that leak no item, whatever their ids and other columns, as they are.

    Every row is judged where it is; nothing is shuffled.
    """
    for block in _blocks(benchmark.select("item_id", "text").toLocalIterator(), rules.block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ix = ItemIndex(shared.value, rules)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in _found(ix, batch["text"])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir):
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {}
