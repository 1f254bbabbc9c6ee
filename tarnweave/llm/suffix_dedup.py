"""Repeated-substring removal over a content-defined cover (operator 4).

This is the dealt method with a departure that the README gives figures for: samples are
not residues of a difference cover, and no suffix array is built. Only the first ``span``
bytes of a suffix matter here, so suffixes need names that are equal where those bytes
are, and no order.

A cover is a set of sample places such that any two equal strings meet at a sample at one
common offset. Here it is content-defined: of the ``span - gram + 1`` grams in a string,
the one with the least hash is its sample. Equal strings choose the same one, and about 1
in 33 places is sampled.

1. Samples: each with the bytes before it and the bytes after it that its strings
   reach, as (gram, whole context) names, grouped by gram.
2. A gram that occurs once ends there: its strings repeat nothing. Where contexts
   are equal, all strings of the later sample repeat. What is left has a common gram but
   another context.
3. Remaining strings: those of the samples left, one for each start, are named in full
   and grouped by name.
4. Of equal names all but the first one, by (document, place), repeat.

Names are 64-bit (samples) and 96-bit (strings) hashes of the bytes. Equal texts
are one class before all this, so groups of copies cost one row each.

Cases: null text is empty; a text under ``span`` bytes loses nothing; matches never
cross documents; a null ``doc_id`` counts as later than all others, and so does one
of two different texts with one id; rows equal in id and text count as one document
and agree; other columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewords import CHUNK, mix, text_chunks
from .common import built_in_memory, cut, hash_pair, text_or_empty

SPAN, GRAM = 100, 36
BROADCAST_ROWS = 500_000

_RNG = np.random.Generator(np.random.PCG64(424242))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * CHUNK, 1 << (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(made)
    return _POWERS[size]


class Prefixes:
    """Hash of any stretch of a byte array from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def samples(data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """(text, place, reach, more, gram name, context name) of the samples of all strings.

    Strings start at place - reach, ..., place - reach + more, within their text.
    """
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none, none, none
    hashes = Prefixes(data)
    at = np.arange(len(data) - gram + 1)
    name = hashes.of(at, at + gram)
    low = (name >> np.uint64(32)) << np.uint64(32) | at.astype(np.uint64)
    wide, reach = span - gram + 1, 1
    while reach * 2 <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + span <= offsets[text + 1])
    if not len(start):
        return none, none, none, none, none, none
    place, text = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64), text[start]
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    tail = np.r_[head[1:], len(start)] - 1
    first, last, place, text = start[head], start[tail], place[head], text[head]
    context = mix(hashes.of(first, last + span) + ((place - first) * 1024 + last - first).astype(np.uint64))
    return text, place - offsets[text], place - first, last - first, name[place], context


def _sampled(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(g, c, did, p): p packs place, reach and more."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b["did"])
            for row, data, offsets in text_chunks(b["text"]):
                text, place, reach, more, name, context = samples(data, offsets, span, gram)
                for i in range(0, len(text), 200_000):
                    s = slice(i, i + 200_000)
                    yield pa.record_batch(
                        [
                            pa.array(name[s].view(np.int64)), pa.array(context[s].view(np.int64)), pa.array(ids[row + text[s]]),
                            pa.array(place[s] << 20 | reach[s] << 10 | more[s]),
                        ],
                        ["g", "c", "did", "p"],
                    )

    return texts.mapInArrow(run, "g long, c long, did long, p long")


def _strings(open_texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(s, x, did, i): the name of every string of the listed samples, by its start i."""

    def run(batches):
        for b in batches:
            ids, lists = np.asarray(b["did"]), b["ps"]
            for row, data, offsets in text_chunks(b["text"]):
                part = lists.slice(row, len(offsets) - 1)
                p = np.asarray(part.flatten())
                n = np.asarray(part.value_lengths())
                text = np.repeat(np.arange(len(n)), n)
                hashes = Prefixes(data)
                place, reach, more = (p >> 20) + offsets[text], p >> 10 & 1023, (p & 1023) + 1
                name = hashes.of(place, place + gram)
                start = np.repeat(place - reach - np.r_[0, np.cumsum(more)[:-1]], more) + np.arange(more.sum())
                of = np.repeat(np.arange(len(p)), more)
                for i in range(0, len(start), 200_000):
                    s, o = start[i : i + 200_000], of[i : i + 200_000]
                    x = mix(name[o] + (place[o] - s).astype(np.uint64)) >> np.uint64(32)
                    yield pa.record_batch(
                        [
                            pa.array(hashes.of(s, s + span).view(np.int64)), pa.array(x.astype(np.uint32).view(np.int32)),
                            pa.array(ids[row + text[o]]), pa.array((s - offsets[text[o]]).astype(np.int32)),
                        ],
                        ["s", "x", "did", "i"],
                    )

    return open_texts.select("did", "text", "ps").mapInArrow(run, "s long, x int, did long, i int")


def cut_spans(raw: bytes, starts: np.ndarray, span: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, bytes left)."""
    if not len(starts):
        return 0, 0, raw
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _apply(marked: DataFrame, span: int) -> DataFrame:
    """(did, n_removed, n_spans, kept)."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            size = 0
            for did, text, singles, runs in zip(b["did"], b["text"], b["singles"], b["runs"], strict=True):
                raw = text.as_py().encode()
                s = np.asarray(singles.values if singles.is_valid else [], np.int64)
                p = np.asarray(runs.values if runs.is_valid else [], np.int64)
                more = (p & 1023) + 1
                first = (p >> 20) - (p >> 10 & 1023)
                every = np.repeat(first - np.r_[0, np.cumsum(more)[:-1]], more) + np.arange(more.sum()) if len(p) else p
                for o, v in zip(out, (did.as_py(), *cut_spans(raw, np.r_[s, every].astype(np.int64), span)), strict=True):
                    o.append(v)
                size += len(raw)
                if size > CHUNK:
                    yield _batch(out)
                    out, size = [[], [], [], []], 0
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["did", "n_removed", "n_spans", "kept"])

    return marked.select("did", "text", "singles", "runs").mapInArrow(run, "did long, n_removed long, n_spans long, kept binary")


def _first_only(rows: DataFrame, name: list[str], place: list[str]) -> DataFrame:
    """``rows`` with ``__first``: whether a row stands at the first place of its name."""
    w = W.partitionBy(*name).orderBy(*place)
    return rows.withColumn("__first", F.first(F.struct(*place)).over(w) == F.struct(*place))


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left) of every document."""
    t = text_or_empty("text")
    h1, h2 = hash_pair(t)
    rows = docs.select("doc_id", t.alias("text"), h1.alias("t1"), h2.alias("t2"))
    members = cut(rows.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes")), "spans-members")
    # One document for each text, the first; did is its order among all and its key.
    texts = members.groupBy("t1", "t2", "n_bytes").agg(F.min("doc_id").alias("ord"))
    # Texts without an id need no turn, so they are dealt by their hash.
    turn = F.row_number().over(W.partitionBy("ord", F.when(F.col("ord").isNull(), F.col("t1"))).orderBy("t1", "t2"))
    late = F.xxhash64("t1", "t2").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    texts = cut(texts.withColumn("did", F.when(F.col("ord").isNotNull() & (turn == 1), F.col("ord").cast("long")).otherwise(late)), "spans-texts")
    key = texts.select(F.col("ord").alias("k_id"), F.col("t1").alias("k1"), F.col("t2").alias("k2"), "did")
    key = F.broadcast(key) if key.count() <= BROADCAST_ROWS else key
    firsts = rows.join(
        key, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    ).select("did", "text")
    by_gram = W.partitionBy("g").orderBy("c", "did", "p")
    named = _sampled(firsts.filter(F.octet_length("text") >= span), span, gram).withColumns(
        {"before": F.lag("g").over(by_gram), "after": F.lead("g").over(by_gram)}
    )
    named = _first_only(named.filter("before is not null or after is not null").select("g", "c", "did", "p"), ["g", "c"], ["did", "p"])
    # The first of its context is open unless all samples of the gram have that context.
    wide = W.partitionBy("g")
    named = named.withColumns({"c0": F.min("c").over(wide), "c1": F.max("c").over(wide)})
    named = named.filter("not __first or c0 <> c1").select("did", "p", (~F.col("__first")).alias("repeats"))
    named = cut(named, "spans-named")
    open_ = named.filter("not repeats").groupBy("did").agg(F.collect_set("p").alias("ps"))
    strings = _strings(firsts.join(built_in_memory(open_, 32 * named.filter("not repeats").count()), "did"), span, gram)
    again = cut(_first_only(strings, ["s", "x"], ["did", "i"]).filter("not __first").select("did", "i"), "spans-again")
    marks = (
        again.groupBy("did").agg(F.collect_set("i").alias("singles"))
        .join(named.filter("repeats").groupBy("did").agg(F.collect_set("p").alias("runs")), "did", "full")
    )
    size = 32 * (again.count() + named.filter("repeats").count())
    done = _apply(firsts.join(built_in_memory(marks, size), "did", "left"), span).dropDuplicates(["did"])
    out = members.join(texts.select("t1", "t2", "ord", "did"), ["t1", "t2"]).join(done, "did")
    copy = ~F.col("doc_id").eqNullSafe(F.col("ord")) & (F.col("n_bytes") >= span)
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op4_suffix_dedup(spark, sf_dir):
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES = {
    "op4_suffix_dedup": """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) h from documents),
b as (select doc_id, h, len(h) // 2 n, unnest(range(0, len(h) // 2)) j from d),
w as (select doc_id, j, substr(h, 2 * j + 1, 2) c, case when j + 100 <= n then md5_number(substr(h, 2 * j + 1, 200)) end s from b),
r as (select *, s is not null and (doc_id, j) <> min((doc_id, j)) over (partition by s) again from w),
g as (select *, coalesce(max(again::int) over (partition by doc_id order by j rows between 99 preceding and current row), 0) = 1 gone from r),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by j), false) opens from g),
a as (select doc_id, (count(*) filter (where gone))::bigint n_removed, (count(*) filter (where opens))::bigint n_spans, string_agg(c, '' order by j) filter (where not gone) k from e group by 1)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(k, ''))) kept_sha256
from d left join a using (doc_id)
"""
}
