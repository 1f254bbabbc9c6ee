"""Structure scan and parent/child chunks. Sequential within a document, so one Arrow pass over documents."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

FENCE = re.compile(r"^\s*(```+|~~~+)")
HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")


@dataclass(frozen=True)
class Sizes:
    """Signs: wanted and largest parent, wanted and largest child, overlap of children."""

    parent: int = 1800
    parent_max: int = 2400
    child: int = 420
    child_max: int = 800
    overlap: int = 80


def blocks(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, heading path) of headings, fenced code and paragraphs."""
    out, at, open_, fence, path = [], 0, None, None, []

    def close(end):
        nonlocal open_
        if open_ is not None and text[open_[1] : end].strip():
            body = text[open_[1] : end]
            out.append((open_[0], open_[1], open_[1] + len(body.rstrip()), " > ".join(p for _, p in path)))
        open_ = None

    for line in text.split("\n"):
        mark, head = FENCE.match(line), HEADING.match(line)
        if fence:
            if mark and mark[1].startswith(fence):
                close(at + len(line))
                fence = None
        elif mark:
            close(at)
            open_, fence = ("code", at), mark[1]
        elif head:
            close(at)
            path = [p for p in path if p[0] < len(head[1])] + [(len(head[1]), head[2])]
            out.append(("heading", at, at + len(line.rstrip()), " > ".join(p for _, p in path)))
        elif not line.strip():
            close(at)
        elif open_ is None:
            open_ = ("paragraph", at)
        at += len(line) + 1
    close(len(text))
    return out


def cuts(text: str, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` signs, cut after the last line, sentence or word in their second half."""
    out = []
    while end - start > size:
        half, stop = start + size // 2, start + size
        at = text.rfind("\n", half, stop) + 1
        if not at:
            at = max((m.end() for m in re.finditer(r"[.!?。！？]\s?", text[half:stop])), default=-half) + half
        at = at or text.rfind(" ", half, stop) + 1 or stop
        out.append((start, at))
        start = at
    if start < end:
        out.append((start, end))
    return out


def pack(ranges: list[tuple[int, int]], want: int, most: int) -> list[tuple[int, int]]:
    """Neighbouring ranges together while they stay within ``want``; none over ``most``."""
    out: list[tuple[int, int]] = []
    for a, z in ranges:
        if out and z - out[-1][0] <= want <= most:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def parents(text: str, s: Sizes = Sizes()) -> list[tuple[int, int]]:
    pieces = [p for _, a, z, _ in blocks(text) for p in cuts(text, a, z, s.parent)]
    return pack(pieces, s.parent, s.parent_max)


def children(text: str, parent: tuple[int, int], s: Sizes = Sizes()) -> list[tuple[int, int]]:
    """Ranges within a parent; each but the first begins up to ``overlap`` signs early, at a word."""
    base = pack(cuts(text, *parent, s.child), s.child, s.child_max)
    out = []
    for i, (a, z) in enumerate(base):
        if i:
            early = max(parent[0], a - s.overlap)
            space = text.find(" ", early, a)
            a = space + 1 if 0 <= space < a else a
        out.append((a, z))
    return out


def _id(level: str, doc, a: int, z: int, body: str) -> str:
    text_hash = hashlib.sha256(body.strip().encode()).hexdigest()
    return f"{level[0]}_" + hashlib.sha256("\0".join(["tarnweave-1", level, str(doc), f"{a}:{z}", text_hash]).encode()).hexdigest()[:24]


def _rows(docs: DataFrame, make, schema: str, kinds: list) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                rows += make(doc, text or "")
                if len(rows) > 5000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def extract_blocks(docs: DataFrame) -> DataFrame:
    make = lambda doc, t: [(doc, i, *b, t[b[1] : b[2]]) for i, b in enumerate(blocks(t))]
    i, s = pa.int64(), pa.string()
    return _rows(docs, make, "doc_id long, idx long, kind string, char_start long, char_end long, heading_path string, text string", [i, i, s, i, i, s, s])


def chunk_parents(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    make = lambda doc, t: [(_id("parent", doc, a, z, t[a:z]), doc, i, a, z, t[a:z]) for i, (a, z) in enumerate(parents(t, sizes))]
    i, s = pa.int64(), pa.string()
    return _rows(docs, make, "parent_id string, doc_id long, idx long, char_start long, char_end long, text string", [s, i, i, i, i, s])


def chunk_children(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    def make(doc, t):
        out = []
        for p in parents(t, sizes):
            pid = _id("parent", doc, *p, t[p[0] : p[1]])
            for a, z in children(t, p, sizes):
                out.append((_id("child", doc, a, z, t[a:z]), pid, doc, len(out), a, z, t[a:z]))
        return out

    i, s = pa.int64(), pa.string()
    return _rows(docs, make, "chunk_id string, parent_id string, doc_id long, idx long, char_start long, char_end long, text string", [s, s, i, i, i, i, s])
