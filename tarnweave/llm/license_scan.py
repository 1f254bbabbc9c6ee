"""License scans: fuzzy search of short notices (operator 6).

A notice may occur with up to k edits. Cut into k + 1 pieces, one piece occurs
unchanged in any such occurrence: exact searches for the pieces give candidate
places, and the ``regex`` library's bounded-error matching verifies each one and
reports its span and edits. Besides, short phrases are found exactly.

Texts are compared as their words (A-Z lower-cased, all other ASCII but a-z and
0-9 is a separator), one space between two.

An occurrence is a stretch of the text within k edits of the notice. Occurrences of one
notice that overlap count once: the search goes on behind the one just found.

Cases: null and empty texts have no words, labels or spans and score 0; a phrase
that occurs several times counts each time; repeated rows agree; extra columns
are not touched. The cost of a text is in proportion to its length and hits.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import text_chunks
from .common import text_or_empty

#: Phrases and labels; fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings and references of public licence notices, as words, and labels; fixed values.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "use of this source code is governed by an mit style license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license": "apache",
    "licensed under the gnu general public license version": "gpl",
    "it under the terms of the gnu general public license as published by": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "it under the terms of the gnu lesser general public license as published by": "lgpl",
    "it under the terms of the gnu affero general public license as published by": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "use of this source code is governed by a bsd style license": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "boost software license version 1 0": "boost",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document": "wtfpl",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this font software is licensed under the sil open font license": "ofl",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license": "gfdl",
    "licensed under the python software foundation license": "psf",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial": "cc-by-nc",
    "this work is licensed under a creative commons attribution": "cc-by",
    "to the extent possible under law has waived all copyright and related": "cc0",
    "this work is in the public domain": "public-domain",
    "all rights reserved no part of this": "proprietary",
    "unauthorized copying of this file via any medium is strictly prohibited": "proprietary",
    "this material may not be published broadcast rewritten or redistributed": "proprietary",
}
_MAP = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Notice:
    def __init__(self, text: str, label: str, errors_pct: int):
        self.text, self.label, self.k = text.encode(), label, max(1, len(text) * errors_pct // 100)
        size = -(-len(text) // (self.k + 1))
        self.seeds = [(i, self.text[i : i + size]) for i in range(0, len(text), size)]
        self.fuzzy = regex.compile(b"(?e)(?:%s){e<=%d}" % (regex.escape(self.text, special_only=True), self.k))

    def places(self, norm: bytes, windows: list[int]):
        """(start, end, edits) of the verified occurrences in ``windows``, without overlaps, by start."""
        spans, ends = [], 0
        for a in sorted(set(windows)):
            # A seed's window holds every occurrence it can belong to, less what is taken.
            m = self.fuzzy.search(norm, max(a, ends), a + len(self.text) + 3 * self.k + 1)
            if m and m.end() > ends:
                spans.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                ends = m.end()
        return spans


class Notices:
    """All notices, with one automaton over their seeds: a text is read once however many there are."""

    def __init__(self, notices: dict[str, str], errors_pct: int):
        self.all = [Notice(t, label, errors_pct) for t, label in notices.items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.all):
            for offset, seed in n.seeds:
                seeds.setdefault(seed.decode("latin-1"), []).append((i, offset + len(seed) + n.k - 1))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, uses)
        if seeds:
            self.automaton.make_automaton()

    def places(self, norm: bytes):
        """(start, end, notice, edits) of all verified occurrences."""
        windows: dict[int, list[int]] = {}
        if len(self.automaton):
            for end, uses in self.automaton.iter(norm.decode("latin-1")):
                for i, back in uses:
                    windows.setdefault(i, []).append(max(0, end - back))
        return [(a, z, self.all[i], e) for i, w in windows.items() for a, z, e in self.all[i].places(norm, w)]


def scan_text(words: list[bytes], notices: Notices) -> dict | None:
    norm = b" ".join(words)
    base, spans = [], []
    starts = None  # where each word starts in norm

    def word(at: int) -> int:
        nonlocal starts
        if starts is None:
            starts = np.r_[0, np.flatnonzero(np.frombuffer(norm, np.uint8) == 32) + 1]
        return int(np.searchsorted(starts, at, side="right")) - 1

    if b"license" in norm:
        framed = b" " + norm + b" "
        for phrase, label in PHRASES.items():
            p = b" " + phrase.encode() + b" "
            at = framed.find(p)
            while at >= 0:
                base.append((word(at), label))
                at = framed.find(p, at + 1)
    for a, z, n, e in notices.places(norm):
        spans.append((word(a), word(z - 1), n.label, e, 1.0 - e / len(n.text)))
    return {"base": base, "spans": sorted(spans)} if base or spans else None


def scan_licenses(docs: DataFrame, errors_pct: int = 5) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels, score, and the spans of the notices found.

    spans: array of (first_word, last_word, label, edits), by first word. One pass, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,last_word:long,label:string,edits:long>>"
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))

    def run(batches):
        notices = Notices(NOTICES, errors_pct)
        for batch in batches:
            out = {"n_words": np.zeros(batch.num_rows, np.int64)}
            more = []
            for row, data, offsets in text_chunks(batch["text"]):
                buf = data.tobytes().translate(_MAP)
                for i in range(len(offsets) - 1):
                    words = buf[offsets[i] : offsets[i + 1]].split()
                    out["n_words"][row + i] = len(words)
                    r = scan_text(words, notices)
                    if r is None:
                        more.append((0, None, None, "", "", 0.0, []))
                        continue
                    places = [p for p, _ in r["base"]]
                    base = {x for _, x in r["base"]}
                    labels = base | {s[2] for s in r["spans"]}
                    score = 1.0 if base else max(s[4] for s in r["spans"])
                    spans = [{"first_word": s[0], "last_word": s[1], "label": s[2], "edits": s[3]} for s in r["spans"]]
                    more.append((len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            cols = list(zip(*more, strict=True)) if more else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span_type]
            yield pa.record_batch(
                [batch["doc_id"], pa.array(out["n_words"]), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, schema)


def op6_license_scan(spark, sf_dir):
    """The spans as text: label:first_word:last_word:edits, comma-joined."""
    said = F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["first_word"], x["last_word"], x["edits"]))
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("spans", F.array_join(said, ","))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES = {}
