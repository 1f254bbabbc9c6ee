"""Token counts by a two-tier lookup on the map side (operator 11).

A byte-level tokenizer first cuts a text into pre-tokens, each of which is encoded
alone; so a text's count is the sum of its pre-tokens' counts. The counts of frequent
pre-tokens are broadcast as one compact table: their bytes end to end, where each ends,
and how many tokens it has. Whatever is not in it is encoded by the tokenizer's library, many at
once, and kept in a cache of the worker. No pre-token is shuffled.

Which pre-tokens are frequent is found over all texts by Spark's ``approx_top_k``: every task keeps a
sketch of bounded size, and only sketches move. The table only decides what is quick; counts are exact
whatever is in it. It has at most ``FREQUENT`` entries of at most ``ENTRY_CHARS`` code points, so its size
is bounded by 2 MB however large the input.

Exactness: special strings inside a text are cut out first, as the library does by default, and
are one token each. Texts with code points that have no category in Unicode go to the library whole, as
its tables may be of another version. So do all texts for tokenizers of other kinds.

Cases: null and empty texts have no bytes and no tokens; a very long text is cut where white
space follows a sign, which is always a border of pre-tokens; repeated rows agree; an empty table gives
no rows; null ids stay; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .vocab import is_byte_level, json_tokenizer, piece_tokenizer, split_alike, split_pattern, tokenizer_path

#: Entries of the broadcast table, their length, and items that a sketch follows.
FREQUENT, ENTRY_CHARS, TRACKED = 16_384, 32, 32_768
#: Tallies that are merged side by side before the last one.
FAN = 64
#: Pre-tokens that a worker's cache holds, and code points looked up at once.
CACHE, SLICE = 300_000, 1 << 20


def frequent_pretokens(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """About the ``most`` most frequent pre-tokens of all texts, from sketches of bounded size."""
    every = docs.select(F.explode(F.regexp_extract_all(text_or_empty("text"), F.lit(split_pattern()), F.lit(0))).alias("t"))
    short = every.filter(F.length("t") <= ENTRY_CHARS)
    parts = short.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(t, {max(TRACKED, most)})").alias("s"))
    # By a constant, as there is nothing to combine where no text has a pre-token.
    top = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {max(TRACKED, most)}), {most})").alias("top")).first()
    return [r["item"] for r in top["top"]] if top else []


def pack(entries: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table in compact form: all keys' bytes, where each ends, and the counts."""
    keys = [k.encode() for k in entries]
    return b"".join(keys), np.cumsum([len(k) for k in keys], dtype=np.uint32), np.array(list(entries.values()), np.uint8)


def unpack(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    data, ends, counts = table
    starts = [0, *ends.tolist()][: len(ends)]
    return {data[a:z].decode(): n for a, z, n in zip(starts, ends.tolist(), counts.tolist(), strict=True)}


def pieces(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` code points, cut where white space follows a sign."""
    at = 0
    while len(text) - at > size:
        m = _BORDER.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_BORDER = regex.compile(r"(?<=\S)\s")


class Lookup:
    """Tokens of texts: frequent pre-tokens by the table, the others by the library and a cache."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.library, self.frequent, self.lengths = json_tokenizer(path), frequent, dict(frequent)
        self.find = regex.compile(split_pattern()).findall
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """One number for each text; together they should have some SLICE code points."""
        out = np.zeros(len(texts), np.int64)
        whole = [i for i, t in enumerate(texts) if not split_alike(t)]
        for i, e in zip(whole, self.library.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(e)
        skip, found, held = set(whole), [], 0
        for i, t in enumerate(texts):
            if i in skip or not t:
                continue
            parts = self.special.split(t) if self.special else [t]
            out[i] += len(parts) - 1
            for p in chain.from_iterable(map(pieces, parts)):
                found.append((i, self.find(p)))
                held += len(p)
                if held > SLICE:
                    self._add(found, out)
                    found, held = [], 0
        self._add(found, out)
        return out

    def _add(self, found: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        missing = list({t for _, tokens in found for t in set(tokens).difference(self.lengths)})
        if missing and len(self.lengths) + len(missing) > len(self.frequent) + CACHE:
            self.lengths = dict(self.frequent)
            missing = list({t for _, tokens in found for t in set(tokens).difference(self.lengths)})
        self.lengths.update(zip(missing, map(len, self.library.encode_batch(missing, add_special_tokens=False)), strict=True))
        get = self.lengths.__getitem__
        for i, tokens in found:
            out[i] += sum(map(get, tokens))


_kept: dict = {}


def _worker_lookup(path: str, table) -> Lookup:
    """The lookup of this worker process; it outlives a task."""
    key = (path, hash(table[0]))
    if _kept.get("key") != key:
        _kept.update(key=key, lookup=Lookup(path, unpack(table)))
    return _kept["lookup"]


def _whole_counts(path: str, texts: list[str]) -> list[int]:
    if path.endswith(".model"):
        return [len(x) for x in piece_tokenizer(path).encode(texts, num_threads=1)]
    return [len(e) for e in json_tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > SLICE:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    yield at, texts[at:]


def count_tokens(docs: DataFrame, model: str = "byte_bpe_50k.json", limit: int = 1024, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. One pass for the table, one for the counts, no shuffle of either.

    ``model``: a file of the ``tokenizers`` library (.json) or of ``sentencepiece`` (.model), by path or by name.
    """
    spark, two_tier, shared = docs.sparkSession, is_byte_level(tokenizer_path(model)), None
    if two_tier:
        top = frequent_pretokens(docs, most) if most else []
        library = json_tokenizer(tokenizer_path(model))
        lengths = dict(zip(top, map(len, library.encode_batch(top, add_special_tokens=False)), strict=True))
        special = {t.content for t in library.get_added_tokens_decoder().values()}
        shared = spark.sparkContext.broadcast(pack({k: n for k, n in lengths.items() if n < 256 and k not in special}))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        path = tokenizer_path(model)
        tally = _worker_lookup(path, shared.value).counts if two_tier else lambda texts: _whole_counts(path, texts)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for at, texts in _slices(batch["text"].to_pylist()):
                n[at : at + len(texts)] = tally(texts)
            yield pa.record_batch([batch["doc_id"], batch["n_bytes"], pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = text_or_empty("text")
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op11_token_counts(spark, sf_dir):
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLES = {}
