"""Fill-in-the-middle transformation over a distinct-text index (operator 13).

Identical texts are grouped by their SHA-256, and every group's texts are compared as whole strings
before one of them stands for all. Documents are joined back by digest, so the rows of a text follow
each other. At the first of them the byte offsets of the text's code points are written once as an
Elias-Fano list: 2 to 4 bits a code point, from which any offset is read without going through the
text again. The two seeded cuts of every row are selected from it, and the parts are cut as bytes.

The lists are made after the join, not before: Spark forgets how rows are dealt out when they go
through Python, so lists made before it would cost a second shuffle of all texts.

The texts move once and only the distinct ones (copies fall together before the shuffle); of the documents only
id and digest move. A text of which many documents are copies is dealt to several
tasks: each ``1 / SHARES`` of all rows, rounded up, is a part of its own with its own copy of the text. At most
SHARES texts can be that frequent, so the list of them that is broadcast has a fixed bound.

Cases: a null text is the empty text, which stays plain; a null id draws with the seed
alone (``1:``); repeated rows agree, and each gives a row; texts that hold one of the marks stay plain; a very long text
is one row of the index; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text that more than 1 / SHARES of all rows hold is dealt to several tasks.
SHARES = 512
#: Every so many list entries the place of one is noted, to start a selection there.
STEP = 512
#: Bytes of a text gone through at once.
BLOCK = 1 << 20
_HEAD = np.dtype([("n", "<i8"), ("low", "<i8"), ("samples", "<i8"), ("high", "<i8")])


def boundaries(data: bytes) -> bytes:
    """The Elias-Fano list of the byte offsets at which code points start, and of the end. Goes through the text block by block."""
    raw = np.frombuffer(data, np.uint8)
    blocks = range(0, len(raw), BLOCK)
    starts = lambda b: np.flatnonzero((raw[b : b + BLOCK] & 0xC0) != 0x80) + b
    n = sum(len(starts(b)) for b in blocks) + 1
    low = max(0, (len(raw) // n).bit_length() - 1)
    bits, rest = np.zeros((len(raw) >> low) + n, np.uint8), np.zeros((n, low), np.uint8)
    samples, done = [], 0
    for ends in [*map(starts, blocks), np.array([len(raw)])]:
        places = (ends >> low) + np.arange(done, done + len(ends))
        bits[places] = 1
        rest[done : done + len(ends)] = (ends[:, None] >> np.arange(low)) & 1
        samples.append(places[-done % STEP :: STEP])
        done += len(ends)
    noted, high = np.concatenate(samples).astype("<i8"), np.packbits(bits)
    head = np.array([(n, low, len(noted), len(high))], _HEAD)
    return head.tobytes() + noted.tobytes() + high.tobytes() + np.packbits(rest).tobytes()


def select(packed: bytes, i: int) -> int:
    """Entry ``i`` of a list: the byte offset of code point ``i``."""
    n, low, count, size = (int(x) for x in np.frombuffer(packed, _HEAD, 1)[0])
    first = _HEAD.itemsize + 8 * count
    place = int(np.frombuffer(packed, "<i8", 1, _HEAD.itemsize + 8 * (i // STEP))[0])
    left, at = i % STEP, place >> 3
    # Of STEP entries' bits: entries and at most as many gaps as the shifted offsets grow.
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, min(size - at, STEP), first + at))
    bits[: place & 7] = 0
    ones = np.flatnonzero(bits)
    high = at * 8 + int(ones[left]) - i
    if not low:
        return high
    start = i * low
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, (start + low + 7) // 8 - start // 8, first + size + start // 8))
    return (high << low) | sum(int(bits[start % 8 + j]) << j for j in range(low))


@F.arrow_udf(T.StructType().add("a", "long").add("b", "long"))
def _select(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The byte offsets of code points i and j; the list of a text is made at the first of its rows, which follow each other."""
    last, packed = None, b""
    for digest, part, text, i, j in batches:
        cuts = []
        for k, key in enumerate(zip(digest.to_pylist(), part.to_pylist(), strict=True)):
            if key != last:
                last, packed = key, boundaries(text[k].as_buffer())
            cuts.append((select(packed, i[k].as_py()), select(packed, j[k].as_py())))
        yield pa.StructArray.from_arrays([pa.array([c[n] for c in cuts], pa.int64()) for n in (0, 1)], ["a", "b"])


def _draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th unsigned 32-bit number of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text, its digest and the part of a frequent text's documents that a row falls to."""
    keyed = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    counts = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    share = total // SHARES + 1
    hot = counts.filter(F.col("rows") > share).select("digest", F.ceil(F.col("rows") / share).cast("int").alias("parts")).limit(SHARES)
    hot = docs.sparkSession.createDataFrame(hot.collect(), "digest binary, parts int")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")), F.lit(0)).cast("int")
    return keyed.join(F.broadcast(hot), "digest", "left").withColumn("part", part).drop("parts")


def text_index(dealt: DataFrame) -> DataFrame:
    """digest, part, text: a row for each distinct text and part."""
    texts = dealt.groupBy("digest", "part").agg(F.collect_set("text").alias("texts"))
    clash = F.raise_error(F.lit("two texts of one SHA-256"))
    return texts.select("digest", "part", F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(clash).alias("text"))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_pct: int = 10, spm_pct: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    Two shuffles by digest: the distinct texts, and the documents' ids.
    """
    dealt = _dealt(docs)
    index = text_index(dealt)
    h = lambda k: _draw(F.col("doc_id"), seed, k)
    rows = dealt.select("doc_id", "digest", "part").join(index, ["digest", "part"])
    rows = rows.withColumn("n", F.length("text").cast("long"))
    rows = rows.withColumns({"x": F.pmod(h(0), F.col("n") + 1), "y": F.pmod(h(1), F.col("n") + 1)})
    rows = rows.withColumns({"i": F.least("x", "y"), "j": F.greatest("x", "y")})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (h(2) % 100 >= 100 - plain_pct)
    form = F.when(plain, "plain").when(h(3) % 100 < spm_pct, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "at": _select("digest", "part", "text", "i", "j")})
    raw, a, b = F.col("text").cast("binary"), F.col("at.a").cast("int"), F.col("at.b").cast("int")
    part = lambda start, size: F.substring(raw, start, size).cast("string")
    prefix, middle, suffix = part(F.lit(1), a), part(a + 1, b - a), part(b + 1, F.octet_length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("doc_id", "n", "form", cut(F.col("i")).alias("prefix_chars"), cut(F.col("j") - F.col("i")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that was cut, from its output and form alone.

    No part holds a mark, so the first place of each mark is the one that was put there.
    """
    first = F.when(form == "psm", PREFIX).otherwise(SUFFIX)
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    one = F.split_part(F.substring(output, F.length(first) + 1, F.length(output)), second, F.lit(1))
    rest = F.substring(output, F.length(first) + F.length(one) + F.length(second) + 1, F.length(output))
    two = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_SQL = """
with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, ''))::bigint n, sha256('1:' || coalesce(doc_id::varchar, '')) s from documents),
h as (select *, ('0x' || s[1:8])::bigint h1, ('0x' || s[9:16])::bigint h2, ('0x' || s[17:24])::bigint h3, ('0x' || s[25:32])::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) i, greatest(h1 % (n + 1), h2 % (n + 1)) j,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from h),
p as (select *, substring(t, 1, i) a, substring(t, i + 1, j - i) b, substring(t, j + 1, n - j) z from c)
select doc_id, n, form, case when form <> 'plain' then i end prefix_chars, case when form <> 'plain' then j - i end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) output_sha256,
  sha256(t) restored_sha256 from p
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": _SQL}
