"""Document cleaning: repeated lines, page edges, quality marks, near duplicates of neighbours."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tarnweave.functions.scores import content_hash
from tarnweave.functions.text import nfkc, normalized_key
from tarnweave.sources.tables import written

#: Lines of fences and of tables; fixed forms.
FENCE = r"^\s*(?:```|~~~)"
TABLE = r"^\s*\||^\s*[-+|: ]{3,}\s*$|\s\|\s"
DISALLOWED = r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of every line, from 0."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))


def content_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, first_id): the least id of each group of equal contents.

    The groups are added up before anything is joined, so a group of any size is one row.
    """
    h = docs.select("doc_id", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return h.join(first, "content_hash")


def _line_kinds(docs: DataFrame) -> DataFrame:
    """Lines with ``layout``: whether a line is of a fence or a table."""
    w = W.partitionBy("doc_id").orderBy("pos")
    marks = F.sum(F.col("line").rlike(FENCE).cast("int")).over(w)
    return lines(docs).withColumn("layout", (marks % 2 == 1) | F.col("line").rlike(FENCE) | F.col("line").rlike(TABLE))


def adjacent_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, removed): a line with text goes if the one before it has the same key; lines of code and tables stay."""
    keyed = _line_kinds(docs).withColumn("key", F.when(~F.col("layout"), normalized_key(F.col("line"))))
    before = F.lag("key").over(W.partitionBy("doc_id").orderBy("pos"))
    return keyed.withColumn("before", before).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce((F.col("key") != "") & (F.col("key") == F.col("before")), F.lit(False)).alias("removed")
    )


def page_edges(pages: DataFrame, most: int = 160, least_pages: int = 3) -> DataFrame:
    """pages (doc, page, pos, line) -> the first and last lines that repeat as headers or footers.

    An edge line of at most ``most`` signs goes where its key is an edge on at least
    ``least_pages`` pages and on half the document's pages.
    """
    ends = pages.groupBy("doc", "page").agg(F.min_by("line", "pos").alias("a"), F.max_by("line", "pos").alias("z"), F.min("pos").alias("pa"), F.max("pos").alias("pz"))
    edges = ends.select("doc", "page", F.explode(F.array_distinct(F.array(F.struct(F.col("a").alias("line"), F.col("pa").alias("pos")), F.struct(F.col("z").alias("line"), F.col("pz").alias("pos"))))).alias("e"))
    edges = edges.select("doc", "page", "e.pos", normalized_key(F.col("e.line")).alias("key"), F.length("e.line").alias("n")).filter((F.col("key") != "") & (F.col("n") <= most))
    total = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    often = edges.groupBy("doc", "key").agg(F.countDistinct("page").alias("on")).join(total, "doc")
    often = often.filter((F.col("pages") >= least_pages) & (F.col("on") >= F.greatest(F.lit(least_pages), F.ceil(F.col("pages") / 2))))
    return edges.join(often.select("doc", "key"), ["doc", "key"], "left_semi").select("doc", "page", "pos", "key")


def quality_scan(docs: DataFrame) -> DataFrame:
    """Counts of replacement and control signs, visible signs, and whether the text is rejected."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select(
        "doc_id", F.length(t).alias("n"), (F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))).alias("replacements"),
        F.regexp_count(t, F.lit(CONTROL)).alias("controls"), F.length(F.regexp_replace(t, r"[\s\p{C}]+", "")).alias("visible"),
    )
    many = F.col("replacements") > F.greatest(F.lit(3), F.floor(F.col("n") / 100))
    binary = F.coalesce(F.try_divide(F.col("controls"), F.col("n")), F.lit(0.0)) > 0.08
    bad = many | binary | (F.col("visible") == 0)
    return d.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("replacements", "controls", "visible")],
        F.when(bad, "rejected").when((F.col("replacements") > 0) | (F.col("controls") > 0), "warning").otherwise("clean").alias("status"),
    )


def blank_lines_removed(docs: DataFrame, keep: int = 2) -> DataFrame:
    """(doc_id, n_removed): empty lines beyond ``keep`` in a run, by gaps and islands."""
    w = W.partitionBy("doc_id").orderBy("pos")
    runs = lines(docs).withColumn("full", (F.trim("line") != "").cast("int")).withColumn("run", F.sum("full").over(w))
    size = runs.filter("full = 0").groupBy("doc_id", "run").agg(F.count("*").alias("n"))
    extra = size.groupBy("doc_id").agg(F.sum(F.greatest(F.col("n") - keep, F.lit(0))).alias("x"))
    return docs.select("doc_id").join(extra, "doc_id", "left").select("doc_id", F.coalesce("x", F.lit(0)).cast("long").alias("n_removed"))


def same_enough(left: str, right: str) -> bool:
    """Equal keys, or eight tokens and more on both sides with Jaccard >= .98 and sequence ratio >= .985."""
    a, b = " ".join(left.split()).casefold(), " ".join(right.split()).casefold()
    if not a or not b:
        return False
    if a == b:
        return True
    x, y = a.split(), b.split()
    if min(len(x), len(y)) < 8:
        return False
    sx, sy = set(x), set(y)
    return len(sx & sy) / len(sx | sy) >= 0.98 and SequenceMatcher(None, a, b).ratio() >= 0.985


def near_duplicate_fold(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each line is compared with the last one kept, so it is a fold; code and table rows stay."""
    fence, table = re.compile(FENCE), re.compile(TABLE)

    def run(batches):
        for b in batches:
            total, gone, texts = [], [], []
            for t in b["text"].to_pylist():
                kept, all_, inside, last = [], (t or "").split("\n"), False, None
                for line in all_:
                    mark = bool(fence.match(line))
                    layout = mark or inside or bool(table.search(line))
                    inside ^= mark
                    if layout or last is None or not same_enough(last, line):
                        kept.append(line)
                        last = None if layout else line
                total.append(len(all_))
                gone.append(len(all_) - len(kept))
                texts.append("\n".join(kept))
            yield pa.record_batch([b["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_lines long, n_removed long, text string")


def is_table_or_code(kind: Column, text: Column) -> Column:
    return kind.isin("code", "table_row") | text.rlike(FENCE) | text.rlike("(?m:" + TABLE + ")")


def line_normalized(blocks: DataFrame) -> DataFrame:
    """blocks (kind, text and others) -> text without BOM, NUL and control signs, line ends as \\n and no blanks before them; plus layout and the raw counts.

    In code and tables (``layout``) nothing else changes; prose also gets its compatibility form, at most two
    empty lines in a row, and none at its ends. Each step is a projection of its own, so that no text is
    computed twice, and a pattern only runs where a cheap look at the text says that it can match.
    """
    is_ascii = lambda c: F.octet_length(c) == F.length(c)
    has = lambda c, x: F.contains(F.col(c), F.lit(x))
    t = blocks.withColumns({
        "raw_chars": F.length("text"), "replacements": F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit(""))),
        "controls": F.regexp_count("text", F.lit(DISALLOWED)), "raw": F.coalesce("text", F.lit("")),
    })
    t = t.withColumns({"layout": is_table_or_code(F.col("kind"), F.col("raw")), "t": F.replace(F.replace("raw", F.lit("\ufeff"), F.lit("")), F.lit("\x00"), F.lit(""))})
    t = t.withColumn("t", F.when(has("t", "\r"), F.regexp_replace("t", "\r\n|\r", "\n")).otherwise(F.col("t")))
    t = t.withColumn("even", nfkc(F.when(~F.col("layout"), F.col("t")))).withColumn("t", F.coalesce("even", "t"))
    t = t.withColumn("t", F.when(F.col("controls") > 0, F.regexp_replace("t", DISALLOWED, "")).otherwise(F.col("t")))
    # Of white space only blanks, tabs and \n are left in ASCII here.
    blanks = F.when(~has("t", "\n"), F.rtrim(F.col("t"), F.lit(" \t"))).otherwise(F.regexp_replace("t", r"[ \t]+(?=\n|\z)", ""))
    t = t.withColumn("t", F.when(F.col("layout") | is_ascii("t"), blanks).otherwise(F.regexp_replace("t", r"(?U)[^\S\n]+(?=\n|\z)", "")))
    empty = F.regexp_replace(F.regexp_replace("t", "\n{4,}", "\n\n\n"), r"^\n+|\n+$", "")
    t = t.withColumn("t", F.when(~F.col("layout") & has("t", "\n"), empty).otherwise(F.col("t")))
    now = F.when(F.col("t") == F.col("raw"), F.col("layout")).otherwise(is_table_or_code(F.col("kind"), F.col("t")))
    return t.withColumn("layout", now).withColumn("text", F.col("t")).drop("t", "raw", "even")


def normalized_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, idx, kind, page, text) normalised, with the keys of those on pages; written, as edges and the fold both read it."""
    t = line_normalized(blocks.select("doc_id", "idx", "kind", "page", "text"))
    return written(t.withColumn("key", F.when(F.col("page").isNotNull(), normalized_key(F.col("text")))), "blocks")


def block_edges(normal: DataFrame) -> DataFrame:
    """(doc_id, idx) of blocks that are repeated headers or footers: paragraphs at an edge of three pages and of half of all.

    A page is one row with its first and last block, so only edges are compared, not texts.
    """
    block = F.struct("idx", "kind", "layout", F.when(F.length("key") <= 160, F.col("key")).alias("key"))
    pages = normal.filter(F.col("page").isNotNull() & F.col("text").rlike(r"\S")).groupBy("doc_id", "page").agg(F.min_by(block, "idx").alias("a"), F.max_by(block, "idx").alias("z"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    edges = pages.select("doc_id", "page", F.explode(F.array_distinct(F.array("a", "z"))).alias("e")).select("doc_id", "page", "e.*").filter("kind = 'paragraph' and key is not null")
    often = edges.filter("not layout and key <> ''").groupBy("doc_id", "key").agg(F.countDistinct("page").alias("on")).join(total, "doc_id")
    often = often.filter((F.col("on") >= 3) & (F.col("on") >= F.ceil(F.col("pages") / 2)))
    return edges.join(often.select("doc_id", "key"), ["doc_id", "key"], "left_semi").select("doc_id", "idx")


def folded(blocks: DataFrame, near: bool = True) -> DataFrame:
    """A row for each document: raw counts and ``b``, its blocks with text in order, each with its fate and, if kept, text and place.

    fate: edge (of a page), kept, exact or, with ``near``, near. Each paragraph is compared with the last block kept; code and
    table rows always stay. A document's blocks come together in one row, as a fold needs, so texts are shuffled once; its
    edges join them as numbers.
    """
    normal = normalized_blocks(blocks)
    edges = block_edges(normal).groupBy("doc_id").agg(F.collect_set("idx").alias("edges"))
    rows = normal.groupBy("doc_id").agg(
        F.count("*").alias("raw_blocks"), *[F.sum(c).alias(c) for c in ("replacements", "controls", "raw_chars")],
        F.array_sort(F.collect_list(F.when(F.col("text").rlike(r"\S"), F.struct("idx", "kind", "page", "layout", "text")))).alias("b"),
    ).join(edges, "doc_id", "left")
    kind = {c: normal.schema[c].dataType.simpleString() for c in ("doc_id", "idx", "page")}
    out = f"doc_id {kind['doc_id']}, raw_blocks long, replacements long, controls long, raw_chars long, b array<struct<idx:{kind['idx']},kind:string,page:{kind['page']},fate:string,text:string,char_start:long,char_end:long>>"
    pa_out = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        for batch in batches:
            done = []
            for all_, edges in zip(batch["b"].to_pylist(), batch["edges"].to_pylist(), strict=True):
                last, at, new, edges = None, 0, [], set(edges or ())
                for b in all_:
                    fate = "edge" if b["idx"] in edges else "kept"
                    if fate == "kept" and last and b["kind"] == last["kind"] == "paragraph":
                        if " ".join(b["text"].split()).casefold() == " ".join(last["text"].split()).casefold():
                            fate = "exact"
                        elif near and not b["layout"] and not last["layout"] and same_enough(last["text"], b["text"]):
                            fate = "near"
                    x = {"idx": b["idx"], "kind": b["kind"], "page": b["page"], "fate": fate}
                    if fate == "kept":
                        last, text = b, b["text"].strip("\n")
                        x |= {"text": text, "char_start": at, "char_end": at + len(text)}
                        at += len(text) + 2
                    new.append(x)
                done.append(new)
            names = pa_out.names[:-1]
            yield pa.record_batch([*[batch[n] for n in names], pa.array(done, pa_out.field("b").type)], schema=pa_out)

    return rows.mapInArrow(run, out)


def clean_blocks(blocks: DataFrame, near: bool = True) -> DataFrame:
    """blocks (doc_id, idx, kind, page, text) -> doc_id, idx, kind, page, fate of blocks with text; those that stay have their normalised text, char_start and char_end."""
    return folded(blocks, near).select("doc_id", F.inline("b"))


def clean_documents(blocks: DataFrame, near: bool = True) -> DataFrame:
    """blocks (doc_id, idx, kind, page, text) -> a report for each document: its clean text, what went, marks and a status.

    Without ``near`` only equal neighbours go, not those that are nearly equal.
    rejected: nothing is left, or too many replacement signs; warning: anything went or looks odd; else clean.
    """
    n = lambda fate: F.size(F.filter("b", lambda x: x["fate"] == fate))
    whole = F.array_join(F.transform(F.filter("b", lambda x: x["fate"] == "kept"), lambda x: x["text"]), "\n\n")
    d = folded(blocks, near).withColumns({"text": whole, "clean_blocks": n("kept"), "removed_edges": n("edge"), "removed_exact": n("exact"), "removed_near": n("near")})
    counts = ["clean_blocks", "removed_edges", "removed_exact", "removed_near", "replacements", "controls", "raw_chars"]
    d = d.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    visible = F.col("text").rlike(r"[^\s\p{C}]")
    many = F.col("replacements") > F.greatest(F.lit(3), F.floor(F.col("raw_chars") / 100))
    binary = F.coalesce(F.try_divide(F.col("controls"), F.col("raw_chars")) > 0.08, F.lit(False))
    odd = (F.col("replacements") > 0) | (F.col("controls") > 0) | (F.col("removed_edges") + F.col("removed_exact") + F.col("removed_near") > 0)
    return d.select(
        "doc_id", F.when(~visible | many | binary, "rejected").when(odd, "warning").otherwise("clean").alias("status"), "raw_blocks", *counts,
        F.length("text").cast("long").alias("clean_chars"), F.when(F.col("text") == "", "").otherwise(F.sha2("text", 256)).alias("clean_sha256"),
    )
