"""Line dedup (operator 10): levelled sorted runs of line hashes.

``LineRuns`` is a log-structured store of (line hash, number of documents).
Documents come in batches. A batch first merge-anti-joins the runs: keys that a
run already condemns need no more counting. The rest become a new sorted run of
level 0, bucketed and sorted by the hash so that joins and compactions between
runs are merges without a shuffle. A level that holds ``fanout`` runs when a batch
comes is compacted, counts added, into one run of the next level, which that batch and
later ones merge against. All runs have one number of buckets, set by the number of lines.

Cases: null and empty texts are one empty line; a key under ``min_chars`` code
points is never dropped; repeated rows are documents of their own; several equal
lines in one document count once; text identity, not ``doc_id``, links lines to
rows, so null or repeated ids are harmless; other columns pass through, whatever
their names (``__lines`` alone is replaced by drop_frequent_lines).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, built_in_memory, cut, hash_pair, let, lower_ascii, text_or_empty, work_dir

KEY = ["k1", "k2"]
#: Line keys of a batch that a bucket holds, about: 24 bytes each.
BUCKET_ROWS = 4_000_000


def bucket_count(rows: int, batches: int) -> int:
    """Buckets of every run, so that one of a batch of ``rows / batches`` keys stays small; 16 at least."""
    return max(16, -(-rows // (batches * BUCKET_ROWS)))


def line_key(line: Column) -> Column:
    return let(F.btrim(line, F.lit(WS_CHARS)), lower_ascii)


class LineRuns:
    """Sorted runs of (k1, k2, n), bucketed by both keys, in levels."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int = 16):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.dir, self.levels = work_dir(spark, "line-runs"), [[]]

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.select(*KEY, "n").write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", f"{self.dir}/{name}").format("parquet").saveAsTable(name)
        )
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one, counts added: merge joins of sorted buckets.

        Not a union: over bucketed scans Spark 4.1 keeps the partitioning of a union whose partitions
        it does not bring together, and sums come out apart.
        """
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "m")
            out = out.join(other.hint("merge"), KEY, "full").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, keys: DataFrame) -> None:
        """keys: (k1, k2, c) of a new batch: distinct lines of a text, c documents having it."""
        self._compact()
        fresh = keys.groupBy(*KEY).agg(F.sum("c").alias("n")).repartition(self.buckets, *KEY)
        for name in [x for level in self.levels for x in level]:
            known = self.spark.table(name).filter(F.col("n") >= self.min_docs)
            fresh = fresh.join(known.select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(fresh))

    def _compact(self) -> None:
        i = 0
        while i < len(self.levels):
            if len(self.levels[i]) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(self._merged(self.levels[i])))
                self._drop(self.levels[i])
                self.levels[i] = []
            i += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Takes the runs out of the catalog, when what ``frequent`` gave has been used."""
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]

    def frequent(self) -> DataFrame:
        """Keys with at least ``min_docs`` documents over all runs."""
        names = [x for level in self.levels for x in level]
        if not names:
            return self.spark.createDataFrame([], "k1 long, k2 long")
        return self._merged(names).filter(F.col("n") >= self.min_docs).select(*KEY)


def _line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(t1, t2, p, k1, k2): every countable line with its place and the identity of its text."""
    t1, t2 = hash_pair(F.col("__t"))
    lines = docs.select(text_or_empty("text").alias("__t")).select(
        t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split("__t", "\n", -1)).alias("p", "line")
    )
    keyed = lines.select("t1", "t2", "p", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    k1, k2 = hash_pair(F.col("key"))
    return keyed.select("t1", "t2", "p", k1.alias("k1"), k2.alias("k2"))


def _judged(docs: DataFrame, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """(d, r): each row of ``docs`` as a struct, and n_lines, n_dropped and the text left."""
    spark = docs.sparkSession
    # A row for each distinct text, line key and place, with the number of documents of that text:
    # groups of copies are added up before anything else is shuffled.
    table = _line_table(docs, min_chars)
    one = table.groupBy("t1", "t2", *KEY, "p").agg(F.count("*").alias("c"))
    lines = cut(
        one.groupBy("t1", "t2", *KEY).agg(F.max("c").alias("c"), F.collect_list("p").alias("ps")), "lines"
    )
    runs = LineRuns(spark, min_docs, buckets=bucket_count(lines.count(), batches))
    for b in range(batches):
        part = lines.filter(F.pmod(F.col("t1"), F.lit(batches)) == b)
        runs.add(part.select(*KEY, "c"))
    # Written first, so that Spark knows how few they are and needn't deal a very common line by its key.
    frequent = cut(runs.frequent(), "lines-frequent")
    # Written as well: both sides of the join below are then plain shuffles, of which Spark can
    # split a partition that one text with very many copies fills.
    marked = cut(
        lines.join(frequent, KEY, "left_semi").groupBy("t1", "t2").agg(F.flatten(F.collect_list("ps")).alias("bad")), "lines-marked"
    )
    runs.close()
    size = marked.agg(F.sum(F.size("bad") * 4 + 64)).first()[0] or 0
    text = text_or_empty("text")
    t1, t2 = hash_pair(text)
    # One struct holds the row, so columns of any names stay apart from those of the join.
    rows = docs.select(F.struct(*docs.columns).alias("d"), text.alias("text"), t1.alias("t1"), t2.alias("t2"))
    joined = rows.join(built_in_memory(marked, size), ["t1", "t2"], "left")

    def left(ln: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(ln) - 1), F.coalesce("bad", F.array().cast("array<int>")))
        return let(
            keep,
            lambda k: F.struct(
                F.size(ln).cast("long").alias("n_lines"),
                (F.size(ln) - F.size(k)).cast("long").alias("n_dropped"),
                F.array_join(F.transform(k, lambda i: F.get(ln, i)), "\n").alias("text"),
            ),
        )

    return joined.select("d", let(F.split("text", "\n", -1), left).alias("r"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """``docs`` plus one struct column ``__lines``: n_lines, n_dropped and the text left."""
    out = _judged(docs, min_docs, min_chars, batches)
    return out.select(*[F.col("d")[c].alias(c) for c in docs.columns if c != "__lines"], F.col("r").alias("__lines"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """The documents without their frequent lines, columns as before."""
    out = _judged(docs, min_docs, min_chars, batches)
    text = F.col("r")["text"]
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("d")[c]).alias(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("__lines")
    return drop_frequent_lines(docs).select(
        "doc_id", x["n_lines"].alias("n_lines"), x["n_dropped"].alias("n_dropped"), F.sha2(x["text"], 256).alias("kept_sha256")
    )


_WS_SQL = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {
    "op10_line_dedup": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) p from documents),
k as (select *, translate(trim(line, {_WS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
f as (select key from k where len(key) >= 1 group by 1 having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null bad from k left join f on k.key = f.key)
select doc_id, count(*)::bigint n_lines, (count(*) filter (where bad))::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not bad), '')) kept_sha256
from m group by 1
"""
}
