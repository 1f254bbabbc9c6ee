"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and line definition here: U+0020 and U+0009..U+000D.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """Bind ``value`` to a variable: evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Spark's ``lower`` does just that on pure ASCII strings."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, _UPPER, _UPPER.lower())
    )


def words(text: Column) -> Column:
    """Array of the white-space separated words of ``text`` (no null inside)."""
    return let(
        F.btrim(text, F.lit(WS_CHARS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS)),
    )


def hash_pair(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of ``c`` under different seeds: a 128-bit identity."""
    return F.xxhash64(c), F.xxhash64(F.lit(7919), c)


#: So many bytes of a join's side may be built in memory by one task.
HASH_BYTES = 32 << 20


def built_in_memory(side: DataFrame, total_bytes: int) -> DataFrame:
    """``side`` of a shuffled join, hashed in memory if it is small: ``total_bytes`` over all tasks; else it is sorted, which spills.

    Its keys must be unique, so that they are dealt evenly.
    """
    parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash") if total_bytes <= parts * HASH_BYTES else side


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is missing and Spark runs in one process (tests, a laptop)
    a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tarnweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tarnweave-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor then costs a reread, not a recomputation of what is above.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    # The shuffle files of this write are of no use after it.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)
