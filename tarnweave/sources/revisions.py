"""Revisions of a table that are published as a whole: a head file for each, made once and never changed.

    path/data-<random>/     Parquet of one revision
    path/heads/000000000007 the folder of revision 7, then a full stop

A writer names the revision it replaces. Its rows are written first, then the next head is made by an
operation that fails if the head is there, so of two writers that replace the same revision one
fails and what it wrote is never seen. Readers take the last head or the one they are pinned to.
Old folders stay until ``sweep``; a head whose full stop is missing is not read yet.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tarnweave.sources.readers import publish


class RevisionConflict(RuntimeError):
    """Another writer has published the revision after the one that was to be replaced."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, head: str, text: str) -> bool:
    """Make the head with its text if it isn't there; whether it was made.

    On a local disk the finished file is linked to its name, which is atomic; elsewhere the file system's own exclusive create is used.
    """
    jvm, fs = _fs(spark, head)
    at = jvm.org.apache.hadoop.fs.Path(head)
    if fs.getScheme() == "file":
        from pathlib import Path

        name = Path(at.toUri().getPath())
        name.parent.mkdir(parents=True, exist_ok=True)
        made = name.parent.parent / f"head-{uuid.uuid4().hex}"
        made.write_text(text)
        try:
            name.hardlink_to(made)
        except FileExistsError:
            return False
        finally:
            made.unlink()
        return True
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def revisions(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each published revision."""
    jvm, fs = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/heads")
    if not fs.exists(at) or not len(fs.listStatus(at)):
        return {}
    heads = spark.read.text(f"{path}/heads", wholetext=True).selectExpr("_metadata.file_name n", "value").collect()
    return {int(r["n"]): r["value"][:-1] for r in heads if r["value"].endswith(".")}


def publish_revision(df: DataFrame, path: str, key: list[str], replaces: int | None) -> int:
    """Publish rows, unique by ``key``, as the revision after ``replaces`` (None: as the first); gives its number.

    RevisionConflict if that revision is there by then, or the one to be replaced is not.
    """
    spark, number = df.sparkSession, 0 if replaces is None else replaces + 1
    there = revisions(spark, path)
    if number in there or (replaces is not None and replaces not in there):
        raise RevisionConflict(f"{path}: revision {replaces} isn't the last one")
    name = f"data-{uuid.uuid4().hex}"
    publish(df, f"{path}/{name}", key)
    if not _claim(spark, f"{path}/heads/{number:012d}", f"{name}."):
        raise RevisionConflict(f"{path}: revision {number} was published by another writer")
    return number


def read_revision(spark: SparkSession, path: str, revision: int | None = None) -> tuple[int, DataFrame]:
    """The number and the rows of a revision, the last one by default; a reader that keeps the number can read the same again."""
    there = revisions(spark, path)
    number = max(there, default=-1) if revision is None else revision
    if number not in there:
        raise KeyError(f"{path} has no revision {revision if revision is not None else ''}")
    return number, spark.read.parquet(f"{path}/{there[number]}")


def publish_changes(fresh: DataFrame, path: str, key: list[str], replaced: list[str], base: int) -> int:
    """The revision after ``base``: rows of ``fresh`` in place of all rows that share their ``replaced`` columns, such as a document's."""
    _, old = read_revision(fresh.sparkSession, path, base)
    kept = old.join(fresh.select(*replaced).distinct(), replaced, "left_anti").select(old.columns)
    return publish_revision(kept.unionByName(fresh, allowMissingColumns=True), path, key, base)


def sweep(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Remove the rows and heads of all but the last ``keep`` revisions; gives what went. Readers pinned to these fail."""
    jvm, fs = _fs(spark, path)
    there = revisions(spark, path)
    gone = sorted(there)[: max(0, len(there) - max(1, keep))]
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/heads/{n:012d}"), False)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{there[n]}"), True)
    return gone
