"""Readers and writers of the text formats around a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SUFFIXES = ("txt", "md", "markdown")


@F.pandas_udf(StringType())
def decode_bytes(content: pd.Series) -> pd.Series:
    """UTF-8 with or without mark, else GB18030; null where neither fits."""

    def one(b):
        for name in ("utf-8-sig", "gb18030"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one)


def read_documents(spark: SparkSession, path: str, most_bytes: int = 20 << 20) -> DataFrame:
    """(name, kind, sha256, text, error) of the text and Markdown files below a path; Spark skips empty files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    f = f.select(name.alias("name"), kind.alias("kind"), "length", "content")
    error = F.when(~F.col("kind").isin(*SUFFIXES), "kind").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "size")
    f = f.withColumn("error", error)
    utf8 = F.try_validate_utf8("content")
    text = F.when(F.col("error").isNull(), F.coalesce(F.regexp_replace(utf8, "^﻿", ""), decode_bytes("content")))
    return f.select("name", "kind", F.sha2("content", 256).alias("sha256"), text.alias("text"), "error")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """TREC judgments: query, iteration, document, relevance, separated by white space."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("query_id"), p[1].alias("iteration"), p[2].alias("doc_id"), p[3].try_cast("int").alias("relevance"))


def qrels_errors(qrels: DataFrame) -> DataFrame:
    """A row for each broken rule: iteration is 0, relevance a whole number from 0, a document judged once a query."""
    one = qrels.select("query_id", "doc_id", F.explode(F.filter(F.array(F.when(F.col("iteration") != "0", F.lit("iteration")), F.when(F.col("relevance").isNull() | (F.col("relevance") < 0), F.lit("relevance"))), lambda x: x.isNotNull())).alias("rule"))
    twice = qrels.groupBy("query_id", "doc_id").count().filter("count > 1").select("query_id", "doc_id", F.lit("duplicate").alias("rule"))
    return one.unionByName(twice)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines, a JSON list, or an object with ``cases``."""
    f = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    if "cases" in f.columns:
        return f.select(F.explode("cases").alias("c")).select("c.*")
    lines = spark.read.json(path)
    return lines if "_corrupt_record" not in lines.columns else f


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """(event, data) of the frames of a server-sent event log."""
    frames = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\r?\n\r?\n")).alias("frame"))
    f = frames.select(F.regexp_extract("frame", r"(?m)^event:\s*(.*)$", 1).alias("event"), F.array_join(F.regexp_extract_all("frame", F.lit(r"(?m)^data:\s?(.*)$"), F.lit(1)), "\n").alias("data"))
    return f.filter("event <> '' or data <> ''")


def publish(df: DataFrame, path: str, key: list[str], fmt: str = "parquet") -> DataFrame:
    """Write a table version after making sure that its key is unique."""
    twice = df.groupBy(*key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0]}")
    df.write.format(fmt).mode("overwrite").save(path)
    return df.sparkSession.read.format(fmt).load(path)


def write_split(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").mode("overwrite").json(path)


RECIPE = "id string, title string, domain string, steps array<struct<title:string,code:string>>"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of recipes, a row each."""
    return spark.read.schema(RECIPE).option("multiLine", True).json(path)


def recipe_errors(recipes: DataFrame) -> DataFrame:
    """id, rule: recipes without id or steps, steps without code, and ids that occur twice."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    found = F.array_compact(F.array(
        F.when(blank(F.col("id")), F.lit("id")), F.when(F.coalesce(F.size("steps"), F.lit(0)) <= 0, F.lit("steps")), F.when(F.exists("steps", lambda x: blank(x["code"])), F.lit("code")),
    ))
    twice = recipes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 and id is not null").select("id", F.lit("duplicate").alias("rule"))
    return recipes.select("id", F.explode(found).alias("rule")).unionByName(twice)


def write_report(results: DataFrame, report: DataFrame, path: str) -> None:
    """An evaluation as files: the report as JSON, a table of its numbers as Markdown, failed cases as JSON lines, and a manifest."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    results.filter("not passed").write.mode("overwrite").json(f"{path}/failed")
    lines = F.array(*[F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(" |")) for c in report.columns])
    head = F.array(F.lit("| metric | value |"), F.lit("| --- | --- |"))
    report.select(F.explode(F.concat(head, lines)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    ids = results.agg(F.count("*").alias("cases"), F.sha2(F.bit_xor(F.xxhash64("case_id")).cast("string"), 256).alias("case_fingerprint"))
    ids.withColumn("columns", F.lit(",".join(sorted(results.columns)))).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def fixture_errors(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files (name, content) against a manifest (name, sha256, case_count) -> name, rule: missing, hash, blank_line or count."""
    lines = F.split(F.regexp_replace(F.col("content"), "\n\\z", ""), "\n", -1)
    f = files.select("name", F.sha2("content", 256).alias("has"), F.size(lines).alias("n"), F.exists(lines, lambda x: F.trim(x) == "").alias("blank"))
    j = expected.join(f, "name", "left")
    found = F.array_compact(F.array(
        F.when(F.col("has").isNull(), F.lit("missing")), F.when(F.col("has") != F.col("sha256"), F.lit("hash")), F.when(F.col("blank"), F.lit("blank_line")), F.when(F.col("n") != F.col("case_count"), F.lit("count")),
    ))
    return j.select("name", F.explode(found).alias("rule"))


def read_suite(spark: SparkSession, manifest: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cases, judgments) of all datasets of a suite's manifest.

    A dataset is a file of cases, and judgments from its own file where it names one, else from the
    cases' expected ids. Both carry the dataset's name. A manifest names few files, so it is read here.
    """
    listed = spark.read.option("multiLine", True).json(manifest).select(F.explode("datasets").alias("d")).select("d.*").collect()
    cases, judged = None, None
    for d in (r.asDict() for r in listed):
        name = F.lit(d["name"]).alias("dataset")
        c = read_cases(spark, f"{folder}/{d['path']}")
        want = c["expected_topic_id"] if "expected_topic_id" in c.columns else F.lit(None).cast("string")
        row = c.select(name, F.col("id").alias("case_id"), "query", want.alias("expected"))
        if d.get("qrels"):
            q = read_qrels(spark, f"{folder}/{d['qrels']}").select(name, F.col("query_id").alias("case_id"), "doc_id", "relevance")
        else:
            q = row.filter("expected is not null").select("dataset", "case_id", F.col("expected").alias("doc_id"), F.lit(1).alias("relevance"))
        cases, judged = (row, q) if cases is None else (cases.unionByName(row), judged.unionByName(q))
    if cases is None:
        return spark.createDataFrame([], "dataset string, case_id string, query string, expected string"), spark.createDataFrame([], "dataset string, case_id string, doc_id string, relevance int")
    return cases, judged


def scan_chunks(chunks: DataFrame, documents: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks of known documents in order, each with its parent's text; one whose parent is missing stays."""
    j = chunks.join(documents.select("doc_id", "title"), "doc_id").join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    return j.orderBy("doc_id", "idx")


def merge_revision(path: str, fresh: DataFrame, key: list[str], revision: str, out: str) -> DataFrame:
    """A new version of an index: documents of ``fresh`` replace theirs, the rest of ``path`` stays; written to ``out``.

    key names what is replaced as a whole, such as doc_id; every row gets the revision.
    """
    spark = fresh.sparkSession
    old = spark.read.parquet(path)
    kept = old.join(fresh.select(*key).distinct(), key, "left_anti")
    new = fresh.withColumn("revision", F.lit(revision))
    kept.unionByName(new, allowMissingColumns=True).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def write_catalog(topics: DataFrame, path: str, shards: str = "domain") -> DataFrame:
    """A catalog as JSON by domain, with one row of its hash and counts by the side; topics are unique by id."""
    publish(topics, f"{path}/by-id", ["id"], "json")
    topics.write.partitionBy(shards).mode("overwrite").json(f"{path}/topics")
    rows = topics.select(F.xxhash64(F.to_json(F.struct(*sorted(topics.columns)))).alias("h"), shards)
    done = rows.agg(F.count("*").alias("topics"), F.countDistinct(shards).alias("shards"), F.sha2(F.concat_ws(":", F.sum(F.col("h").cast("decimal(20,0)")).cast("string"), F.bit_xor("h").cast("string")), 256).alias("catalog_hash"))
    done.coalesce(1).write.mode("overwrite").json(f"{path}/bundle")
    return topics.sparkSession.read.json(f"{path}/bundle")


def split_stats(samples: DataFrame, text: str) -> DataFrame:
    """split, samples, chars and the longest text of each part of a training set."""
    return samples.groupBy("split").agg(F.count("*").alias("samples"), F.sum(F.length(text)).alias("chars"), F.max(F.length(text)).alias("longest"))


def utf8_errors(spark: SparkSession, path: str) -> DataFrame:
    """name, rule for files below a path that are not UTF-8, hold a replacement sign, or begin with a byte order mark."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.try_validate_utf8("content")
    found = F.array_compact(F.array(
        F.when(text.isNull(), F.lit("encoding")), F.when(F.contains(text, F.lit("\ufffd")), F.lit("replacement")), F.when(F.startswith(text, F.lit("\ufeff")), F.lit("mark")),
    ))
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.explode(found).alias("rule"))
