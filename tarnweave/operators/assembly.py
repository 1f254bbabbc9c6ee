"""Answers put together from evidence: commands that the evidence holds, and segments that cite it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import match_keys


def _ids_by_rank(citations: Column) -> Column:
    """Distinct citation ids of structs (rank, id), best rank first."""
    ordered = F.transform(F.array_sort(citations), lambda c: c["id"])
    return F.array_distinct(ordered)


def ground_commands(commands: DataFrame, evidence: DataFrame) -> DataFrame:
    """Which commands of an answer its evidence holds, and as what they come out.

    commands (answer_id, pos, code), evidence (answer_id, place, code, upload boolean, rank, citation_id; a row for
    each citation of a command) -> answer_id, place, pos, code, citation_ids, tier.

    A command fits in one of three tiers, and a better one switches the others off: 0, an uploaded text
    holds the same code: the command comes out as it is, cited by all such texts; 1, a catalog command
    has the same code; 2, the first catalog command that is the same but for the names of placeholders, quotes and
    blanks. In tiers 1 and 2 the catalog's own command comes out. So of commands that differ in a placeholder alone each
    finds itself. Nothing else comes out, nothing twice, and the order is that of the evidence, then of the answer.

    One join by (answer, tier, key): commands have a row for each tier, evidence for each it can serve.
    A null rank is last.
    """
    keys = match_keys(F.col("code"))
    cite = F.struct(F.coalesce(F.col("rank"), F.lit((1 << 62))).alias("rank"), F.col("citation_id").alias("id"))
    key = lambda tier, value: F.struct(F.lit(tier).alias("tier"), value.alias("key"))
    held = evidence.withColumn("k", keys).withColumn("c", F.when(F.col("citation_id").isNotNull(), cite))
    uploads = held.filter("upload").groupBy("answer_id", key(0, F.col("k.strict")).alias("at")).agg(F.collect_set("c").alias("cites"))
    uploads = uploads.select("answer_id", "at", F.lit(None).cast("string").alias("canonical"), "cites")
    # Each catalog command once with all its citations, then the first command of each key.
    catalog = held.filter(~F.coalesce("upload", F.lit(False))).groupBy("answer_id", "place", "code", "k").agg(F.collect_set("c").alias("cites"))
    catalog = catalog.select("answer_id", "place", "code", "cites", F.explode(F.array(key(1, F.col("k.strict")), key(2, F.col("k.loose")))).alias("at"))
    catalog = catalog.groupBy("answer_id", "at").agg(F.min(F.struct("place", "code", "cites")).alias("first"))
    catalog = catalog.select("answer_id", "at", F.col("first.code").alias("canonical"), F.col("first.cites").alias("cites"))
    asked = commands.withColumn("k", keys)
    asked = asked.select("answer_id", "pos", "code", F.col("k.strict").alias("strict"), F.explode(F.array(key(0, F.col("k.strict")), key(1, F.col("k.strict")), key(2, F.col("k.loose")))).alias("at"))
    found = asked.join(uploads.unionByName(catalog), ["answer_id", "at"])
    found = found.groupBy("answer_id", "pos", "code", "strict").agg(F.min_by(F.struct("at.tier", "canonical", "cites"), "at.tier").alias("f"))
    # The same upload code or the same catalog command counts once, where it stands first.
    said = F.struct((F.col("f.tier") == 0).alias("upload"), F.when(F.col("f.tier") == 0, F.col("strict")).otherwise(F.col("f.canonical")).alias("text"))
    first = found.groupBy("answer_id", said.alias("said")).agg(F.min(F.struct("pos", "code", "f")).alias("r"))
    rank = F.coalesce(F.array_min(F.col("r.f.cites"))["rank"], F.lit(1 << 62))
    out = first.select(
        "answer_id", F.row_number().over(Window.partitionBy("answer_id").orderBy(rank, "r.pos")).cast("long").alias("place"), F.col("r.pos").alias("pos"),
        F.coalesce("r.f.canonical", "r.code").alias("code"), _ids_by_rank(F.col("r.f.cites")).alias("citation_ids"), F.col("r.f.tier").alias("tier"),
    )
    return out


def ground_segments(segments: DataFrame, citations: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Segments of answers that cite evidence of theirs: answer_id, pos, text, citation_ids.

    segments (answer_id, pos, text, citation_ids), citations (answer_id, rank, citation_id). Unknown citations go, each stays once,
    and a segment without text or citations goes. summaries (answer_id, summary) are of answers made from the
    evidence itself: where such an answer is left without segments, its summary cites the best ranked evidence. A summary that
    a model wrote doesn't belong there, as nothing says what supports it.
    """
    valid = citations.filter(F.col("citation_id").isNotNull()).groupBy("answer_id", "citation_id").agg(F.min("rank").alias("rank"))
    cited = segments.filter(F.trim("text") != "").select("answer_id", "pos", "text", F.posexplode("citation_ids").alias("i", "citation_id"))
    kept = cited.join(valid.select("answer_id", "citation_id"), ["answer_id", "citation_id"]).groupBy("answer_id", "pos", "text")
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "citation_id"))), lambda x: x["citation_id"]))
    kept = kept.agg(ids.alias("citation_ids"))
    if summaries is None:
        return kept
    best = valid.groupBy("answer_id").agg(F.min_by("citation_id", F.struct("rank", "citation_id")).alias("id"))
    bare = summaries.filter(F.trim("summary") != "").join(kept.select("answer_id").distinct(), "answer_id", "left_anti").join(best, "answer_id")
    return kept.unionByName(bare.select("answer_id", F.lit(0).cast(segments.schema["pos"].dataType).alias("pos"), F.trim("summary").alias("text"), F.array("id").alias("citation_ids")))
