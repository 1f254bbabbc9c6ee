"""Mixing sources to target weights (operator 8), DataFrame functions only.

Weighted sampling without replacement by Efraimidis and Spirakis: a document with
weight w and a uniform u has the key u^(1/w); the largest keys are taken first. A
source's target is spent on complete epochs first; what is left goes to the
documents in key order until a prefix sum of their sizes meets it, the last one
being taken in part so that the target is met to the word.

The prefix sum never brings a source together: keys are cut into ``2^bits``
slices, sizes are summed by (source, slice), and only the slice in which the
budget ends is sorted.

Cases: a document without an id draws its number by its text; null text has size 0 and takes nothing; a null source is a source of its
own, last in order; ties of the key break by doc_id, then by text identity, and
rows that still tie are equal in every column that counts; an empty table gives
no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_or_empty

TWO48 = float(1 << 48)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 to 1.5: documents of plain letters weigh more than those of signs and digits."""
    n = F.length(text)
    signs = n - F.length(F.translate(text, "#*$%&|<>!0123456789", ""))
    return F.when(n == 0, F.lit(0.5)).otherwise(1.5 - F.round(F.least(signs / n * 4.0, F.lit(1.0)), 6))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target; a row for each source, so small.

    Sources are capped at ``max_epochs`` times their size and the excess is shared anew
    by weight: the target is min(cap, weight * level) for the level at which the targets
    add up. Sorted by cap / weight, the capped ones come first, so two prefix sums give it.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * float(max_epochs))
    before = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumns({
        "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest_w": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # It rises while capped sources are left out and falls from then on, so it is the largest.
    level = F.max(F.col("rest") / F.col("rest_w")).over(everything)
    return w.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0)))).select(
        "source", "source_size", "weight", "target"
    )


def sample_keys(docs: DataFrame, seed: int, quality) -> DataFrame:
    """(doc_id, source, size, key) of every document; key in [0, 1)."""
    t = text_or_empty("text")
    # Documents without an id draw by their text, so that they don't all have one key.
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64(t).cast("string"))))
    u = F.conv(F.substring(F.md5(ident), 1, 12), 16, 10).cast("double")
    return docs.select(
        "doc_id", "source", word_count(t).alias("size"),
        F.pow((u + 0.5) / TWO48, 1.0 / quality(t)).alias("key"), F.xxhash64(t).alias("tie"),
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 8, quality=quality_weight, bits: int = 12
) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every document."""
    keys = cut(sample_keys(docs, seed, quality), "mix-keys").withColumn(
        "slice", F.least(F.floor((1.0 - F.col("key")) * float(1 << bits)), F.lit((1 << bits) - 1)).cast("int")
    )
    per_slice = keys.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    slices = cut(per_slice, "mix-slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumn("left", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    # At most 2^bits rows for each source are ordered here, whatever the source's size.
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    plan = slices.withColumn("done", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    plan = plan.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("source"), "slice", "slice_size", "done", "source_size", "target", "epochs", "left"
    )
    k = keys.alias("k").join(plan.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.slice") == F.col("p.slice"))).select(
        "k.doc_id", "k.source", "k.size", "k.key", "k.tie", "k.slice", "slice_size", "done", "source_size", "target", "epochs", "left"
    )
    whole = F.col("done") + F.col("slice_size") <= F.col("left")
    none = F.col("done") >= F.col("left")
    base = F.col("epochs") * F.col("size")
    clear = k.filter(whole | none).withColumn("taken", base + F.when(whole, F.col("size")).otherwise(0))
    order = W.partitionBy("source").orderBy(F.col("key").desc(), "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    edge = k.filter(~(whole | none)).withColumn("__before", F.col("done") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("taken", base + F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("__before"))))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return clear.select(*cols).unionByName(edge.select(*cols))


def op8_mix_sources(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {
    "op8_mix_sources": r"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
s as (select *, len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint size from d),
q as (select *, case when len(t) = 0 then 0.5 else 1.5 - round(least((len(t) - len(translate(t, '#*$%&|<>!0123456789', ''))) / len(t)::double * 4.0, 1.0), 6) end w,
        (('0x' || substr(md5('8:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint + 0.5::double) / 281474976710656::double u from s),
k as (select *, pow(u, 1.0::double / w) key from q),
src as (select source, sum(size)::bigint source_size from s group by 1),
n as (select *, 1.0::double + (row_number() over (order by source nulls last) - 1) % 3 weight, 3.0::double * source_size cap from src),
r as (select *, sum(source_size) over ()::double - coalesce(sum(cap) over b, 0) rest, sum(weight) over () - coalesce(sum(weight) over b, 0) rest_w
      from n window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select *, least(cap, weight * coalesce((select max(rest / rest_w) from r), 0)) target from r),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint epochs from t),
f as (select k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target)::bigint - e.epochs * e.source_size rem,
        coalesce(sum(k.size) over (partition by k.source order by k.key desc, k.doc_id rows between unbounded preceding and 1 preceding), 0) done
      from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rem - done)))::bigint taken from f
"""
}
