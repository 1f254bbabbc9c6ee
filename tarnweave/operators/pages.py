"""Pages of command examples: which page a name means, where alias pages lead, and the commands of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.text import bind, normalize_placeholders
from tarnweave.sources.tables import written

#: Folders that come first where several hold a page of one name; fixed values, best first.
PREFERRED = ["common", "linux"]
#: Commands taken from a page, and lines after a label in which its command may stand.
MOST, WITHIN = 8, 4


def page_examples(text: Column) -> Column:
    """array of (label, code): each line after ``- `` with the first code line among the four that follow it."""

    def of(lines: Column) -> Column:
        code = lambda x: F.startswith(F.trim(x), F.lit("`")) & F.endswith(F.trim(x), F.lit("`"))
        said = lambda i: F.filter(F.slice(lines, i + 2, WITHIN), code)
        found = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(F.when(F.startswith(x, F.lit("- ")), said(i)), F.lit(0)).alias("c")))
        label = lambda x: F.trim(F.regexp_replace(F.substring(x, 3, F.length(x)), "[:：]+$", ""))
        return F.transform(F.filter(found, lambda f: f["c"].isNotNull()), lambda f: F.struct(label(f["x"]).alias("label"), normalize_placeholders(F.btrim(F.trim(f["c"]), F.lit("`"))).alias("code")))

    return bind(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), of)


def preferred_pages(pages: DataFrame) -> DataFrame:
    """pages (name, folder, path, text) -> the page that each name means: preferred folders first, then the least path."""
    rank = F.when(F.col("folder") == PREFERRED[0], 0).when(F.col("folder") == PREFERRED[1], 1).otherwise(2)
    best = pages.filter("name is not null").groupBy("name").agg(F.min_by(F.struct("folder", "path", "text"), F.struct(rank, "path")).alias("p"))
    return best.select("name", "p.*")


def follow_aliases(pages: DataFrame, pointer: str) -> DataFrame:
    """pages (name, text) -> name, target, status: where the examples of alias pages lead, over any number of steps.

    A page is an alias if it has examples and all their codes start with ``pointer``, a word and a blank; the rest of the first one's words, without options,
    joined by hyphens, is the page it points at. Status is ``page`` (leads to itself), ``alias``, ``missing`` (the way ends at a name without
    a page, which is the target) or ``cycle`` (it never ends: the target is the least name of those met).

    Pointer jumping: in each round every alias takes over its target's target, so a chain of n pages takes log2(n) rounds; only
    aliases take part. Rounds stop when none is left on its way, or when even the longest possible chain would have ended: what is left then runs in a cycle.
    """
    examples = pages.select("name", page_examples(F.col("text")).alias("e"))
    points = (F.size("e") > 0) & F.forall("e", lambda x: F.startswith(x["code"], F.lit(pointer)))
    word = F.filter(F.split(F.trim(F.substring(F.get("e", F.lit(0))["code"], len(pointer) + 1, 1 << 20)), r"\s+"), lambda w: ~F.startswith(w, F.lit("-")))
    named = examples.select("name", F.when(points, F.array_join(word, "-")).alias("to"))
    named = written(named.groupBy("name").agg(F.min("to").alias("to")), "names")
    aliases = named.filter("to is not null")
    # ``least`` is the least name on the way so far.
    ends = named.select(F.col("name").alias("to"), F.col("to").isNotNull().alias("on"))
    way = written(aliases.join(ends, "to", "left").select("name", "to", F.coalesce("on", F.lit(False)).alias("on"), F.least("name", "to").alias("least")), "way")
    left, rounds = way.filter("on").count(), 0
    longest = way.count()
    while left and (1 << rounds) <= longest:
        step = way.select(F.col("name").alias("at"), F.col("to").alias("next"), F.col("on").alias("next_on"), F.col("least").alias("next_least"))
        way = way.join(step, (F.col("to") == F.col("at")) & F.col("on"), "left")
        way = written(
            way.select("name", F.coalesce("next", "to").alias("to"), F.coalesce("next_on", F.lit(False)).alias("on"), F.least("least", "next_least").alias("least")), "way"
        )
        left, rounds = way.filter("on").count(), rounds + 1
    there = named.select(F.col("name").alias("to"), F.lit(True).alias("there"))
    ended = way.join(there, "to", "left")
    status = F.when(F.col("on"), "cycle").when(F.col("there"), "alias").otherwise("missing")
    ended = ended.select("name", F.when(F.col("on"), F.col("least")).otherwise(F.col("to")).alias("target"), status.alias("status"))
    return named.filter("to is null").select("name", F.col("name").alias("target"), F.lit("page").alias("status")).unionByName(ended)


def scan_pages(pages: DataFrame, pointer: str, most: int = MOST) -> DataFrame:
    """pages (name, folder, path, text) -> name, target, status, path, pos, label, code: the first ``most`` commands each name leads to.

    Pointers are no commands. A name that leads nowhere, in a circle, or to a page without commands has one row without code.
    """
    best = written(preferred_pages(pages), "pages")
    found = F.filter(page_examples(F.col("text")), lambda x: ~F.startswith(x["code"], F.lit(pointer)))
    commands = best.select(F.col("name").alias("target"), "path", F.slice(found, 1, most).alias("e"))
    led = follow_aliases(best.select("name", "text"), pointer)
    whole = led.join(commands.withColumn("ok", F.lit(True)), (led["target"] == commands["target"]) & led["status"].isin("page", "alias"), "left").drop(commands["target"])
    return whole.select("name", "target", "status", "path", F.posexplode_outer("e").alias("pos", "x")).select("name", "target", "status", "path", "pos", "x.label", "x.code")
