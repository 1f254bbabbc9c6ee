"""What a question asks for: shell and platform, a focused wording, what "the second one" refers to, and whose topics count."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnweave.functions.text import exact_name, exact_names, normalized_query, routing_tokens
from tarnweave.sources.tables import written

#: Hints in order: the first group that a question holds decides shell and platform. Fixed values.
PLATFORM_HINTS = [
    (("powershell", "pwsh"), "powershell", "windows"),
    (("cmd.exe", "cmd", "命令提示符", "批处理"), "cmd", "windows"),
    (("windows", "win10", "win11", "windows server"), None, "windows"),
    (("bash", "posix", "unix", "linux", "ubuntu", "macos", "mac os"), "posix", "posix"),
]
#: Words that say nothing about the topic; fixed values.
FILLERS = (
    "请问|请|告诉我|帮我|帮忙|我想|我需要|能否|可以|如何|怎么|怎样|有什么办法|一下|的|是什么|指令|命令|操作"
    "|(?<![a-z])how\\s+to(?![a-z])|(?<![a-z])how(?![a-z])|(?<![a-z])can\\s+you(?![a-z])|(?<![a-z])please(?![a-z])"
)
EDGE_SIGNS = " ，,。.!！？?：:;"
#: Words by which a question refers to the one before it, and places in a list; fixed values.
REFERS = "(?i)(?:\\b(?:it|that|this|them|those|same|above|previous)\\b|这个|那个|上面|刚才|它|换成|呢)"
ORDINAL = "(?i)(?:第\\s*([一二三123])\\s*(?:个|条|种)?|\\b(?:the\\s+)?(first|second|third)\\b)"


def has_hint(text: Column, hint: str) -> Column:
    """Whether a text names a hint; Latin hints only as whole words, and ``cmd`` not as a part of firewall-cmd."""
    low = F.lower(text)
    if not re.search("[a-z0-9]", hint):
        return F.contains(low, F.lit(hint))
    edge = "a-z0-9-" if hint == "cmd" else "a-z0-9"
    return low.rlike(f"(?<![{edge}]){re.escape(hint)}(?![{edge}])")


def shell_and_platform(text: Column) -> Column:
    """struct(shell, platform) that a question names, null where it names none."""
    out = F.struct(F.lit(None).cast("string").alias("shell"), F.lit(None).cast("string").alias("platform"))
    for hints, shell, platform in reversed(PLATFORM_HINTS):
        any_ = F.lit(False)
        for h in hints:
            any_ |= has_hint(text, h)
        out = F.when(any_, F.struct(F.lit(shell).cast("string").alias("shell"), F.lit(platform).alias("platform"))).otherwise(out)
    return out


def focused_variant(text: Column) -> Column:
    """A question without filler words and without signs at its ends."""
    return F.btrim(normalized_query(F.regexp_replace(text, f"(?i)(?:{FILLERS})", " ")), F.lit(EDGE_SIGNS))


def scope(topics: DataFrame, base: str, default: str = "default") -> DataFrame:
    """Topics (kb, builtin) of one knowledge base; built-in ones only belong to the default one."""
    return topics.filter(((F.col("kb") == base) & ~F.col("builtin")) | (F.col("builtin") & F.lit(base == default)))


def contextual_rewrite(query: Column, previous: Column, labels: Column, sources: Column, technologies: list[str]) -> Column:
    """A follow-up made to stand alone, from the question before it and the labels and sources of its answer.

    One that refers to nothing, or has nothing before it, stays. Another technology than the one before
    takes its place in the old question; an ordinal names a label; else the first two sources or all labels come along.
    """
    named = lambda t: F.get(F.filter(F.array(*[F.lit(x) for x in technologies]), lambda x: F.contains(F.lower(t), x)), F.lit(0))
    q, p = F.trim(query), F.trim(previous)
    target, old = named(q), named(p)
    swapped = F.when(target.isNotNull() & old.isNotNull() & (target != old), F.replace(F.lower(p), old, target))
    word = F.coalesce(F.nullif(F.regexp_extract(q, ORDINAL, 1), F.lit("")), F.lower(F.regexp_extract(q, ORDINAL, 2)))
    place = F.when(word.isin("一", "1", "first"), 0).when(word.isin("二", "2", "second"), 1).when(word.isin("三", "3", "third"), 2)
    picked = F.get(labels, place)
    listed = lambda a, n: F.array_join(F.slice(a, F.lit(1), F.lit(n)), ", ")
    rewritten = (
        F.when(swapped.isNotNull(), F.concat(swapped, F.lit("; also: "), q))
        .when(picked.isNotNull(), F.concat(F.coalesce(old, p), F.lit("; option: "), picked, F.lit("; follow-up: "), q))
        .when(F.size(sources) > 0, F.concat(p, F.lit("; sources: "), listed(sources, 2), F.lit("; follow-up: "), q))
        .when(F.size(labels) > 0, F.concat(p, F.lit("; options: "), listed(labels, 6), F.lit("; follow-up: "), q))
        .otherwise(F.concat(p, F.lit("; follow-up: "), q))
    )
    return F.when(F.coalesce(p, F.lit("")).eqNullSafe("") | ~(q.rlike(REFERS) | q.rlike(ORDINAL)), q).otherwise(rewritten)


#: Words by which a question shows what it is after, in order; fixed values.
INTENTS = [
    ("template", ("模板", "范例", "示例", "template", "example")), ("compare", ("比较", "区别", "差异", "对比", "compare", "difference")),
    ("document_lookup", ("文档", "哪一段", "原文", "来源", "引用", "出处")), ("command", ("命令", "指令", "执行", "运行", "怎么", "如何", "command")),
]
CONJUNCTION = r"\s*(?:以及|并且|同时|另外|然后|和|还有|及|,|，|;|；)\s*"


def intent_of(text: Column) -> Column:
    """The first intent one of whose words a question holds, ``command`` also for how; else knowledge."""
    low, out = F.lower(text), F.lit("knowledge")
    for name, words in reversed(INTENTS):
        any_ = low.rlike("(?<![a-z])how(?![a-z])") if name == "command" else F.lit(False)
        for w in words:
            any_ |= F.contains(low, F.lit(w))
        out = F.when(any_, name).otherwise(out)
    return out


def infer_domain(queries: DataFrame, topics: DataFrame, hints: dict[str, list[str]], stop: list[str] = ()) -> DataFrame:
    """queries (query_id, text), topics (domain, title, aliases) -> query_id, domain, null where nothing or too little decides.

    A question that is a name of one domain only has that domain. Else each hint counts 1 and each
    word of a topic's names its weight, by the length of the name; the best domain must lead by .75.
    """
    name = F.explode(F.array_compact(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))))
    names = written(topics.select("domain", name.alias("name")).distinct(), "names")
    owners = names.select("domain", F.explode(exact_names(F.array("name"))).alias("exact")).groupBy("exact").agg(F.min("domain").alias("d0"), F.max("domain").alias("d1"))
    n = F.length(normalized_query(F.col("name")))
    usable = names.withColumn("w", F.least(n, F.lit(32)) / 32.0).filter((n >= 3) & ~F.contains("name", F.lit("<")))
    weights = usable.select("domain", "w", F.explode(routing_tokens(F.col("name"))).alias("token")).filter((F.length("token") >= 3) & ~F.col("token").isin(*stop))
    weights = weights.groupBy("token", "domain").agg(F.max("w").alias("w"))
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    by_word = q.select("query_id", F.explode(routing_tokens(F.col("text"))).alias("token")).join(weights, "token").groupBy("query_id", "domain").agg(F.sum("w").alias("s"))
    scores = by_word
    if hints:
        count = lambda words: sum((has_hint(F.col("text"), h).cast("double") for h in words[1:]), has_hint(F.col("text"), words[0]).cast("double"))
        each = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), count(words).alias("s")) for d, words in hints.items()]))
        known = topics.select("domain").distinct()
        scores = scores.unionByName(q.select("query_id", each.alias("h")).select("query_id", "h.*").filter("s > 0").join(F.broadcast(known), "domain", "left_semi").select("query_id", "domain", "s"))
    total = scores.groupBy("query_id", "domain").agg(F.round(F.sum("s"), 9).alias("s"))
    w = W.partitionBy("query_id").orderBy(F.col("s").desc(), "domain")
    best = total.withColumns({"n": F.row_number().over(w), "next": F.lead("s").over(w)}).filter("n = 1").select("query_id", F.when(F.col("next").isNull() | (F.col("s") - F.col("next") >= 0.75), F.col("domain")).alias("scored"))
    named = q.select("query_id", exact_name(F.col("text")).alias("exact")).join(owners.filter("d0 = d1"), "exact").select("query_id", F.col("d0").alias("named"))
    return q.select("query_id").join(named, "query_id", "left").join(best, "query_id", "left").select("query_id", F.coalesce("named", "scored").alias("domain"))


def question_plan(queries: DataFrame, topics: DataFrame, hints: dict[str, list[str]], stop: list[str] = ()) -> DataFrame:
    """queries (query_id, text) -> original, variants (at most four, the original first), intent, domain, platform, shell, decomposed.

    Parts between conjunctions become variants only if two or more have domains of their own, at least two different ones.
    A command, template or document question that is not decomposed keeps its original wording only.
    """
    q = queries.select("query_id", normalized_query(F.col("text")).alias("original"))
    parts = q.select("query_id", F.posexplode(F.filter(F.split("original", CONJUNCTION), lambda x: F.trim(x) != "")).alias("pos", "part"))
    parts = written(parts.withColumn("part_id", F.concat_ws(":", "query_id", "pos")), "parts")
    of_part = infer_domain(parts.select(F.col("part_id").alias("query_id"), F.col("part").alias("text")), topics, hints, stop).withColumnRenamed("query_id", "part_id")
    known = parts.join(of_part, "part_id").filter("domain is not null")
    seen = known.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]).alias("parts"), F.countDistinct("domain").alias("n_domains")
    )
    whole = infer_domain(q.select("query_id", F.col("original").alias("text")), topics, hints, stop)
    p = q.join(seen, "query_id", "left").join(whole, "query_id", "left").withColumns({
        "focused": focused_variant(F.col("original")), "intent": intent_of(F.col("original")), "place": shell_and_platform(F.col("original")),
        "n_domains": F.coalesce("n_domains", F.lit(0)), "parts": F.coalesce("parts", F.array().cast("array<string>")),
    })
    many = (F.size("parts") >= 2) & (F.col("n_domains") >= 2)
    own = F.when((F.col("focused") != "") & (F.lower("focused") != F.lower("original")), F.array("focused")).otherwise(F.array().cast("array<string>"))
    every = F.slice(F.array_distinct(F.filter(F.concat(F.array("original"), own, F.when(many, F.col("parts")).otherwise(F.array().cast("array<string>"))), lambda x: x != "")), 1, 4)
    alone = F.col("intent").isin("command", "template", "document_lookup") & ~many
    return p.select(
        "query_id", "original", F.when(alone, F.filter(F.array("original"), lambda x: x != "")).otherwise(every).alias("variants"), "intent",
        F.when(F.col("n_domains") <= 1, F.col("domain")).alias("domain"), "place.platform", "place.shell", many.alias("decomposed"),
    )
