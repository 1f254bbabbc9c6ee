"""URL filters (operator 3), DataFrame functions only.

Two kinds of things are listed. A listed canonical URL covers the pages whose URL has that
canonical form. A rule is ``host + path prefix`` with a verdict; it covers the host and
its subdomains and all paths that start with the prefix, and comes before listed URLs.
Every URL is turned into the keys under which it could be listed: its canonical form, and
host suffixes times path prefixes of listed lengths. A blocked Bloom filter of all listed
keys lets possible hits through; a hash join with the keys themselves removes its
false positives; the longest rule wins.

The filter is a table with a row of four 64-bit words for each 256-bit block, so
it is probed by a join on the block number, which Spark broadcasts only below
``broadcast_bytes`` and shuffles otherwise; it never has to fit a driver.

Canonical form: no scheme, user, default port, fragment or tracking parameter; host in
lower case without a final dot; escapes of unreserved signs decoded, others in upper case;
dot segments resolved; no final slash; parameters sorted.

Cases: a null URL or one without ``://`` has an empty host and path, no canonical form, and
gets the default verdict; ``page_id`` may be null or repeated as only URLs are joined; of
two equal listed keys ``block`` wins; empty lists leave every URL to the default. Input
columns named host, path, rule or verdict are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import built_in_memory, let, lower_ascii

#: host, path prefix, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Sites whose pages the query lists; fixed values.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Parameters that only track a visit; fixed values.
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_[ce]id|igshid|ref|sessionid|sid|phpsessid|jsessionid)(?:=|$)"
BITS_PER_KEY = 16
BLOCK_BITS = 256


def host_and_path(url: Column) -> Column:
    """struct(host, path): after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?``, ``#``."""
    return let(
        F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit("")),
        lambda rest: let(
            F.regexp_extract(rest, r"^[^/?#]*", 0),
            lambda h: F.struct(
                lower_ascii(h).alias("host"),
                F.regexp_extract(F.substr(rest, F.length(h) + 1), r"^[^?#]*", 0).alias("path"),
            ),
        ),
    )


def _unescape(text: Column) -> Column:
    """Escapes of letters, digits and ``-._~`` decoded, other escapes in upper case; what is no escape stays."""

    def part(x: Column, i: Column) -> Column:
        code = F.conv(F.left(x, F.lit(2)), 16, 10).cast("int")
        plain = F.chr(code)
        decoded = F.when(plain.rlike(r"^[A-Za-z0-9._~-]$"), plain).otherwise(F.concat(F.lit("%"), F.upper(F.left(x, F.lit(2)))))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(decoded, F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%"), x))

    return F.when(F.contains(text, F.lit("%")), F.array_join(F.transform(F.split(text, "%", -1), part), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved."""
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    add = lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x)))
    resolved = let(F.split(path, "/", -1), lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.lit(1)), add))
    return F.when(F.contains(path, F.lit("/.")), F.array_join(resolved, "/")).otherwise(path)


def canonical(url: Column) -> Column:
    """The canonical form of a URL; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^[^:]*://(?:[^/?#@]*@)?([^#]*)", 1)

    def of(r: Column) -> Column:
        host = F.regexp_replace(lower_ascii(F.regexp_extract(r, r"^[^/?]*", 0)), r"(?::(?:80|443)?)?\z", "")
        host = F.regexp_replace(host, r"\.\z", "")
        path = F.regexp_replace(_without_dots(_unescape(F.regexp_extract(r, r"^[^/?]*([^?]*)", 1))), r"/+\z", "")
        query = F.regexp_extract(r, r"(?s)\?(.*)\z", 1)
        kept = F.array_sort(F.filter(F.split(_unescape(query), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
        return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))

    return F.when(F.contains(url, F.lit("://")), let(rest, of))


def _bloom_columns(key: Column, n_blocks: int) -> dict[str, Column]:
    """Block number, and the bit of each of the block's four words, from two hashes."""
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit(101), key)
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__h2, {6 * i}) & 63L as int))")
    return {"__h2": h2, "block": F.pmod(h1, F.lit(n_blocks))} | {f"m{i}": bit(i) for i in range(4)}


def with_bits(df: DataFrame, key: str, n_blocks: int) -> DataFrame:
    cols = _bloom_columns(F.col(key), n_blocks)
    df = df.withColumns({"__h2": cols.pop("__h2")})
    return df.withColumns(cols).drop("__h2")


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3): the filter; blocks without a key are absent."""
    return with_bits(listed.select(key), key, n_blocks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])


def _listed_keys(rules: DataFrame, urls: DataFrame | None) -> DataFrame:
    """(key, verdict, labels, len) of rules, and of canonical URLs behind a blank, which no host holds."""
    rules = rules.select(
        F.concat(lower_ascii(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))).alias("key"), "verdict",
        F.size(F.split(F.col("host"), r"\.")).alias("labels"), F.length(F.coalesce("path", F.lit(""))).alias("len"),
    ).filter("host is not null and host <> ''")
    if urls is None:
        return rules
    none = F.lit(None).cast("int")
    urls = urls.select(F.concat(F.lit(" "), canonical(F.col("url"))).alias("key"), "verdict", none.alias("labels"), none.alias("len"))
    return rules.unionByName(urls.filter("key is not null").distinct())


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", broadcast_bytes: int = 32 << 20, urls: DataFrame | None = None) -> DataFrame:
    """``pages`` (with ``url``) plus host, path, rule and verdict.

    listed: rules (host, path, verdict); urls: listed URLs (url, verdict) in any form. Their size
    is counted here and decides whether filter and list are broadcast.
    """
    keys = _listed_keys(listed, urls)
    shape = keys.agg(F.count("*"), F.max("labels"), F.sort_array(F.collect_set("len")), F.sum(F.octet_length("key") + 64)).first()
    n, labels, lengths, size = shape[0], shape[1] or 1, shape[2] or [0], shape[3] or 0
    n_blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    near = (lambda df: F.broadcast(df)) if size <= broadcast_bytes else (lambda df: built_in_memory(df, size))

    split_up = pages.select("url").distinct().withColumn("hp", host_and_path(F.col("url")))

    def candidates(hp: Column) -> Column:
        def by_suffix(parts: Column) -> Column:
            deepest = F.least(F.size(parts), F.lit(labels))
            suffixes = F.transform(
                F.sequence(F.lit(1), deepest), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".")
            )
            cuts = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length(hp["path"]))
            prefixes = F.transform(cuts, lambda x: F.substr(hp["path"], F.lit(1), x))
            return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))

        return let(F.split(hp["host"], r"\."), by_suffix)

    every = F.array_distinct(candidates(F.col("hp")))
    if urls is not None:
        every = F.concat(every, F.array_compact(F.array(F.concat(F.lit(" "), canonical(F.col("url"))))))
    probes = split_up.filter("hp.host <> ''").select("url", F.explode(every).alias("key"))
    blocks = bloom_blocks(keys, "key", n_blocks)
    possible = with_bits(probes, "key", n_blocks).join(near(blocks), "block")
    for i in range(4):
        possible = possible.filter((F.col(f"m{i}").bitwiseAND(F.col(f"w{i}"))) != 0)
    exact = keys.groupBy("key").agg(F.max("verdict").alias("verdict"))  # "block" > "allow"
    is_rule = ~F.startswith("key", F.lit(" "))
    best = (
        possible.select("url", "key").join(near(exact), "key")
        .groupBy("url").agg(
            F.max(F.when(is_rule, F.struct(F.length("key").alias("n"), "key", "verdict"))).alias("hit"),
            F.max(F.when(~is_rule, F.col("verdict"))).alias("of_url"),
        )
    )
    # One struct holds the row, so columns of any names stay apart from those of the join.
    rows = pages.select(F.struct(*pages.columns).alias("d"), F.col("url").alias("__url"))
    out = rows.join(best.withColumnRenamed("url", "__url"), "__url", "left").withColumn("hp", host_and_path(F.col("__url")))
    return out.select(
        *[F.col("d")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        F.col("hp.host").alias("host"), F.col("hp.path").alias("path"),
        F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", "of_url", F.lit(default)).alias("verdict"),
    )


def op3_url_filter(spark, sf_dir):
    """The four rules, and the URLs of all pages of the listed sites as listed URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    of_site = F.arrays_overlap(F.split(lower_ascii(F.regexp_extract("url", "://([^/?#:]*)", 1)), r"\."), F.array(*[F.lit(x) for x in LISTED_SITES]))
    urls = pages.filter(of_site).select("url", F.lit("block").alias("verdict"))
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge_urls(pages, rules, urls=urls).drop("url")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {
    "op3_url_filter": f"""
with a as (select page_id, case when contains(url, '://') then regexp_extract(url, '^.*?://(.*)$', 1, 's') else '' end rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) h from a),
c as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(substr(rest, len(h) + 1), '^[^?#]*', 0) path from b),
d as (select *, case {" ".join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} end rule from c)
select page_id, host, path, rule, case {" ".join(f"when rule = '{h}{p}' then '{v}'" for h, p, v in RULES)} when regexp_matches(host, '(^|\\.)({"|".join(LISTED_SITES)})(\\.|:|$)') then 'block' else 'allow' end verdict from d
"""
}
