"""JSON of any depth: the strings in it with their paths, and copies without secrets."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .safety import COUNTING_KEYS, GATE_CREDENTIALS, GATE_LABEL, GATE_SECRET_KEY


def _depth(text: Column) -> Column:
    """How many objects and arrays of JSON lie in each other: brackets that are open at once, those in strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    signs = F.split(F.translate(F.regexp_replace(bare, r"[^\[\]{}]", ""), "{}", "[]"), "")
    step = lambda a, s: F.struct((a["now"] + F.when(s == "[", 1).when(s == "]", -1).otherwise(0)).alias("now"), F.greatest(a["top"], a["now"] + F.when(s == "[", 1).otherwise(0)).alias("top"))
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda a: a["top"])


def leaves(rows: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """keys, path, kind, value: a row for each value of the JSON that holds no others. Paths are like ``$.a[2].b``.

    Level by level: an object or array is exploded into its members, anything else stays; so one pass without a shuffle, as many
    steps as the deepest of all JSON has levels, which one aggregate finds. Text that isn't JSON and empty containers give no rows.
    """
    v = rows.select(*keys, F.col(json_col).alias("text"), F.try_parse_json(F.col(json_col)).alias("v")).filter("v is not null")
    levels = v.agg(F.max(_depth(F.col("text")))).first()[0] or 0
    out = v.withColumn("path", F.lit("$"))
    member = "array<struct<step string, v variant>>"
    for _ in range(levels):
        obj = F.try_variant_get("v", F.lit("$"), "map<string,variant>")
        arr = F.try_variant_get("v", F.lit("$"), "array<variant>")
        of_obj = F.transform(F.map_entries(obj), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("v")))
        of_arr = F.transform(arr, lambda x, i: F.struct(F.concat(F.lit("["), i, F.lit("]")).alias("step"), x.alias("v")))
        itself = F.array(F.struct(F.lit("").alias("step"), F.col("v").alias("v")))
        held = F.schema_of_variant("v")
        members = F.when(F.startswith(held, F.lit("OBJECT")), of_obj).when(F.startswith(held, F.lit("ARRAY")), of_arr).otherwise(itself).cast(member)
        out = out.select(*keys, "path", F.explode(members).alias("m")).select(*keys, F.concat("path", "m.step").alias("path"), F.col("m.v").alias("v"))
    kind = F.schema_of_variant("v")
    out = out.select(*keys, "path", kind.alias("kind"), F.when(kind == "VOID", F.lit(None)).otherwise(F.try_variant_get("v", F.lit("$"), "string")).alias("value"))
    return out.filter(~F.startswith("kind", F.lit("OBJECT")) & ~F.startswith("kind", F.lit("ARRAY")))


def find_leaks(rows: DataFrame, json_col: str, keys: list[str], patterns=GATE_CREDENTIALS) -> DataFrame:
    """keys, path of each string, however deep, that looks like a credential."""
    looks = reduce(lambda a, p: a | F.col("value").rlike(p), patterns, F.lit(False))
    return leaves(rows, json_col, keys).filter("kind = 'STRING'").filter(looks).select(*keys, "path")


def _redacted(value, key: re.Pattern, patterns: list[re.Pattern], label: str):
    if isinstance(value, dict):
        secret = lambda k: key.search(k) and k.casefold() not in COUNTING_KEYS
        return {k: label if secret(k) else _redacted(v, key, patterns, label) for k, v in value.items()}
    if isinstance(value, list):
        return [_redacted(v, key, patterns, label) for v in value]
    if isinstance(value, str):
        return reduce(lambda t, p: p.sub(label, t), patterns, value)
    return value


@F.arrow_udf(T.StringType())
def redact_json(texts: pa.Array) -> pa.Array:
    """A copy of JSON in which fields with a secret's name are replaced whole, at any depth, and credentials in other strings in place.

    Text that isn't JSON becomes null, so that it can't be shown by mistake.
    """
    key, patterns = re.compile(GATE_SECRET_KEY), [re.compile(p) for p in GATE_CREDENTIALS]

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_redacted(json.loads(text), key, patterns, GATE_LABEL), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return pa.array(map(one, texts.to_pylist()), pa.string())
