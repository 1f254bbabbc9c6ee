"""Records that models and catalogs hand in: normal forms, checks, keys to compare by, fingerprints and typed slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import safety
from tarnweave.functions.text import bind

#: Other names of languages and shells; fixed values.
LANGUAGES = {"sh": "bash", "shell": "bash", "zsh": "bash", "console": "bash", "mysql": "sql", "postgresql": "sql", "postgres": "sql", "ps1": "powershell", "pwsh": "powershell", "cmd": "text"}
SHELLS = {"pwsh": "powershell", "ps1": "powershell", "powershell": "powershell", "cmd": "cmd", "cmd.exe": "cmd", "bash": "bash", "sh": "bash", "zsh": "bash", "posix": "posix"}
#: What values of typed slots look like; fixed values.
SLOTS = {
    "path": r"^(?:~|\.{1,2}|/|[A-Za-z]:[\\/])?[\w.@+/\\ -]+$", "name": r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,62}$", "commit": r"^(?:[0-9a-f]{7,40}|HEAD(?:[~^][0-9]*)*)$",
    "image": r"^[a-z0-9]+(?:[._/-][a-z0-9]+)*(?::[A-Za-z0-9_][A-Za-z0-9_.-]{0,127})?(?:@sha256:[0-9a-f]{64})?$", "port": r"^[0-9]{1,5}$",
}


def _mapped(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value)


def dedup_strings(values: Column) -> Column:
    """struct(kept, n_removed): the first of strings that are equal but for case and outer blanks; empty ones go."""
    def of(v: Column) -> Column:
        keys = F.transform(v, lambda x: F.lower(F.trim(x)))
        kept = F.filter(v, lambda x, i: (F.trim(x) != "") & (F.array_position(keys, F.lower(F.trim(x))) == i + 1))
        return F.struct(kept.alias("kept"), (F.size(v) - F.size(kept)).cast("long").alias("n_removed"))

    return bind(F.array_compact(F.coalesce(values, F.array().cast("array<string>"))), of)


def draft_commands(commands: Column) -> Column:
    """array of (label, code, language, shell, risk, warning, platforms) as a model drafts them, made regular; those without code go."""
    def one(c: Column) -> Column:
        low = F.lower(F.coalesce(c["language"], F.lit("text")))
        language = F.coalesce(_mapped(low, LANGUAGES), low)
        language = F.when(language.isin("bash", "sql", "powershell", "text"), language).otherwise("text")
        shell = _mapped(F.lower(F.trim(F.coalesce(c["shell"], F.lit("")))), SHELLS)
        return F.struct(
            F.coalesce(F.nullif(c["label"], F.lit("")), F.lit("command")).alias("label"), c["code"].alias("code"), language.alias("language"),
            F.coalesce(shell, F.when(language == "powershell", "powershell")).alias("shell"),
            F.when(c["risk"].isin("low", "medium", "high"), c["risk"]).otherwise("low").alias("risk"), F.nullif(c["warning"], F.lit("")).alias("warning"),
            F.coalesce(c["platforms"], F.array().cast("array<string>")).alias("platforms"),
        )

    return F.transform(F.filter(F.coalesce(commands, F.array()), lambda c: F.trim(F.coalesce(c["code"], F.lit(""))) != ""), one)


def match_keys(code: Column) -> Column:
    """struct(strict, blind, loose): a command without blanks at line ends; with any placeholder alike; without quotes and with single blanks too."""
    strict = F.regexp_replace(F.btrim(F.replace(code, F.lit("\r\n"), F.lit("\n")), F.lit(" \t\n")), r"[ \t]+(?=\n|\z)", "")
    blind = F.regexp_replace(strict, r"<[^<>\r\n]+>", "<placeholder>")
    loose = F.regexp_replace(F.translate(blind, "\"'`“”‘’", ""), r"[ \t]+", " ")
    return F.struct(strict.alias("strict"), blind.alias("blind"), loose.alias("loose"))


def argument_error(json: Column, schema: dict[str, dict], required: list[str]) -> Column:
    """The first thing wrong with a tool call's arguments, or null. schema: name -> {type, enum}.

    Types are integer, number, string, boolean. Required ones are looked at first, then unknown ones, then each in order.
    """
    v = F.try_parse_json(json)
    kinds = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",)}
    of = lambda name: F.schema_of_variant(F.try_variant_get(v, F.lit(f"$.{name}"), "variant"))
    known = F.array(*[F.lit(n) for n in schema])
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    out = F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit("object"))
    for name in required:
        out = out.when(~F.array_contains(keys, name), F.lit(f"missing {name}"))
    out = out.when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown "), F.get(F.array_except(keys, known), F.lit(0))))
    for name, spec in schema.items():
        there = F.array_contains(keys, name)
        fits = F.lit(False)
        for k in kinds[spec["type"]]:
            fits |= F.startswith(of(name), F.lit(k))
        out = out.when(there & ~F.coalesce(fits, F.lit(False)), F.lit(f"type {name}"))
        if "enum" in spec:
            value = F.try_variant_get(v, F.lit(f"$.{name}"), "string")
            out = out.when(there & ~F.coalesce(value.isin(*[str(x) for x in spec["enum"]]), F.lit(False)), F.lit(f"enum {name}"))
    return out


def value_fingerprint(value: Column) -> Column:
    """SHA-256 of a trimmed value; null for none, so a secret is compared but not kept."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(None)).otherwise(F.sha2(F.trim(value), 256))


def profile_fingerprint(profile: Column) -> Column:
    """SHA-256 of a map's redacted entries in key order."""
    safe = F.transform(F.array_sort(F.map_entries(profile)), lambda e: F.struct(e["key"].alias("key"), F.when(safety.is_secret_key(e["key"]), F.lit(safety.LABEL)).otherwise(safety.redact_report(e["value"])).alias("value")))
    return F.when(profile.isNull(), F.lit(None)).otherwise(F.sha2(F.to_json(F.map_from_entries(safe)), 256))


def slot(kind: str, value: Column) -> Column:
    """The value of a typed slot without quotes and outer blanks, or null if it isn't one."""
    v = F.btrim(F.trim(value), F.lit("\"'`"))
    ok = v.rlike(SLOTS[kind])
    if kind == "port":
        ok &= v.try_cast("int").between(1, 65535)
    return F.when(F.coalesce(ok, F.lit(False)), v)


def iso_time(value: Column) -> Column:
    """A timestamp from ISO text, with Z as UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(value), "Z$", "+00:00"))


def record_errors(records: DataFrame) -> DataFrame:
    """records (id, title, domain, risk, commands, warning) -> id, rule for each rule that a catalog record breaks."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    c = F.col("commands")
    rules = {
        "title": blank(F.col("title")), "domain": blank(F.col("domain")), "no_commands": F.coalesce(F.size(c), F.lit(0)) <= 0,
        "risk": ~F.coalesce(F.col("risk").isin("low", "medium", "high"), F.lit(False)),
        "empty_code": F.exists(c, lambda x: blank(x["code"])), "high_risk_without_warning": (F.col("risk") == "high") & blank(F.col("warning")),
        "powershell_without_windows": F.exists(c, lambda x: (x["language"] == "powershell") & ~F.array_contains(x["platforms"], "windows")),
        "broken_placeholder": F.exists(c, lambda x: F.regexp_count(x["code"], F.lit("<[A-Za-z]")) != F.regexp_count(x["code"], F.lit("<[A-Za-z][^<>]*>"))),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return records.select("id", F.explode(found).alias("rule"))


def distinct_commands(commands: Column) -> Column:
    """The first of the commands with equal code, language, shell and platforms, in order."""
    key = lambda x: F.concat_ws("\u001f", F.trim(x["code"]), x["language"], F.coalesce(x["shell"], F.lit("")), F.array_join(F.array_sort(x["platforms"]), ","))
    return bind(F.transform(commands, key), lambda keys: F.filter(commands, lambda x, i: F.array_position(keys, key(x)) == i + 1))


#: Marks that stand for themselves, and words in a placeholder's name that tell what goes there; fixed values, in the order they are tried.
LITERAL_MARKS = ["enter", "tab", "space", "80", "443", "8.8.8.8", "2.7.10", "0c01a9", "9a1743"]
PLACEHOLDER_KINDS = {
    "credential": ["password", "passwd", "token", "secret", "private_key", "credential"],
    "path": ["path", "file", "dir", "directory", "folder", "filename", "backup.sql"],
    "identifier": ["branch", "commit", "tag", "repo", "repository", "database", "db", "table", "column", "user", "host", "image", "container", "key", "field", "channel"],
}
PORT_NAMES = ["port", "port_number", "localport", "remoteport"]
#: What fences call a language; fixed values.
FENCE_HINTS = {"sh": "bash", "shell": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell", "pwsh": "powershell", "powershell": "powershell", "sql": "sql", "mysql": "sql", "postgres": "sql", "postgresql": "sql"}


def placeholder_kind(mark: Column) -> Column:
    """What a placeholder such as <log-file> stands for, by its name: literal, credential, port, path, identifier or else value.

    A guess for display: nothing is filled in by it. A port is one only by its whole name or its end, so <report-file> is a path.
    """
    name = F.trim(F.regexp_replace(mark, r"^<|>$", ""))
    low = F.lower(F.regexp_replace(name, r"\s+", " "))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return (
        F.when(low.isin(*LITERAL_MARKS) | name.rlike(r"^\[.+\]$"), "literal").when(has(PLACEHOLDER_KINDS["credential"]), "credential")
        .when(low.isin(*PORT_NAMES) | F.endswith(low, F.lit("_port")), "port").when(has(PLACEHOLDER_KINDS["path"]), "path")
        .when(has(PLACEHOLDER_KINDS["identifier"]), "identifier").otherwise("value")
    )


def typed_placeholders(code: Column) -> Column:
    """array of (name, kind, raw): the placeholders of a command, each name once whatever its case and blanks, in order of first use."""
    raw = F.regexp_extract_all(code, F.lit(r"(?<!<)<([^<>\r\n]+)>(?!>)"), F.lit(0))

    def of(marks: Column) -> Column:
        key = lambda m: F.lower(F.regexp_replace(F.trim(F.substring(m, 2, F.length(m) - 2)), r"\s+", " "))
        keys = F.transform(marks, key)
        first = F.filter(marks, lambda m, i: (key(m) != "") & (F.array_position(keys, key(m)) == i + 1))
        return F.transform(first, lambda m: F.struct(F.trim(F.substring(m, 2, F.length(m) - 2)).alias("name"), placeholder_kind(m).alias("kind"), m.alias("raw")))

    return bind(raw, of)


def language_of(hint: Column, code: Column) -> Column:
    """bash, sql, powershell or text: by the fence's word for it, else by how the code begins."""
    h = _mapped(F.lower(F.trim(F.coalesce(hint, F.lit("")))), FENCE_HINTS)
    return (
        F.when(h.isNotNull(), h).when(code.rlike(r"^(?:Get|Set|New|Remove|Test|Invoke|Start|Stop)-[A-Za-z]"), "powershell")
        .when(code.rlike(r"(?i)^(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b"), "sql").when(F.coalesce(code, F.lit("")) != "", "bash").otherwise("text")
    )
