"""Column functions on text: tokens, estimates, normal forms, keys, excerpts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LATIN = "[a-zA-Z0-9_+.#:/-]+"
CJK = "[㐀-鿿]"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenize(text: Column) -> Column:
    """Lower-cased Latin runs, then for each CJK run the run, its bigrams and, up to six signs, the signs."""

    def of_run(r: Column) -> Column:
        n = F.length(r)
        none = F.array().cast("array<string>")
        bigrams = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(none)
        signs = F.when(n <= 6, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(r, i, F.lit(1)))).otherwise(none)
        return F.concat(F.array(r), bigrams, signs)

    return bind(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda t: F.concat(
            F.regexp_extract_all(t, F.lit(LATIN), F.lit(0)),
            F.flatten(F.transform(F.regexp_extract_all(t, F.lit(CJK + "+"), F.lit(0)), of_run)),
        ),
    )


def routing_tokens(text: Column) -> Column:
    """Distinct tokens that say something about the topic: with a letter or digit, or of three signs."""
    return F.array_distinct(F.filter(tokenize(text), lambda t: t.rlike("[a-z0-9]") | (F.length(t) >= 3)))


def estimate_tokens(text: Column) -> Column:
    """CJK signs plus a quarter of the other UTF-8 bytes, at least 1; 0 for no text."""
    rest = F.octet_length(F.regexp_replace(text, CJK, ""))
    n = F.regexp_count(text, F.lit(CJK)) + F.ceil(rest / 4)
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(F.lit(1), n)).cast("long")


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: [None if t is None else unicodedata.normalize("NFKC", t) for t in ts], na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; Spark has no function for it, so batches of strings go through Python, but only those beyond ASCII, which has no other form."""
    beyond = F.when(F.octet_length(text) != F.length(text), text)
    return F.coalesce(F.pandas_udf(_nfkc, StringType())(beyond), text)


def normalized_query(text: Column) -> Column:
    """Compatibility form, white space as single blanks, trimmed; empty for null."""
    return F.trim(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def exact_name(text: Column) -> Column:
    """Compatibility form in lower case without white space: equal names are equal."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"(?U)\s+", "")


def exact_names(names: Column) -> Column:
    """``exact_name`` of each name of an array."""
    even = F.pandas_udf(_nfkc_each, ArrayType(StringType()))(names)
    return F.transform(even, lambda n: F.regexp_replace(F.lower(n), r"(?U)\s+", ""))


def normalize_text(text: Column) -> Column:
    """Line ends as \\n, no NUL, no blanks at line ends, at most one empty line in a row, trimmed."""
    t = F.regexp_replace(text, "\r\n|\r", "\n")
    t = F.replace(t, F.lit("\x00"), F.lit(""))
    t = F.regexp_replace(t, "[ \t\x0b\x0c]+(?=\n|$)", "")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^[ \t\n\x0b\x0c]+|[ \t\n\x0b\x0c]+$", "")


def normalized_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\x0b\x0c\r]+", " ")))


def dedup_key(text: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def signature_tokens(text: Column, stop: list[str] = ()) -> Column:
    """Distinct identifiers with digits as #, and CJK runs of two or more, without stop words."""
    t = F.regexp_replace(F.lower(text), "[0-9]+", "#")
    found = F.regexp_extract_all(t, F.lit("[a-z_#][a-z0-9_#.-]+|[㐀-鿿]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def clip(text: Column, n: int) -> Column:
    """The first quarter and the tail of a text that is longer than n."""
    head = n // 4
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, head), F.lit(" ... "), F.substr(text, F.length(text) - (n - head) + 1, F.lit(n - head)))
    )


def strip_fence(text: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def placeholders(text: Column) -> Column:
    """Distinct <name> and {{name}} marks, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<[A-Za-z][A-Za-z0-9_ -]*>|\{\{[^{}]+\}\}"), F.lit(0)))


def normalize_placeholders(text: Column) -> Column:
    """{{x}} as <x>; [a|b] as its longer form."""
    t = F.regexp_replace(text, r"\{\{\s*([A-Za-z0-9_ -]+?)\s*\}\}", "<$1>")
    return F.regexp_replace(t, r"\[(-[A-Za-z])\|(--[A-Za-z-]+)\]", "$2")


def quote_posix(value: Column) -> Column:
    safe = value.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(safe, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def quote_powershell(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_cmd(value: Column) -> Column:
    """Null where cmd.exe would read a sign of the value as its own."""
    return F.when(value.rlike(r'[&|<>^%!"\r\n]'), F.lit(None)).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


# What marks {{...}} as a template of a command's own output format
TEMPLATE = r"\.[A-Za-z]|[$(]|(?:json|range|end|index|if|with|else)\b"


def catalog_command(text: Column) -> Column:
    """A page's command with its slots as <name>.

    {{[short|long]}} becomes its last choice, {{slot}} becomes <slot>, also with one level of braces
    within, as in {{a/{b,c}}}. Escaped \\{\\{ and \\}\\} are plain braces, and so are those of templates in
    a command with --format. Names in <> lose their outer white space; <> without a name stays.
    """
    t = F.replace(F.replace(text, F.lit("\\{\\{"), F.lit("\x00")), F.lit("\\}\\}"), F.lit("\x01"))
    kept = F.regexp_replace(t, r"\{\{(\s*(?:" + TEMPLATE + r")[^{}]*)\}\}", "\x00$1\x01")
    t = F.when(F.contains(t, F.lit("--format")), kept).otherwise(t)
    t = F.regexp_replace(t, r"\{\{\[(?:[^\]|]++\|)++([^\]|]++)\]\}\}", "$1")
    t = F.regexp_replace(t, r"\{\{((?:[^{}]++|\{[^{}]*+\})++)\}\}", "<$1>")
    t = F.replace(F.replace(t, F.lit("\x00"), F.lit("{{")), F.lit("\x01"), F.lit("}}"))
    return F.regexp_replace(t, r"(?U)(?<!<)<[\s&&[^\r\n]]*+([^<>\s](?:[^<>\r\n]*[^<>\s])?)[\s&&[^\r\n]]*+>(?!>)", "<$1>")


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def catalog_text(text: Column, code: bool = False) -> Column:
    """A catalog's text without control and format characters, with \\n as line end and no empty line at either end.

    Prose takes the compatibility form, loses the white space around each line and all but two of empty
    lines in a row; code takes the canonical form and loses white space at line ends only.
    """
    if code:
        t = F.coalesce(F.pandas_udf(_nfc, StringType())(F.when(F.octet_length(text) != F.length(text), text)), text)
    else:
        t = nfkc(text)
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"[\p{C}&&[^\n\t]]+", "")
    blank = r"[\s&&[^\n]]"
    t = F.regexp_replace(t, f"(?U)(?<!{blank}){blank}++(?=\n|\\z)", "")
    if not code:
        t = F.regexp_replace(t, f"(?U)(?<=\n|\\A){blank}++", "")
        t = F.regexp_replace(t, "\n{4,}", "\n\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"\A\n+", ""), r"(?<!\n)\n+\z", "")
