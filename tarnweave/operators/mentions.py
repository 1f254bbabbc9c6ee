"""What texts mention, in order: commands in code marks, and preferences with their negations."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnweave.operators.chunking import blocks

INLINE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
#: Lines that are a command of their own begin with one of these; fixed values.
STANDALONE = re.compile(
    r"(?:sudo\s+)?(?:git|docker(?:\s+compose)?|kubectl|helm|npm|pnpm|yarn|node|python3?|pip3?|poetry|uv|conda|java|mvn|gradle|dotnet|go|cargo|curl|wget|ssh|scp|rsync|grep|rg|sed|awk|find|ls|cd|cp|mv|mkdir|rm|chmod|chown|tar|systemctl|journalctl"
    r"|(?:Get|Set|New|Remove|Test|Invoke|Start|Stop)-[A-Za-z][A-Za-z0-9]*|(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b)(?:\s+.+)?"
)
#: A negation right before a word, and a correction; fixed values.
RIGHT_BEFORE = re.compile(r"(?:\b(?:not|no|never|avoid|without)|n't|不是|不要(?:再)?(?:使用|用)?|别(?:再)?用|不用|不再(?:使用|用)|避免(?:使用)?|排除)(?:\s+(?:use|using))?\s*$", re.IGNORECASE)
CORRECTION = re.compile(r"\b(?:instead|rather|switch(?:ed)? to|but)\b|改用|换成|而是", re.IGNORECASE)
PROMPT = re.compile(r"^\s*[$>#]\s+(\S.*)$")
NEGATION = re.compile(r"(?:\bnot\b|\bno\b|\bnever\b|n't\b|不|别|没)", re.IGNORECASE)


def commands(text: str) -> list[tuple[str, str, int]]:
    """(kind, code, start) of fenced lines, inline code and prompt lines; each (kind, code) once."""
    out: dict[tuple[str, str], int] = {}
    for kind, a, z, _ in blocks(text):
        body = text[a:z]
        if kind == "code":
            at = a
            for line in body.split("\n")[1:]:
                at = text.index(line, at)
                code = line.strip()
                if code and not code.startswith(("```", "~~~", "#")):
                    out.setdefault(("fenced", code), at + len(line) - len(line.lstrip()))
            continue
        for m in INLINE.finditer(body):
            out.setdefault(("inline", m[1].strip()), a + m.start(1))
        at = a
        for line in body.split("\n"):
            if m := PROMPT.match(line):
                out.setdefault(("line", m[1].strip()), at + m.start(1))
            elif STANDALONE.fullmatch(line.strip()):
                out.setdefault(("standalone", line.strip()), at + len(line) - len(line.lstrip()))
            at += len(line) + 1
    return [(k, c, at) for (k, c), at in sorted(out.items(), key=lambda x: (x[1], x[0]))]


def ordered_mentions(text: str, words: dict[str, list[str]], back: int = 18) -> list[str]:
    """Values by place of mention; one with a negation in the ``back`` signs before it has a leading !."""
    low, found = text.lower(), []
    for value, names in words.items():
        for n in names:
            for m in re.finditer(rf"(?<![a-z0-9]){re.escape(n.lower())}(?![a-z0-9])", low):
                off = NEGATION.search(low[max(0, m.start() - back) : m.start()])
                found.append((m.start(), ("!" if off else "") + value))
    return [v for _, v in sorted(found)]


def settled_mentions(text: str, words: dict[str, list[str]], back: int = 18) -> list[str]:
    """Values by place of mention, each once; one right behind a negation has a leading !.

    A text that corrects itself has one winner: its last value without a negation.
    """
    low, found = text.lower(), []
    for value, names in words.items():
        for n in names:
            for m in re.finditer(rf"(?<![a-z0-9_.+-]){re.escape(n.lower())}(?![a-z0-9_+-])" if n.isascii() else re.escape(n.lower()), low):
                found.append((m.start(), value, bool(RIGHT_BEFORE.search(low[max(0, m.start() - back) : m.start()]))))
    found.sort()
    wanted = [v for _, v, off in found if not off]
    if wanted and CORRECTION.search(text):
        return [wanted[-1]]
    return list(dict.fromkeys(("!" if off else "") + v for _, v, off in found))


def command_table(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, code, char_start) of the commands of all documents."""

    def run(batches):
        for b in batches:
            rows = [(d, i, *c) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for i, c in enumerate(commands(t or ""))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "idx", "kind", "code", "char_start"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, idx long, kind string, code string, char_start long")


def mention_table(rows: DataFrame, key: str, words: dict[str, list[str]], settled: bool = False) -> DataFrame:
    """(key, mentions): an array for each row, in order of mention; ``settled`` as in settled_mentions."""
    one = settled_mentions if settled else ordered_mentions

    def run(batches):
        for b in batches:
            found = [one(t or "", words) for t in b["text"].to_pylist()]
            yield pa.record_batch([b[key], pa.array(found, pa.list_(pa.string()))], [key, "mentions"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, mentions array<string>")
