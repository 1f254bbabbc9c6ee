"""Personal data by weak supervision (operator 1), DataFrame functions only.

Base spans come from four fixed patterns with checks. Looser patterns propose more
candidates (numbers that fail a check, phones and ids of other forms, names after titles
or cues, assigned values and long keys, bank accounts), and five labelers vote yes, no or
abstain on each: strict form (regex and check digits), gazetteer, context cue, counter cue,
shape. They contradict each other, so votes alone give labels:
expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is for each kind and how probable each pattern is a true one. With
these probabilities as soft labels a naive Bayes span classifier is trained on
features that no labeler sees, and its yes adds a span, unless a check of the form failed.
Base spans always stay.

One pass over the texts writes candidates; all statistics are grouped counts of
them. What reaches the driver is counts by (kind, votes, feature value): at most
8 * 3^5 * 23 rows whatever the corpus. A text's cost is in proportion to its length and matches.

Cases: null and empty texts have no spans; places are code points, end exclusive;
matches that fail a check are dropped without another try; a candidate that
overlaps a base span is dropped; repeated rows agree; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, text_or_empty

KINDS = ("email", "ip", "card", "phone", "name", "id", "secret", "iban")
# The base patterns, written so that each run of characters is entered once: at its
# start or where the last match ended. They match what the plain ones match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates beyond them.
LOOSE_PHONE = r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"
LOOSE_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KEYED_ID = r"(?=[A-Z0-9])(?<=[:#\x20])(?<=(?:SSN|ssn|[Pp]assport|DNI|NIF|Ausweis|Steuer-ID|[Ii]nsurance)(?:\x20(?:no\.?|number|is))?[:#\x20]{1,3})[A-Z0-9][A-Z0-9-]{5,13}(?![A-Za-z0-9-])"
NAME = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?"
KEYED_NAME = r"(?=\p{Lu})(?<=\x20)(?<=(?:[Nn]ame(?:\x20is)?|[Ss]igned|[Dd]ear|[Aa]uthor|[Aa]ttn|[Cc]ontact|Nombre|Nom|Unterschrift)[:,]?\x20)\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20}){1,2}"
# A value that is assigned to a word, or any long run of letters and digits mixed.
SECRET = r"""(?<![A-Za-z0-9+/_.~-])(?:(?<=[A-Za-z_]["']?\x20?[=:]\x20?["']?)[A-Za-z0-9+/_.~-]{8,}|(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,})"""
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

#: Gazetteers and cues by kind, as patterns over the lower-cased span (of secrets: what stands before) or its context; fixed values.
GAZETTEER = {
    "email": r"\.(?:com|net|org|edu|gov|de|fr|es|uk|io)$",
    "ip": r"^(?!0\.|10\.|127\.|192\.168\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+?(?:1|33|34|44|49)?[\x20-]?\(?[2-9]",
    "name": r"\b(?:john|mary|james|anna|peter|maria|jose|juan|hans|pierre|marie|paul|smith|miller|garcia|martin|schmidt|dupont)\b",
    "id": r"^(?!000|666|9)",
    "secret": r"(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|credential|bearer|passwort|kennwort|contraseña|clave|mot de passe)s?[\"']?\s?(?:is\s?)?[=:]?\s?[\"']?$",
    "iban": r"^(?:at|be|ch|de|es|fr|gb|ie|it|lu|nl|pl|pt|se)",
}
CUE = {
    "email": r"(?:e-?mail|contact|write|mailto|reach)", "ip": r"(?:\bip\b|host|server|address|login)",
    "card": r"(?:card|visa|master|payment|credit|karte|tarjeta|carte)", "phone": r"(?:phone|tel|call|mobile|fax|dial)",
    "name": r"(?:name|dear|signed|patient|by)\b", "id": r"(?:ssn|social|id\b|number|passport)",
    "secret": r"(?:login|private|\bkey\b|\bauth|account|user|[=:]\s?[\"']?\n)", "iban": r"(?:iban|konto|account|bank|cuenta|compte)",
}
COUNTER = r"(?:version|isbn|order|page|invoice|issue|example|sample|build|figure|table|commit|checksum|sha-?1|md5|https?:|hash)"
#: What a span of the kind looks like, and what none does.
SHAPE = {
    "email": (r"^[a-z0-9._]{3,30}@[a-z0-9-]+\.[a-z.]{2,12}$", r"\d{6,}@"), "ip": (r"^\d{2,3}\.", r"^[0-3]\.\d\.\d\.\d$"),
    "card": (r"^\d{4}([\x20-]?)\d{4}\1\d{4}\1\d{4}$", r"^(\d)\1*$"), "phone": (r"\d{3}[.\x20-]\d{4}$", r"^\+?(\d)\1*$"),
    "name": (r"\x20\p{L}+\x20\p{L}+$", r"^\p{L}+\.?\x20\p{L}{1,2}$"), "id": (r"^\d{3}-\d{2}-\d{4}$", r"-0000$"),
    "secret": (r"^(?=.*[0-9].*[0-9])(?=.*[a-z].*[a-z]).{16,}$", r"^[\p{L}._-]+$|^[0-9.-]+$"), "iban": (r"^[a-z]{2}\d{2}\x20?\d{4}", r"^[a-z]{2}00"),
}
#: Known forms of keys: hex digests of usual length, and prefixes of common services.
KEY_FORM = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[bap]-[A-Za-z0-9-]{10,})$"
BEFORE, AFTER = 30, 12
#: Running sums and the like copy what they have so far, so they go by blocks of so many values.
BLOCK = 64


def _running(values: Column, start: int, op) -> Column:
    """array<int> of op(start, v1), op(op(start, v1), v2), ...; op is associative. Blocks keep long arrays from costing a square."""
    none = F.array().cast("array<int>")

    def short(a: Column, first: Column) -> Column:
        add = lambda s, v: let(op(s["at"], v), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out")))
        return F.aggregate(a, F.struct(first.alias("at"), none.alias("out")), add, lambda s: s["out"])

    def long(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / BLOCK).cast("int") - 1), lambda i: F.slice(a, i * BLOCK + 1, BLOCK))
        whole = lambda b: F.aggregate(b, F.lit(start), op)

        def spread(bs: Column) -> Column:
            ends = short(F.transform(bs, whole), F.lit(start))
            return let(ends, lambda e: F.flatten(F.transform(bs, lambda b, i: short(b, F.when(i == 0, F.lit(start)).otherwise(F.get(e, i - 1))))))

        return let(blocks, spread)

    return F.when(F.size(values) <= BLOCK, short(values, F.lit(start))).otherwise(long(values))


def _places(text: Column, pattern: str) -> Column:
    """array of (m, s, e, before, after) of the leftmost non-overlapping matches; what stands around is up to the neighbours."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<m:string,s:int,e:int,before:string,after:string>>")

    def placed(f: Column, g: Column) -> Column:
        ends = _running(F.transform(f, lambda m, i: F.length(F.get(g, i)) + F.length(m)), 0, lambda a, n: a + n)
        return let(
            ends,
            lambda at: F.transform(
                f,
                lambda m, i: F.struct(
                    m.alias("m"), (F.get(at, i) - F.length(m)).alias("s"), F.get(at, i).alias("e"),
                    F.right(F.get(g, i), F.lit(BEFORE)).alias("before"), F.left(F.get(g, i + 1), F.lit(AFTER)).alias("after"),
                ),
            ),
        )

    return let(found, lambda f: F.when(F.size(f) == 0, empty).otherwise(let(gaps, lambda g: placed(f, g))))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether the check digits fit: first four signs last, letters as 10 to 35, remainder 1."""
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.left(s, F.lit(4)))
    add = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, m: Column) -> Column:
    """The check of a base kind; of the others, what is known of the form, null where nothing is."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return let(F.regexp_replace(m, r"[\x20-]", ""), _luhn)
    if kind == "phone":
        return F.regexp_count(m, F.lit("[0-9]")).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "secret":
        return F.when(m.rlike(KEY_FORM), F.lit(True))
    return F.lit(None).cast("boolean")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _candidate(kind: str, x: Column, base: bool) -> Column:
    """One candidate with its votes and features; a match of a base pattern (``base``) is a base span if its check passes."""
    m, low, before, after = x["m"], F.lower(x["m"]), F.lower(x["before"]), F.lower(x["after"])
    ctx = F.concat(before, F.lit("\n"), after)
    known = (before if kind == "secret" else low).rlike(GAZETTEER[kind])

    def of(ok: Column) -> Column:
        votes = F.concat(
            _vote(ok, ~ok),
            _vote(known, F.lit(kind not in ("name", "secret"))),
            _vote(ctx.rlike(CUE[kind]), F.lit(False)),
            _vote(F.lit(False), ctx.rlike(COUNTER)),
            _vote(low.rlike(SHAPE[kind][0]), low.rlike(SHAPE[kind][1])),
        )
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
            (F.coalesce(ok, F.lit(False)) if base else F.lit(False)).alias("base"), votes.alias("votes"), feats.alias("feats"),
        )

    edge = lambda c: F.when(c == "", "e").when(c.rlike(r"\s"), "s").when(c.rlike(r"[\p{L}0-9]"), "w").otherwise("p")
    digits = F.regexp_count(m, F.lit("[0-9]"))
    feats = F.array(
        F.concat(F.lit("b"), edge(F.right(before, F.lit(1)))),
        F.concat(F.lit("a"), edge(F.left(after, F.lit(1)))),
        F.concat(F.lit("n"), F.least(F.length(m) / 5, F.lit(8)).cast("int").cast("string")),
        F.concat(F.lit("d"), F.least(digits * 6 / F.length(m), F.lit(5)).cast("int").cast("string")),
    )
    return let(_valid(kind, m), of)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, and ``c``: all base spans and candidates of each text, with votes and features."""
    t = text_or_empty("text")

    def of(text: Column) -> Column:
        def group(kind: str, pattern: str, base: bool, gate: Column) -> Column:
            made = F.transform(_places(text, pattern), lambda x: _candidate(kind, x, base))
            return F.when(gate, made).otherwise(F.array().cast("array<struct<kind:int,s:int,e:int,base:boolean,votes:string,feats:array<string>>>"))

        digit = text.rlike("[0-9][^A-Za-z]*[0-9][^A-Za-z]*[0-9][^A-Za-z]*[0-9]")
        return F.concat(
            group("email", EMAIL, True, F.contains(text, F.lit("@"))),
            group("ip", IP, True, digit),
            group("card", CARD, True, digit),
            group("phone", PHONE, True, F.contains(text, F.lit("+"))),
            group("phone", LOOSE_PHONE, False, digit),
            group("id", LOOSE_ID, False, digit),
            group("id", KEYED_ID, False, text.rlike(r"SSN|ssn|assport|DNI|NIF|Ausweis|Steuer-ID|nsurance")),
            group("name", NAME, False, text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\b")),
            group("name", KEYED_NAME, False, text.rlike(r"ame|igned|ear\x20|uthor|ttn|ontact|Nombre|Nom|Unterschrift")),
            group("secret", SECRET, False, text.rlike(r"[A-Za-z_][\"']?\x20?[=:]|[A-Za-z0-9+/_-]{20}")),
            group("iban", IBAN, False, text.rlike(r"[A-Z]{2}[0-9]{2}")),
        )

    def clear(c: Column) -> Column:
        """Candidates that overlap no base span: of those that start earlier none ends later, of those that follow none starts before its end."""
        far = 1 << 30
        ends = _running(F.transform(c, lambda x: F.when(x["base"], x["e"]).otherwise(0)), 0, lambda a, v: F.greatest(a, v))
        starts = F.reverse(_running(F.reverse(F.transform(c, lambda x: F.when(x["base"], x["s"]).otherwise(far))), far, lambda a, v: F.least(a, v)))
        free = lambda z: z["c"]["base"] | ((z["e"] <= z["c"]["s"]) & (z["n"] >= z["c"]["e"]))
        kept = F.filter(F.arrays_zip(c.alias("c"), ends.alias("e"), starts.alias("n")), free)
        return F.when(F.forall(c, lambda x: x["base"]) | ~F.exists(c, lambda x: x["base"]), c).otherwise(F.transform(kept, lambda z: z["c"]))

    def apart(c: Column) -> Column:
        """Two patterns look for ids and for names: of their candidates of one kind that overlap, the leftmost and longest stays."""
        twice = lambda x: ~x["base"] & x["kind"].isin(KINDS.index("id"), KINDS.index("name"))
        kept = lambda found: F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x.alias("x")))), lambda y: y["x"])

        def add(a: Column, x: Column) -> Column:
            is_id = x["kind"] == KINDS.index("id")
            free = x["s"] >= F.when(is_id, a["id"]).otherwise(a["name"])
            return F.struct(
                F.when(free & is_id, x["e"]).otherwise(a["id"]).alias("id"), F.when(free & ~is_id, x["e"]).otherwise(a["name"]).alias("name"),
                F.when(free, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"),
            )

        def of(found: Column) -> Column:
            start = F.struct(F.lit(0).alias("id"), F.lit(0).alias("name"), F.slice(found, 1, 0).alias("out"))
            return F.when(F.size(found) < 2, c).otherwise(F.concat(F.filter(c, lambda x: ~twice(x)), F.aggregate(kept(found), start, add, lambda a: a["out"])))

        return let(F.filter(c, twice), of)

    by_start = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["s"].alias("s"), x.alias("x")))), lambda y: y["x"])
    return docs.select("doc_id", let(let(let(let(t, of), by_start), clear), apart).alias("c"))


def em_posteriors(counts: dict[tuple[int, str], int], rounds: int = 30) -> dict[tuple[int, str], float]:
    """P(true | kind, votes) by expectation-maximisation on counts of vote patterns.

    Each labeler has, for each kind, a distribution over yes, no and abstain for true and
    for false candidates; they start from votes being right more often than not. A no of the first
    labeler is a failed check (check digits, ranges), so such candidates are known to be false.
    """
    out: dict[tuple[int, str], float] = {}
    for kind in sorted({k for k, _ in counts}):
        pats = {v: n for (k, v), n in sorted(counts.items()) if k == kind}
        total = sum(pats.values())
        post = {v: min(0.95, max(0.05, 0.5 + 0.15 * (v.count("+") - v.count("-")))) for v in pats}
        for _ in range(rounds):
            prior = (1 + sum(n * post[v] for v, n in pats.items())) / (2 + total)
            like = []
            for j in range(5):
                by = {c: [1.0 + 2 * (c == "+"), 1.0 + 2 * (c == "-")] for c in "+-0"}
                for v, n in pats.items():
                    by[v[j]][0] += n * post[v]
                    by[v[j]][1] += n * (1 - post[v])
                sums = [sum(x[i] for x in by.values()) for i in (0, 1)]
                like.append({c: math.log(x[0] / sums[0]) - math.log(x[1] / sums[1]) for c, x in by.items()})
            for v in pats:
                z = math.log(prior / (1 - prior)) + sum(like[j][v[j]] for j in range(5))
                post[v] = 0.001 if v[0] == "-" else 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def train(spans: DataFrame) -> dict[str, float]:
    """Weights of the naive Bayes span classifier: "kind" alone is the prior's log odds, "kind:feature" a feature's."""
    each = spans.select(F.explode("c").alias("x")).select("x.kind", "x.votes", F.explode("x.feats").alias("f"))
    rows = each.groupBy("kind", "votes", "f").count().collect()  # bounded: see the module's text
    patterns: dict[tuple[int, str], int] = {}
    for r in rows:
        if r["f"][0] == "b":  # every candidate has exactly one such feature
            patterns[r["kind"], r["votes"]] = patterns.get((r["kind"], r["votes"]), 0) + r["count"]
    post = em_posteriors(patterns)
    yes: dict[str, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["votes"], r["f"])):
        p = post[r["kind"], r["votes"]]
        for key, n in ((f"{r['kind']}:{r['f']}", r["count"]), (f"{r['kind']}", r["count"] if r["f"][0] == "b" else 0)):
            x = yes.setdefault(key, [0.0, 0.0])
            x[0] += n * p
            x[1] += n * (1 - p)
    out = {}
    for key, (a, b) in yes.items():
        if ":" in key:
            ka, kb = yes[key.split(":")[0]]
            out[key] = round(math.log((a + 1) / (ka + 8)) - math.log((b + 1) / (kb + 8)), 9)
        else:
            out[key] = round(math.log((a + 1) / (b + 1)), 9)
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every document."""
    spans = cut(candidates(docs), "pii-candidates")
    weights = train(spans)
    table = F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv]) if weights else F.lit(None).cast("map<string,double>")
    names = F.array(*[F.lit(k) for k in KINDS])
    w = lambda k: F.coalesce(F.try_element_at(table, k), F.lit(0.0))
    score = lambda x: F.aggregate(
        x["feats"], w(x["kind"].cast("string")), lambda a, f: a + w(F.concat(x["kind"].cast("string"), F.lit(":"), f))
    )
    said = lambda c: F.array_join(
        F.transform(
            F.array_sort(F.transform(c, lambda x: F.struct(x["s"], x["kind"], x["e"]))),
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )
    base = F.filter("c", lambda x: x["base"])
    n = lambda k: F.size(F.filter("c", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select(
        "doc_id", *[n(k) for k in range(4)], F.sha2(said(base), 256).alias("base_sha256"),
        said(F.filter("c", lambda x: x["base"] | (~F.startswith(x["votes"], F.lit("-")) & (score(x) > 0)))).alias("spans"),
    )


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each span of ``found`` (by doc_id) written over as ``<kind>``."""
    parts = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.split(x, ":"))

    def over(spans: Column) -> Column:
        return F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda a, p: F.when(p[1].cast("int") < a["at"], a).otherwise(
                F.struct(p[2].cast("int").alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, p[1].cast("int") - a["at"]), F.lit("<"), p[0], F.lit(">")).alias("out"))
            ),
            lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1, F.length("text"))),
        )

    joined = docs.join(found.select("doc_id", "spans"), "doc_id", "left")
    return joined.withColumn("text", F.when(F.coalesce("spans", F.lit("")) == "", F.col("text")).otherwise(let(parts, over))).select(*docs.columns)


def op1_pii(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_pii": op1_pii}
ORACLES = {}
