"""Line-first quality rules (operator 9), DataFrame functions only.

Every line is judged alone: punctuation (too many signs, shouting, long lines without
any mark of a sentence), navigation (separators between its words), boilerplate (openings
in four languages). Failing lines go; a document that loses too much of its text goes as a
whole. Before that,
whole-text base rules reject very short and very repetitive documents.

Cases: null text counts as empty; an empty text has no words and is rejected; a
line without a word is neutral (never fails, weighs nothing); repeated rows are
judged one by one and agree; other columns pass through ``clean_documents``
untouched, and its helper columns can't clash with them as they live in one
struct named apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, let, text_or_empty, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_pct: int = 20
    #: A line fails at this many symbols for 100 of its word characters, ...
    line_symbol_pct: int = 10
    #: ... at this many "!!" for 100 words, if it has at least ``line_min_words``, ...
    line_shout_pct: int = 50
    #: ... at this many separate ``separators`` for 100 words, ...
    line_nav_pct: int = 20
    separators: tuple[str, ...] = ("|", "»", "›", "·", "•", "→")
    line_min_words: int = 3
    #: ... with at least so many words and none of ``marks`` in it, where most of the document has them, ...
    line_plain_words: int = 8
    marks: str = ".!?…:;。！？"
    #: ... or if it starts with one of these, lower-cased. English, German, French, Spanish.
    boilerplate: tuple[str, ...] = (
        "click here", "read more", "cookie policy", "accept cookies", "accept all cookies", "we use cookies", "subscribe to our newsletter",
        "sign up for our newsletter", "share this article", "share on facebook", "skip to content", "skip to main content",
        "javascript is required", "please enable javascript", "back to top", "terms of use", "privacy policy", "lorem ipsum",
        "hier klicken", "klicken sie hier", "weiterlesen", "cookies akzeptieren", "alle cookies akzeptieren", "wir verwenden cookies",
        "newsletter abonnieren", "zum newsletter anmelden", "artikel teilen", "zum inhalt springen", "bitte aktivieren sie javascript",
        "nach oben", "datenschutzerklärung", "nutzungsbedingungen",
        "cliquez ici", "lire la suite", "accepter les cookies", "tout accepter", "nous utilisons des cookies", "inscrivez-vous à notre newsletter",
        "abonnez-vous à notre newsletter", "partager cet article", "aller au contenu", "veuillez activer javascript", "haut de page",
        "politique de confidentialité", "mentions légales",
        "haga clic aquí", "haz clic aquí", "leer más", "aceptar cookies", "aceptar todas las cookies", "utilizamos cookies",
        "suscríbete a nuestro boletín", "suscríbase a nuestro boletín", "compartir este artículo", "saltar al contenido", "ir al contenido",
        "habilite javascript", "volver arriba", "política de privacidad", "aviso legal",
    )
    #: A document that loses more than this share of its word characters goes.
    max_lost_pct: int = 30


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more.

    Hashes of the windows decide first: all different means no repeat, which is
    exact as equal windows have equal hashes. Only else the windows themselves
    are sorted and neighbours compared.
    """
    n = F.size(w)

    def exact(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 5),
            lambda i: F.struct(F.array_join(F.slice(w, i + 1, 5), " ").alias("k"), i.alias("p")),
        )

        def marked(s: Column) -> Column:
            same = lambda j, d: F.coalesce(F.get(s, j)["k"] == F.get(s, j + d)["k"], F.lit(False))
            hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, -1) | same(j, 1))
            starts = F.array_sort(F.transform(hits, lambda j: F.get(s, j)["p"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda a, p: F.struct(
                    (p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n")
                ),
                lambda a: a["n"],
            )

        return let(F.array_sort(windows), marked)

    hashes = F.transform(
        F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
    )
    return F.when(n < 6, F.lit(0)).otherwise(
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w)),
        )
    )


def _without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def _line(line: Column, r: QualityRules) -> Column:
    """struct(chars, bad, plain): word characters of the line, whether a rule fails it, and whether it is long but has no mark."""

    def judge(x: Column) -> Column:
        n = x["n"]
        bad = (
            (x["sym"] * 100 >= x["chars"] * r.line_symbol_pct)
            | ((n >= r.line_min_words) & (x["shout"] * 100 >= n * r.line_shout_pct))
            | ((n >= r.line_min_words) & (x["nav"] * 100 >= n * r.line_nav_pct))
        )
        for b in r.boilerplate:
            bad = bad | F.startswith(x["low"], F.lit(b))
        return F.struct(x["chars"].alias("chars"), ((x["chars"] > 0) & bad).alias("bad"), ((n >= r.line_plain_words) & x["plain"]).alias("plain"))

    # Words are only cut out where a line has what they are searched for.
    n_words = lambda some, which: F.when(some, F.size(F.filter(words(line), which))).otherwise(0)
    signs = "[" + "".join(r.separators) + "]"
    return let(
        F.struct(
            F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"),
            _without(line, WS_CHARS).alias("chars"),
            (F.length(line) - _without(line, SYMBOLS)).alias("sym"),
            n_words(F.contains(line, F.lit("!!")), lambda x: F.contains(x, F.lit("!!"))).alias("shout"),
            n_words(line.rlike(signs), lambda x: x.isin(*r.separators)).alias("nav"),
            (~line.rlike(f"[{r.marks}]")).alias("plain"),
            F.lower(F.substring(F.btrim(line, F.lit(WS_CHARS)), 1, 40)).alias("low"),
        ),
        judge,
    )


def measures(text: str | Column, rules: QualityRules = QualityRules()) -> Column:
    """One struct of all counts, the kept text and the verdict of a document."""
    t = text_or_empty(text)

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
        def judged(v: Column, strict: Column) -> Column:
            fails = lambda x: x["bad"] | (strict & x["plain"])
            return F.struct(
                let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).alias("dup"),
                F.aggregate(v, F.lit(0), lambda a, x: a + x["chars"]).alias("chars"),
                F.aggregate(F.filter(v, fails), F.lit(0), lambda a, x: a + x["chars"]).alias("lost"),
                F.array_join(
                    F.transform(F.filter(F.arrays_zip(lines.alias("l"), v.alias("v")), lambda z: ~fails(z["v"])), lambda z: z["l"]), "\n"
                ).alias("text"),
            )

        plain_less_rest = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + F.when(x["plain"], x["chars"]).otherwise(-x["chars"]))
        return let(F.transform(lines, lambda x: _line(x, rules)), lambda v: let(plain_less_rest(v) <= 0, lambda strict: judged(v, strict)))

    def verdict(m: Column) -> Column:
        w, ln = m["w"], m["l"]
        failed = (w["n"] < rules.min_words) | (w["rep"] * 100 > w["n"] * rules.max_repeat_pct)
        return F.struct(
            w["n"].cast("long").alias("n_words"),
            ln["chars"].cast("long").alias("word_chars"),
            m["sym"].cast("long").alias("n_symbols"),
            ln["dup"].cast("long").alias("n_dup_lines"),
            w["rep"].cast("long").alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (ln["lost"] * 100 <= ln["chars"] * rules.max_lost_pct)).alias("kept"),
            ln["lost"].cast("long").alias("lost_chars"),
            ln["text"].alias("clean_text"),
        )

    return let(
        F.struct(
            let(words(t), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep"))).alias("w"),
            let(F.split(t, "\n", -1), of_lines).alias("l"),
            (F.length(t) - _without(t, SYMBOLS)).alias("sym"),
        ),
        verdict,
    )


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id and the counts and verdict of every document; one narrow pass, no shuffle."""
    m = docs.select("doc_id", measures("text", rules).alias("__q"))
    return m.select(
        "doc_id",
        *[
            F.col("__q")[c].alias(c)
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
        ],
    )


def clean_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, without their failing lines; the columns stay."""
    # A filter on the struct would be pushed below it and judge every text twice; one on an exploded array can't be.
    passed = F.filter(F.array(measures("text", rules)), lambda q: q["kept"])
    m = docs.select("*", F.explode_outer(passed).alias("__q")).filter(F.col("__q").isNotNull())
    new = {"text": F.col("__q")["clean_text"]}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col("__q")["clean_text"]).cast(docs.schema["n_chars"].dataType)
    return m.withColumns(new).select(*docs.columns)


def _sql(rules: QualityRules = QualityRules()) -> str:
    ws = r"[\x20\x09-\x0D]+"
    nosym = "translate({0}, '" + SYMBOLS + "', '')"
    boiler = " or ".join(f"starts_with(lower(substr(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 1, 40)), '{b}')" for b in rules.boilerplate)
    return rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '{ws}'), lambda x: x <> '') w from d),
win as (select doc_id, p, array_to_string(w[p:p+4], ' ') k
        from (select doc_id, w, unnest(range(1, len(w) - 3)) p from w where len(w) >= 5)),
rep as (select doc_id, p from (select *, count(*) over (partition by doc_id, k) c from win) where c > 1),
nrep as (select doc_id, count(distinct p + o) n from rep, (select unnest(range(0, 5)) o) group by 1),
lines as (select doc_id, l, list_filter(string_split_regex(l, '{ws}'), lambda x: x <> '') lw
          from (select doc_id, unnest(string_split(t, chr(10))) l from d)),
jl as (select doc_id, l, len(regexp_replace(l, '{ws}', '', 'g')) chars, len(lw) n,
          len(l) - len({nosym.format('l')}) sym,
          len(list_filter(lw, lambda x: contains(x, '!!'))) shout, len(list_filter(lw, lambda x: x in ({", ".join(f"'{x}'" for x in rules.separators)}))) nav,
          len(lw) >= {rules.line_plain_words} and not regexp_matches(l, '[{rules.marks}]') plain from lines),
pl as (select *, sum(case when plain then chars else -chars end) over (partition by doc_id) <= 0 strict from jl),
bl as (select *, chars > 0 and (sym * 100 >= chars * {rules.line_symbol_pct}
          or (n >= {rules.line_min_words} and shout * 100 >= n * {rules.line_shout_pct})
          or (n >= {rules.line_min_words} and nav * 100 >= n * {rules.line_nav_pct})
          or (plain and strict) or {boiler}) bad from pl),
ln as (select doc_id, sum(chars)::bigint chars, coalesce(sum(chars) filter (where bad), 0)::bigint lost,
          (count(*) filter (where n > 0) - count(distinct l) filter (where n > 0))::bigint dup from bl group by 1),
f as (select w.doc_id, len(w)::bigint n_words, chars word_chars,
          (len(t) - len({nosym.format('t')}))::bigint n_symbols, dup n_dup_lines, coalesce(nrep.n, 0)::bigint n_repeat_words, lost
      from w join ln using (doc_id) left join nrep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_pct} * n_words) base_failed,
  not (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_pct} * n_words)
    and lost * 100 <= word_chars * {rules.max_lost_pct} kept, lost lost_chars
from f
"""


def op9_quality_rules(spark, sf_dir):
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": _sql()}
