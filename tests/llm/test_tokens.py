"""Operators 11 to 13 against the libraries and plain versions."""

import hashlib
import os
import random
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import fill_in_middle, token_align, token_counts
from tarnweave.llm.vocab import byte_of_char, json_tokenizer, piece_tokenizer, split_alike, tokenizer_path, vocabulary

SF = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, n long, form string, digest string, part string, text_ string, links string, groups string, block string"
EDGE = [
    None, "", " ", "\n\n", "one", "one", " one", "two  blanks and\ttabs \n\n end ", "it's they'll I'D we've", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>",
    "<s>in</s> <unk> <0x41> <P>", "x<S>y", "<M>", "é" * 500, "漢字かな交じり文。", "😀👩‍👩‍👧 flag 🇩🇪", "͸ unassigned ͸", "under▁score", " nbsp em\u0085", "\x00\x01\x1c\x1f",
    "x" * 30_000, "a b " * 4000, " " * 40_000 + "x", "12345678901234567890 3.14e-10", "ﬁ ligature ½ Ⅷ", "न्‍मस्ते दुनिया", "same same same",
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, 1, "f", "d", "p", "t", "l", "g", "b") for i, t in enumerate(EDGE)]
    rows += [rows[4], (None, "a null id", 1, "f", "d", "p", "t", "l", "g", "b"), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def everything(docs, edge):
    return docs.unionByName(edge.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))


def rows_of(df, n=2):
    return Counter(tuple(r)[:n] for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())


# --- vocabulary files


def test_libraries_cut_alike_where_said():
    """Every code point with a category, in several places, is cut alike by the pattern and both libraries."""
    from public_tokenizers import PATTERN
    import regex

    cut, fast, own = regex.compile(PATTERN), vocabulary(tokenizer_path(A)), json_tokenizer(tokenizer_path(A))
    good = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and split_alike(chr(c))]
    assert len(good) > 280_000 and not split_alike("a͸")
    random.Random(1).shuffle(good)
    for k in range(0, len(good), 2048):
        text = "".join(f"a{c}b 1{c}2 !{c}? {c}\n" for c in good[k : k + 2048])
        assert [s for _, s in own.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in cut.finditer(text)]
        if k < 60_000:
            assert fast._fast.encode_ordinary(text) == own.encode(text, add_special_tokens=False).ids


# --- 11


def test_token_counts(spark, docs, edge, empty):
    every, own = everything(docs, edge), json_tokenizer(tokenizer_path(A))
    want = Counter()
    for (i, t), n in rows_of(every).items():
        tokens = len(own.encode(t, add_special_tokens=False).ids)
        want[i, len(t.encode()), tokens, tokens > 1024] += n
    for most in (token_counts.FREQUENT, 0, 3):
        out = token_counts.count_tokens(every, most=most)
        assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(map(tuple, out.collect())) == want
    assert token_counts.count_tokens(empty).count() == 0
    assert [token_counts.count_tokens(edge.filter("doc_id = 9")).first()["n_tokens"]] == [1]


def test_token_counts_of_other_kinds(spark, edge):
    """Tokenizers that are no plain byte-level BPE see whole texts."""
    few = edge.filter("doc_id is not null and doc_id < 20")
    pieces, words = piece_tokenizer(tokenizer_path(B)), json_tokenizer(tokenizer_path("word_bpe_49k.json"))
    texts = {i: t for i, t in rows_of(few)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(few, B).collect()} == {i: len(pieces.encode(t)) for i, t in texts.items()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(few, "word_bpe_49k.json").collect()}
    assert got == {i: len(words.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_table_and_cache_of_token_counts(spark, docs, monkeypatch):
    entries = {" the": 1, "é": 1, "漢字": 4, "\n": 1}
    assert token_counts.unpack(token_counts.pack(entries)) == entries and token_counts.unpack(token_counts.pack({})) == {}
    top = token_counts.frequent_pretokens(docs, 20)
    counts = Counter()
    look = token_counts.Lookup(tokenizer_path(A), {})
    for (_, t), n in rows_of(docs).items():
        counts.update({w: n * c for w, c in Counter(look.find(t)).items()})
    assert set(top[:5]) == {w for w, _ in counts.most_common(5)}
    text = "some words, and more; " * 50 + "x" * 100
    assert "".join(token_counts.pieces(text, 30)) == text and max(map(len, token_counts.pieces(text, 30))) < 140
    monkeypatch.setattr(token_counts, "CACHE", 10)
    monkeypatch.setattr(token_counts, "SLICE", 40)
    small, own = token_counts.Lookup(tokenizer_path(A), {" the": 1}), json_tokenizer(tokenizer_path(A))
    texts = [t for (_, t) in list(rows_of(docs))[:20]]
    assert small.counts(texts).tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


# --- 12


def plain_alignment(rows):
    """Two pointers over both token lists, then counts of the whole corpus."""
    own, pieces = json_tokenizer(tokenizer_path(A)), piece_tokenizer(tokenizer_path(B))
    chars = byte_of_char()
    of_a = {i: bytes(chars[c] for c in t) for t, i in own.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}
    of_b = lambda i: bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    aligned, counts = [], Counter()
    for i, text in rows:
        a = vocabulary(tokenizer_path(A))._hf.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        ta, tb = [of_a[x] for x in a], [of_b(x) for x in b]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            a, b, ta, tb = [], [], [], []
        spans = lambda ts: [(sum(map(len, ts[:k])), sum(map(len, ts[: k + 1]))) for k in range(len(ts))] if len(ts) < 300 else running(ts)
        sa, sb = spans(ta), spans(tb)
        shared = sorted({z for _, z in sa} & {z for _, z in sb})
        links, k = [], 0
        for x, (s, z) in enumerate(sa):
            while k < len(sb) and sb[k][1] <= s:
                k += 1
            links += [(a[x], b[y]) for y in range(k, min(len(sb), k + 400)) if sb[y][0] < z and sb[y][1] > s]
        groups, pa_, pb_ = [], 0, 0
        for z in shared:
            ea, eb = next(q for q in range(pa_, len(sa)) if sa[q][1] == z), next(q for q in range(pb_, len(sb)) if sb[q][1] == z)
            groups.append((a[pa_ : ea + 1], b[pb_ : eb + 1]))
            pa_, pb_ = ea + 1, eb + 1
        aligned.append((i, a, b, groups, links))
        counts.update(links)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = Counter()
    for i, a, b, groups, links in aligned:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if links else ""
        out[i, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest] += 1
    return out


def running(tokens):
    spans, at = [], 0
    for t in tokens:
        spans.append((at, at + len(t)))
        at += len(t)
    return spans


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def scored(df):
    aligned = token_align.align_tokens(df)
    return token_align.score_links(aligned.withColumn("groups_sha256", F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups"))


def test_alignment(spark, docs, edge, empty, monkeypatch):
    every = everything(docs, edge).repartition(3)
    want = plain_alignment([k for k, n in rows_of(every).items() for _ in range(n)])
    assert any(r[1] == 0 and r[0] is not None for r in want) and sum(r[3] > 0 for r in want) > 200
    out = scored(every)
    assert Counter(map(tuple, out.select(*COLS).collect())) == want
    assert scored(empty).count() == 0
    few = edge.filter("doc_id in (0, 1)")
    assert [tuple(r)[1:] for r in scored(few).select(*COLS).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_small_blocks_give_the_same(spark, edge):
    """Blocks of a few links, as a task would cut a large input."""
    import numpy as np
    import pyarrow as pa

    before = token_align.BLOCK
    lengths = np.array([0, 3, 0, 2, 4])
    links = np.array([5, 5, 7, 9, 5, 7, 7, 7, 1])
    pairs, total, kept, steps, times = token_align._block(links, lengths)
    assert pairs.tolist() == [1, 5, 7, 9] and total.tolist() == [1, 3, 4, 1] and kept.tolist() == [0, 2, 0, 2, 2]
    n = int(kept.sum())
    assert token_align._unpacked(times, n).tolist() == [2, 1, 1, 1, 1, 3] and token_align._unpacked(steps, n).tolist() == [1, 1, 1, 2, 0, 2]
    assert token_align._unpacked(token_align._packed(np.array([70_000, 1])), 2).tolist() == [70_000, 1]
    assert pa.array([before]).type == pa.int64()


def test_elementary_intervals():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.append(np.flatnonzero(rng.random(40) < 0.4) + 1, 41) for _ in "ab")
        of_a, of_b, closes = token_align.elementary(a, b)
        spans = lambda ends: list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        want = [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if s < f and t < e]
        assert list(zip(of_a.tolist(), of_b.tolist(), strict=True)) == want
        assert closes.sum() == len(set(a.tolist()) & set(b.tolist()))


# --- 13


def plain_fim(i, text):
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return i, n, "spm", x, y - x, f"<S>{text[y:]}<P>{text[:x]}<M>{text[x:y]}"
    return i, n, "psm", x, y - x, f"<P>{text[:x]}<S>{text[y:]}<M>{text[x:y]}"


def test_fill_in_middle(spark, docs, edge, empty):
    many = edge.filter("doc_id = 27").select("doc_id", "text").crossJoin(spark.range(3000)).select((F.col("id") + 2 * 10**6).alias("doc_id"), "text")
    brackets = spark.createDataFrame([(3 * 10**6 + i, "<" * (i % 5) + "P><S" * (i % 7) + ">" * (i % 3)) for i in range(300)], "doc_id long, text string")
    every = everything(docs, edge).unionByName(many).unionByName(brackets)
    out = fill_in_middle.fill_in_middle(every).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    want = Counter()
    for (i, t), n in rows_of(every).items():
        want[plain_fim(i, t)] += n
    assert Counter(tuple(r)[:6] for r in out) == want
    text = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows_of(every)}
    assert all((r["doc_id"], hashlib.sha256(r["back"].encode()).hexdigest()) in text for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(empty).count() == 0


def test_frequent_texts_are_dealt_out(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "copied text").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
    parts = fill_in_middle._dealt(df)
    assert parts.filter("text = 'copied text'").select("part").distinct().count() > 100
    assert parts.filter("text <> 'copied text'").agg(F.max("part")).first()[0] == 0
    assert fill_in_middle.text_index(parts).filter("text like 'own%'").count() == 2000


def test_offset_lists(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "é", "abc" * 3000, "é" * 3000, "😀" * 2000, "aé😀漢" * 1500, "a" * 5000 + "😀" * 5000, "".join(rng.choice("aaaaé漢😀") for _ in range(20_000))]
    for block in (fill_in_middle.BLOCK, 100):
        monkeypatch.setattr(fill_in_middle, "BLOCK", block)
        for t in texts:
            packed, at, want = fill_in_middle.boundaries(t.encode()), 0, [0]
            for c in t:
                at += len(c.encode())
                want.append(at)
            assert [fill_in_middle.select(packed, i) for i in range(len(want))] == want
            assert len(packed) * 8 <= 5 * len(t) + 600
