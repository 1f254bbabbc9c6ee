"""Operators against brute-force versions and edge cases on small tables."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tarnweave.llm import chat_format, decontaminate, license_scan, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, cls string, size string, component_id string, target string"
BASE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank at dusk and nobody says a word about it"
EDGE = [
    None, "", " \n\t ", "one", BASE, BASE, BASE.upper(), BASE + " today", BASE.replace("dusk", "dawn"), "x" * 30_000, "a b " * 4000,
    "\n".join(f"line {i} of a longer text with words" for i in range(300)), "Common line here.\nUnique " + BASE[::-1], "é" * 200 + " " + "é" * 200, "\n\n\n",
    "mail me at a@b.co or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1",
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None, f"s{i % 3}" if i % 4 else None, None, "k", "c", "z", "q", "t") for i, t in enumerate(EDGE)]
    rows += [rows[4], (None, BASE, None, "s1", 3, "k", "c", "z", "q", "t"), (None, None, None, None, None, "k", "c", "z", "q", "t")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1


def plain_pii(text):
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(s):
        return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0

    def fine(k, m):
        d = re.sub("[^0-9]", "", m)
        return (True, k == 1 and all(int(p) <= 255 for p in m.split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]

    out = sorted((m.start(), k, m.end()) for k, p in enumerate(pats) for m in re.finditer(p, text or "") if fine(k, m.group()))
    return [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in out]


TRICKY = [
    "a@b.c+d@e.f x+y@z..q aa@bb.cc. 1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.2.3",
    "4111 1111-1111 1111  +1 (988) 555-2485 (988) 555-2485 +49 170 12 123-45-6789 Mr. John Smith 41111111111111111111 4111 1111 1111 1112 é@x.com 5",
    "9" * 3000 + " " + "a" * 3000 + "@" + "+1" + "(" * 500 + " x@y.z", "+1+2+3 000000000000 0000-0000-0000-0000 1-2-3-4-5-6-7-8-9-0-1-2",
]


def test_pii(spark, docs, edge, empty):
    tricky = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").unionByName(tricky).unionByName(edge.select((F.col("doc_id") + 2 * 10**6).alias("doc_id"), "text"))
    texts = defaultdict(list)
    for r in all_.collect():
        texts[r["doc_id"]].append(r["text"])
    rows = pii.find_pii(all_).collect()
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        wants = [plain_pii(t) for t in texts[r["doc_id"]]]
        want = next((w for w in wants if hashlib.sha256(",".join(w).encode()).hexdigest() == r["base_sha256"]), None)
        assert want is not None
        n = Counter(x.split(":")[0] for x in want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(n[k] for k in pii.KINDS[:4])
        assert set(want) <= set(filter(None, r["spans"].split(",")))
    assert pii.find_pii(empty).count() == 0
    one = spark.createDataFrame([(1, "write to a@b.co now")], "doc_id long, text string")
    assert pii.redact(one, pii.find_pii(one)).first()["text"] == "write to <email> now"


def test_pii_adds_spans_by_votes(spark):
    """Keys, names and numbers in contexts that speak for or against them."""
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    rows = [f'some words token = "{h}" and more words' for h in hexes[:40]] + [f"title: something of length {i} here" for i in range(40)]
    rows += [f"version: 1.{i}.400.2 of the build" if i % 2 else f"card 4111111111111112 here, text {i}" for i in range(20)] + [f"IBAN DE89370400440532013000 konto, number {i}" for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert all(got[i] == f"secret:{rows[i].index(hexes[i])}:{rows[i].index(hexes[i]) + 40}" for i in range(40))
    assert not any(got[i] for i in range(40, 100))
    assert all("iban:5:27" in got[i] for i in range(100, 110))


def test_pii_of_a_text_with_many_matches(spark):
    """Places come from running sums in blocks; a text of thousands of matches is exact and not slow."""
    many = "a@b.co 1.2.3.4 token=abcdef0123456789 " * 3000
    rows = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame([(1, many), (2, many[:38])], "doc_id long, text string")).collect()}
    assert rows[1]["n_email"] == rows[1]["n_ip"] == 3000
    assert rows[1]["base_sha256"] == hashlib.sha256(",".join(plain_pii(many)).encode()).hexdigest()


def plain_added(text):
    """Candidates of ids and names by both patterns of each, leftmost and longest first, clear of base spans."""
    text, base = text or "", [tuple(map(int, x.split(":")[1:])) for x in plain_pii(text)]
    head = r"(?:SSN|ssn|[Pp]assport|DNI|NIF|Ausweis|Steuer-ID|[Ii]nsurance)(?:\x20(?:no\.?|number|is))?[:#\x20]{1,3}"
    call = r"(?:[Nn]ame(?:\x20is)?|[Ss]igned|[Dd]ear|[Aa]uthor|[Aa]ttn|[Cc]ontact|Nombre|Nom|Unterschrift)[:,]?\x20"
    out = []
    for kind, pats in {"id": [pii.LOOSE_ID, f"(?<={head})[A-Z0-9][A-Z0-9-]{{5,13}}(?![A-Za-z0-9-])"], "name": [pii.NAME, rf"(?<={call})\p{{Lu}}\p{{Ll}}{{1,20}}(?:\x20\p{{Lu}}\p{{Ll}}{{1,20}}){{1,2}}"]}.items():
        found = sorted((m.start(), -m.end()) for p in pats for m in regex.finditer(p, text))
        end = 0
        for s, e in found:
            if all(-e <= a or z <= s for a, z in base) and s >= end:
                out.append((kind, s, -e))
                end = -e
    return out


def test_added_candidates_do_not_overlap(spark, docs):
    """Both patterns of a kind hit here; the same places as by the patterns without look-aheads in front."""
    made = ["My SSN 123-45-6789 and passport no AB123456. Signed Dr. John Smith Miller, dear Mrs. Anna Maria Lopez. SSN: 123-45-6789-0", "SSN 111-22-3333 " * 500, "Name is John Paul Smith name is Mr John Paul"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    n = 0
    for r in pii.candidates(rows).collect():
        got = sorted((pii.KINDS[x["kind"]], x["s"], x["e"]) for x in r["c"] if not x["base"] and pii.KINDS[x["kind"]] in ("id", "name"))
        assert got == sorted(plain_added(texts[r["doc_id"]])), r["doc_id"]
        n += len(got)
    assert n > 505
    spans = [r["spans"].split(",") for r in pii.find_pii(rows).collect()]
    assert all(len(s) == len(set(s)) for s in spans)


def test_em_learns_reliability():
    counts = {(0, "+++00"): 500, (0, "0-0-0"): 500, (0, "+0000"): 50, (0, "000-0"): 50}
    p = pii.em_posteriors(counts)
    assert p[0, "+++00"] > 0.9 > 0.1 > p[0, "0-0-0"]
    p = pii.em_posteriors({(2, "++00+"): 300, (2, "-+00+"): 300})
    assert p[2, "++00+"] > 0.8 > 0.1 > p[2, "-+00+"]


# --- 2


def plain_sets(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(rows, n, pct):
    sets = [plain_sets(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), min(least[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for g in range(12):
        base = list(rng.choice(words, 30 + 40 * g))
        for c in range(8):
            t = base.copy()
            for _ in range(int(rng.integers(0, max(2, len(t) // 40)))):
                t[int(rng.integers(len(t)))] = "edit" + str(int(rng.integers(1000)))
            out.append(" ".join(t[: len(t) - int(rng.integers(0, 3))]))
    return out


@pytest.mark.parametrize("words,pct", [(4, 85), (5, 80)])
def test_ngram_join(spark, edge, empty, words, pct):
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near_copies())], "doc_id long, text string")
    all_ = edge.select("doc_id", "text").unionByName(made)
    want = plain_components([tuple(r) for r in all_.collect()], words, pct)
    got = ngram_join.ngram_components(all_, words, pct).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    kept = ngram_join.keep_one(edge, words, pct)
    assert kept.columns == edge.columns
    texts = Counter(r["text"] for r in kept.collect())
    assert texts[BASE] == 1 and texts[None] == 2 and texts[""] == 1
    assert ngram_join.ngram_components(empty, words, pct).count() == 0


def test_slices_lose_no_link():
    rng = np.random.default_rng(5)
    for n in (3, 6, 10, 40, 200, 1500, 6000):
        for _ in range(15):
            s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = int(rng.integers(0, max(1, n * 3 // 20) + 1))
            t = np.unique(np.r_[s[gone // 2 :], rng.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)])
            i, u = len(np.intersect1d(s, t)), len(np.union1d(s, t))
            if 100 * i >= 85 * u and i < u:
                bounds = ngram_join._bands(10, 85)
                one, two = ({tag: (set(ngram_join.slice_keys(part, tag, d, usual, x, 85).tolist()), ngram_join.part_sketch(part), parts) for tag, parts, part, d, usual in ngram_join.parts_of(x, 85, bounds)} for x in (s, t))
                met = [g for g in set(one) & set(two) if one[g][0] & two[g][0]]
                apart = lambda g: sum((a ^ b).bit_count() for a, b in zip(one[g][1], two[g][1], strict=True))
                assert any(apart(g) * 185 * one[g][2] <= (len(s) + len(t)) * 15 for g in met)


def test_large_groups_and_clusters_are_cut(spark, monkeypatch):
    """A group of near copies around the bound, with blocks so small that groups and clusters have many."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 16)
    monkeypatch.setattr(ngram_join, "CLUSTER_SHINGLES", 600)
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(160):
        t = base.copy()
        for _ in range(int(rng.integers(0, 5))):
            t[int(rng.integers(90))] = f"e{int(rng.integers(30))}"
        rows.append((i, " ".join(t)))
    want = plain_components(rows, 4, 85)
    assert len({c for _, _, c in want}) > 5
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_members_of_the_commonest_root_are_dealt_once(spark):
    """Only the others are copied; every two rows of different roots have a cell where they may meet."""
    rows = spark.range(100_000).select(F.col("id").alias("cls"), (F.col("id") % 20_000 != 0).alias("common"))
    dealt = rows.select("cls", "common", F.explode(ngram_join._cells(F.col("cls"), F.col("common"), F.lit(100_000), F.lit(99_995))).alias("c"))
    assert dealt.count() < 2 * 100_000
    small = spark.range(9000).select(F.col("id").alias("cls"), (F.col("id") % 3 > 0).alias("common"))
    cells = defaultdict(set)
    for r in small.select("cls", F.explode(ngram_join._cells(F.col("cls"), F.col("common"), F.lit(18_000), F.lit(9000))).alias("c")).collect():
        cells[r["cls"]].add((r["c"]["p"], r["c"]["side"]))
    two = defaultdict(set)
    for c in cells.values():
        for p, side in c:
            two[p].add(side)
    meet = lambda a, b: any(p == q and (s != t or len(two[p]) == 1) for p, s in cells[a] for q, t in cells[b])
    assert all(meet(a, b) for a in range(0, 9000, 303) for b in range(0, 9000, 97) if a != b and (a % 3 == 0 or b % 3 == 0))
    assert all(len(cells[i]) == 1 for i in range(9000) if i % 3)


def test_pairs_grow_with_members_only():
    """However many rows of a group may link, fewer pairs than roots come out, and they connect what may link."""
    rng = np.random.default_rng(2)
    for g in (100, 400):
        root = np.arange(g) % (g // 2)
        sketch = np.repeat(rng.integers(0, 1 << 63, (2, 8)).astype(np.uint64), [g // 4, g - g // 4], axis=0)
        one = np.zeros(g, np.int64)
        a, b = ngram_join.roots_that_may_link(one, one, root, one + 90, one + 1, sketch, 85)
        label = np.arange(g // 2)
        ngram_join.join_labels(label, a, b)
        assert len(a) < g // 2 and len(set(label.tolist())) == 1
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(80)]
    root = rng.integers(0, 40, 80)
    found = ngram_join.links_across(root, np.zeros(80, int), sets, 60)
    label, plain = np.arange(40), np.arange(40)
    ngram_join.join_labels(label, *np.array(found).T)
    close = [(root[i], root[j]) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    ngram_join.join_labels(plain, *np.array(close).T)
    assert len(found) < 40 and label.tolist() == plain.tolist()


def test_one_of_each_component_stays(spark):
    other = " ".join(f"o{i}" for i in range(30))
    rows = [(1, BASE), (1, other), (2, BASE), (None, "z " + other + " z"), (None, "y1 y2 y3 y4 y5 y6"), (None, "y1 y2 y3 y4 y5 y6")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, BASE), (1, other), (None, "y1 y2 y3 y4 y5 y6")])
    named = spark.createDataFrame([(i, BASE, 1, "k") for i in (3, 4)], "doc_id long, text string, __h int, root string")
    assert [tuple(r) for r in ngram_join.keep_one(named).collect()] == [(3, BASE, 1, "k")]


# --- 3


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "http://NET/", "x://a.net", "x://a.net/?q", "https://u.example.net/en/1", "https://example.net/en", "ftp://example.com/de/#x",
            "http://notexample.com/de/", "http://b.org/fr/a?b#c", "http://org/fr/", "http://a..net/x", "http://.net/x", "http://net./x", "http://a.net:80/x", "é://ÄB.NET/é"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, urls[7], "h", "p")] * 2, "page_id long, url string, host string, hit string")

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(h) :])[0]
        host = h.translate(LOWER)
        fit = [(len(a + p), a + p, v) for a, p, v in url_filter.RULES if (host == a or host.endswith("." + a)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    for most in (32 << 20, 0):
        got = url_filter.judge_urls(pages, rules, broadcast_bytes=most).select("url", "host", "path", "rule", "verdict").collect()
        assert Counter(map(tuple, got)) == Counter((u, *plain(u)) for u in [*urls, urls[7], urls[7]])
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_listed_urls(spark):
    """Forms of one URL; and a filter of so few bits that it lets many through, which the exact join must stop."""
    forms = {
        "http://Ex.com:80/a/./b/../c/?utm_source=x&b=2&a=1#top": "ex.com/a/c?a=1&b=2", "https://user:pw@ex.com./a/%7euser/%2f/": "ex.com/a/~user/%2F",
        "https://ex.com:443?ref=1": "ex.com", "https://ex.com/../../x/..": "ex.com", "ftp://ex.com:8080/%zz%4": "ex.com:8080/%zz%4", "http://ex.com/a?x=http://y#z": "ex.com/a?x=http://y",
        "http://": None, "ex.com/a": None, None: None, "http://ex.com/" + "a/" * 20_000: "ex.com" + "/a" * 20_000,
    }
    lines = ["http://a.com/p?x=1\ny=2", "http://a.com/p?x=1\u0085", "http://a.com/p/\n", "http://a.com.\n", "http://a.com/p?x=1\u2028y"]
    odd = spark.createDataFrame([(u,) for u in lines], "url string").select(url_filter.canonical(F.col("url"))).collect()
    assert [r[0] for r in odd] == ["a.com/p?x=1\ny=2", "a.com/p?x=1\u0085", "a.com/p/\n", "a.com.\n", "a.com/p?x=1\u2028y"]
    got = spark.createDataFrame([(u,) for u in forms], "url string").select("url", url_filter.canonical(F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in got} == forms
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/p"), "id", F.lit("?utm_x=1")).alias("url"))
    urls = pages.filter("page_id % 10 = 0").select(F.replace("url", F.lit("?utm_x=1"), F.lit("#x")).alias("url"), F.lit("block").alias("verdict"))
    rules = spark.createDataFrame([("h.com", "/p7", "allow")], "host string, path string, verdict string")
    bits, url_filter.BITS_PER_KEY = url_filter.BITS_PER_KEY, 1
    try:
        for most in (32 << 20, 0):
            out = url_filter.judge_urls(pages, rules, broadcast_bytes=most, urls=urls).collect()
            assert {r["page_id"] for r in out if r["verdict"] == "block"} == {i for i in range(0, 3000, 10) if not str(i).startswith("7")} and len(out) == 3000
    finally:
        url_filter.BITS_PER_KEY = bits


# --- 4


def plain_repeats(rows, span):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], (d, i))
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] != (d, i):
                gone.update(range(i, i + span))
        runs = sum(i - 1 not in gone for i in gone)
        out.append((d, len(b), len(gone), runs, bytes(c for i, c in enumerate(b) if i not in gone)))
    return Counter(out)


def test_suffix_dedup(spark, docs, edge, empty):
    more = ["ab" * 400, "ab" * 60 + "é" * 70, "x" * 99, "x" * 99, "x" * 100, "y" * 50 + "x" * 100, "é" * 70 + "ab" * 60]
    made = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    few = docs.filter("doc_id < 60").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    all_ = edge.filter("doc_id is not null").select("doc_id", "text").unionByName(made).unionByName(few)
    rows = [tuple(r) for r in all_.collect()]
    got = suffix_dedup.repeated_spans(all_).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert Counter((*r[:4], bytes(r[4])) for r in map(tuple, got)) == plain_repeats(rows, 100)
    assert suffix_dedup.repeated_spans(empty).count() == 0
    lost = suffix_dedup.repeated_spans(edge).filter("doc_id is null and n_bytes > 0").collect()
    assert [r["n_removed"] for r in lost] == [r["n_bytes"] for r in lost]


# --- 5


def test_preferences(spark):
    rows = [
        (0, False, 0, "user", "hi"), (0, False, 1, "assistant", "yes"), (0, True, 0, "user", "hi"), (0, True, 1, "assistant", "no <|im_end|>"), (0, True, 1, "assistant", "no <|im_end|>"),
        (1, False, 0, "user", None), (None, True, None, None, "x"), (2, False, 0, "user", "same"), (2, True, 0, "user", "same"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, rejected boolean, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat_format.format_preferences(df).collect()}
    r = got[0]
    assert r["n_prefix"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert r["rejected"] == "<|im_start|>assistant\nno < |im_end|><|im_end|>\n"
    a, z = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][a:z] == "yes<|im_end|>"
    assert got[1]["rejected"] is None and got[1]["prompt"] == "" and got[None]["chosen"] is None
    assert got[2]["n_prefix"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert chat_format.format_preferences(df.limit(0)).count() == 0
    many = [(5, side, i, "user" if i % 2 == 0 else "assistant", "w " * 50 + (str(i) if i < 900 or side else "other")) for i in range(1000) for side in (False, True)]
    named = spark.createDataFrame(many, df.schema).withColumns({"c": F.lit(1), "r": F.lit(2), "n": F.lit(3), "p": F.lit(4), "prompt": F.lit("x")})
    long = chat_format.format_preferences(named).first()
    assert long["n_prefix"] == 900 and long["prompt"].count("<|im_start|>") == 900 and long["chosen"].count("other") == 100
    big = spark.createDataFrame([(2**60 + 1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert chat_format.pair_neighbours(big).first()["pair_id"] == 2**59 and chat_format.pair_neighbours(big).first()["rejected"]


# --- 6


def plain_notices(text, whole):
    """Labels whose notice occurs within its edits anywhere, and the least edits, by the full alignment table."""
    norm = b" ".join(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER).encode()))
    b, least = np.frombuffer(norm, np.uint8), {}
    if not whole and not any(x in norm for x in (b"licen", b"reserved", b"granted", b"permi")):  # the tables have no other notice
        return [], {}
    for notice, label in license_scan.NOTICES.items():
        pat, k = np.frombuffer(notice.encode(), np.uint8), max(1, len(notice) * 5 // 100)
        row, places = np.zeros(len(b) + 1, np.int32), np.arange(len(b) + 1)
        for i in range(len(pat)):
            new = np.minimum(row[:-1] + (b != pat[i]), row[1:] + 1)
            new = np.r_[i + 1, new]
            row = np.minimum.accumulate(new - places) + places
        if row.min() <= k:
            least[label] = min(int(row.min()), least.get(label, 99))
    return list(least), least


def test_many_license_hits():
    notices = license_scan.Notices(license_scan.NOTICES, 5)
    found = license_scan.scan_text(b"mit license foo licensed under the mit license bar".split() * 2000, notices)
    assert len(found["base"]) == 4000 and len(found["spans"]) == 2000 and found["spans"][1][:3] == (12, 16, "mit")


def test_licenses(spark, docs, edge, empty):
    near = "Permision is hereby granted, free of charge, to any persons obtaining a copy of this software"
    made = spark.createDataFrame([(7000, "see: MIT  License, mit-license (MIT license)"), (7001, near), (7002, "Apache\nLicense! general public license")], "doc_id long, text string")
    rng, edited = np.random.default_rng(6), []
    for i, notice in enumerate(list(license_scan.NOTICES) * 2):
        t = list(notice)
        for _ in range(int(rng.integers(0, 2 + len(t) * 5 // 100))):
            t[int(rng.integers(len(t)))] = str(rng.choice(["", "x", "qq", " "]))
        edited.append((7100 + i, f"before it {''.join(t)} and after"))
    made = made.unionByName(spark.createDataFrame(edited, made.schema))
    all_ = docs.select("doc_id", "text").unionByName(made).unionByName(edge.select("doc_id", "text").filter("doc_id is not null").select((F.col("doc_id") + 8000).alias("doc_id"), "text"))
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(all_.dropDuplicates(["doc_id"])).collect()}
    for d, t in {(r["doc_id"], r["text"]) for r in all_.collect()}:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = rows[d]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    brute = {d: plain_notices(t, 7000 <= d < 8000) for d, t in {(r["doc_id"], r["text"]) for r in all_.collect()}}
    for d, (labels, least) in brute.items():
        mine = [x for x in rows[d]["spans"]]
        assert {x["label"] for x in mine} == set(labels) and all(min(x["edits"] for x in mine if x["label"] == label) == least[label] for label in labels)
    assert sum(len(labels) for labels, _ in brute.values()) > 50
    assert rows[7001]["labels"] == "mit" and rows[7001]["n_base"] == 0 and 0 < rows[7001]["score"] < 1
    assert license_scan.scan_licenses(empty).count() == 0


# --- 7


def plain_leaks(rows, items, window=80, min_bytes=40):
    """Every window against every whole text, without any filter."""
    wins, short = defaultdict(list), []
    for item, text in items:
        x = squeezed((text or "").encode()).rstrip(b" ")
        if len(x) >= min_bytes:
            m = min(window, len(x))
            for at in {*range(0, len(x) - m + 1, max(1, 2 * (m // 10))), len(x) - m}:
                wins[m].append((item, np.frombuffer(x[at : at + m], np.uint8)))
        elif x:
            short.append((item, x))
    out = set()
    for d, t in rows:
        raw = squeezed((t or "").encode()).rstrip(b" ")
        out |= {(d, item) for item, x in short if (x == raw if len(x) < 8 else b" " + x + b" " in b" " + raw + b" ")}
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            continue
        for m, all_ in wins.items():
            pats = np.stack([x for _, x in all_])
            row = np.zeros((len(all_), len(b) + 1), np.int32)
            for i in range(m):
                new = np.minimum(row[:, :-1] + (b[None, :] != pats[:, i : i + 1]), row[:, 1:] + 1)
                new = np.concatenate([np.full((len(all_), 1), i + 1), new], axis=1).astype(np.int32)
                places = np.arange(new.shape[1], dtype=np.int32)
                row = np.minimum.accumulate(new - places, axis=1) + places
            out |= {(d, all_[i][0]) for i in np.flatnonzero(row.min(axis=1) <= m // 10)}
    return out


def squeezed(raw):
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", raw.lower()).lstrip(b" ")


def test_leaks(spark, empty):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(rng.choice(["the", "tion", "and", "ering", "of", "houses", "blue"], 30))) for i in range(6)]
    items += [(6, None), (7, "a short item"), (8, "a passage of fifty one characters, no more than that"), (9, ""), (10, "tiny"), (11, "a short item")]
    texts = []
    for i, t in items[:6]:
        e = list(t)
        for _ in range(4 * i):
            e[int(rng.integers(len(e)))] = "#"
        texts += ["before it  \n stands " + "".join(e)[: 200 - 20 * i] + " and after", "".join(e)]
    texts += [None, "", " ".join(rng.choice(["the", "tion", "and", "ering", "of", "houses", "blue"], 200)), items[8][1].upper(), "é" * 120]
    texts += ["here is  A short\nitem .", "a short items", "tiny", "a tiny one", "zz" * 60 + items[0][1][27:107] + "yy" * 60, ("w " * 20_000) + items[1][1]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(list(enumerate(texts)), items)
    for rules in (decontaminate.LeakRules(), decontaminate.LeakRules(block_bytes=100)):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, rules).collect()}
        assert got == want and want
    assert {(len(texts) - 2, 0), (len(texts) - 1, 1), (len(texts) - 6, 7)} <= want
    whole = docs.select("*", F.lit("x").alias("__h"), F.lit(1).alias("item_id"))
    kept = decontaminate.drop_leaks(whole.unionByName(whole), bench, decontaminate.LeakRules(block_bytes=200))
    assert kept.columns == whole.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({d: 2 for d in set(range(len(texts))) - {d for d, _ in want}})
    for kind in ("int", "string"):
        typed = bench.withColumn("item_id", F.col("item_id").cast(kind))
        got = {(r["doc_id"], int(r["item_id"])) for r in decontaminate.find_leaks(docs, typed).collect()}
        assert got == want
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_phrases_that_many_items_share(spark, monkeypatch):
    """Each item holds the same phrase, the text holds it hundreds of times; hits come in parts of a few items."""
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(made, n))
    items = [(i, some(10) + " one of the following " + some(11)) for i in range(60)]
    texts = [" ".join(some(12) + " one of the following" for _ in range(60)) + " " + items[7][1], "-" * 400 + items[9][1][20:130], some(50)]
    for hits, pairs in ((1 << 21, 1 << 15), (500, 64)):
        monkeypatch.setattr(decontaminate, "_HITS", hits)
        monkeypatch.setattr(decontaminate, "_PAIRS", pairs)
        ix = decontaminate.ItemIndex(items, decontaminate.LeakRules())
        raw = "".join(texts).encode()
        b, new = decontaminate.squeeze(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
        got = {x[:2] for x in decontaminate.leaks_in(ix, b, new)}
        assert got == plain_leaks(list(enumerate(texts)), items) and {(0, 7), (1, 9)} <= got


# --- 8


def plain_mix(rows):
    size = {i: len(WORD.findall(t or "")) for i, (_, t, _) in enumerate(rows)}
    total = Counter()
    for i, r in enumerate(rows):
        total[r[2]] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, rest, open_ = {}, sum(total.values()), set(names)
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            return total, target | share
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= target[s]
        open_ -= over
    return total, target


def test_mixing(spark, docs, edge, empty):
    for table in (docs, edge):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
        total, target = plain_mix(rows)
        got = mixing.mix_sources(table).collect()
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        for s in total:
            assert abs(taken[s] - target[s]) <= 1
        again = mixing.mix_sources(table.repartition(7)).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))
        few = Counter(map(tuple, mixing.mix_sources(table, bits=1).collect()))
        assert few == Counter(map(tuple, got))
    assert mixing.mix_sources(empty).count() == 0


# --- 9


def test_quality(spark, edge, empty):
    rows = {r["doc_id"]: r for r in quality.quality_report(edge.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for i, t in enumerate(EDGE):
        w = WORD.findall(t or "")
        wins = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + k for j in range(len(w) - 4) if wins[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    out = quality.clean_documents(edge)
    assert out.columns == edge.columns and out.filter("text is null").count() == 0
    junk = spark.createDataFrame([(1, BASE + "\nHome | About | Contact | Help | More\n" + " ".join(f"other{i}" for i in range(40)))], "doc_id long, text string")
    assert "Home" not in quality.clean_documents(junk).first()["text"]
    assert quality.clean_documents(empty).count() == 0 and quality.quality_report(empty).count() == 0
    good = "\n".join(" ".join(f"{w}{i}" for w in ("line", "page", "more", "words", "than", "have")) + "." for i in range(9))
    bad = ["Start » News » Sport » Wetter » Kontakt", "Tout accepter et continuer", "one two three four five six seven eight nine", "WOW!! BUY!! NOW!!", "### *** $$$ %%% a b c"]
    fine = ["a heading of four", "Does a question count as a sentence, too?", "Le prix est de 20 € · en magasin, dit la notice de cette page."]
    made = spark.createDataFrame([(i, good + "\n" + x) for i, x in enumerate(bad + fine)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in quality.clean_documents(made).collect()}
    assert all((left[i] == good) == (i < len(bad)) for i in left) and len(left) == len(bad + fine)


# --- 10


def test_lines(spark, docs, edge, empty):
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, f"  SAME Line \nown {i}\n\nsame line\n") for i in range(12)] + [(9100, "same line")] * 3, "doc_id long, text string"))
    rows = [tuple(r) for r in table.collect()]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = Counter()
    for d, t in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if not (key(x) and n[key(x)] >= 10)]
        want[d, len(all_), len(all_) - len(left), "\n".join(left)] += 1
    x = F.col("__lines")
    for batches in (1, 5):
        got = line_dedup.drop_frequent_lines(table, batches=batches).select("doc_id", x["n_lines"], x["n_dropped"], x["text"]).collect()
        assert Counter(map(tuple, got)) == want
    assert line_dedup.dedup_lines(edge).columns == edge.columns and line_dedup.dedup_lines(edge).count() == edge.count()
    named = edge.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("t1", "bad", "d", "r", "__t1", "__lines")])
    kept = line_dedup.dedup_lines(named)
    assert kept.columns == named.columns and kept.filter("t1 = 'mine' and bad = 'mine' and d = 'mine' and __lines = 'mine'").count() == edge.count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, 3, fanout=2, buckets=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, 2, 1 if i == 0 else 0), (i, 9, 1)], "k1 long, k2 long, c long").filter("c > 0"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(1, 1)]
    runs.close()
    rng, every = np.random.default_rng(12), Counter()
    runs = line_dedup.LineRuns(spark, 5, buckets=16)
    for _ in range(5):
        rows = [(int(k), int(k) * 7, 1) for k in rng.integers(0, 2000, 1500)]
        every.update(k for k, _, _ in rows)
        runs.add(spark.createDataFrame(rows, "k1 long, k2 long, c long"))
    want = {k for k, n in every.items() if n >= 5}
    assert len(want) > 100 and {r["k1"] for r in runs.frequent().collect()} == want == {r["k1"] for r in line_dedup.cut(runs.frequent(), "t").collect()}
    runs.close()
    assert line_dedup.bucket_count(10**6, 4) == 16 and line_dedup.bucket_count(10**11, 4) == 6250


# --- the pipeline


def test_pipeline(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    report = {r["doc_id"]: r for r in docs.select("doc_id", quality.measures("text").alias("q")).select("doc_id", "q.*").collect()}
    kept = [r | {"text": report[r["doc_id"]]["clean_text"]} for r in rows if report[r["doc_id"]]["kept"]]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n = Counter(k for r in kept for k in {key(x) for x in r["text"].split("\n")})
    for r in kept:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if not (key(x) and n[key(x)] >= 10))
    comps = plain_components([(r["doc_id"], r["text"]) for r in kept], 5, 80)
    kept = [r for r, (d, _, c) in zip(kept, comps, strict=True) if d == c]
    leaks = {d for d, _ in plain_leaks([(r["doc_id"], r["text"]) for r in kept], items)}
    kept = [r for r in kept if r["doc_id"] not in leaks]
    total, target = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in kept])
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in kept} and len(got) == len(kept)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]])
    assert all(abs(taken[s] - target[s]) <= 1 for s in total)


def test_stages_keep_columns(spark, edge, tmp_path):
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5
