"""Operators that compare documents with each other, against brute force, with their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, ngram_join, quality, suffix_dedup, url_filter
from plumbline.llm.graph import connected_components

SCHEMA = "doc_id long, text string"


# ------------------------------------------------------------ repeated strings


def brute_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated_rows(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    passages = [make(450), make(600), make(410), make(399), "xy" * 300]
    rows = [(0, None), (1, ""), (2, "a" * 1500), (3, "short")]
    for i in range(4, 30):
        text = make(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            part = p[rng.randint(0, 60) : len(p) - rng.randint(0, 30)]
            if rng.random() < 0.3:
                k = rng.randrange(len(part))
                part = part[:k] + "Z" + part[k + 1 :]
            text += part + make(rng.randint(0, 300))
        rows.append((i, text))
    return rows + [rows[10], rows[12], (99, rows[20][1]), (20, "other " + (rows[21][1] or "")), (None, rows[22][1]), (None, rows[22][1])]


@pytest.mark.parametrize("seed, hot", [(1, 20_000), (2, 2)])
def test_repeats_equal_brute_force(spark, seed, hot):
    rows = repeated_rows(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "k1", "spans", "h")})
    got = suffix_dedup.remove_repeats(docs, hot_classes=hot)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_repeats(rows, 400)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_text_in_parts(spark, monkeypatch):
    from plumbline.llm import textkit as tk

    monkeypatch.setattr(tk, "SLAB", 700)
    rng = random.Random(3)
    part = "".join(rng.choices("abcdefg ", k=900))
    data = np.frombuffer(("x".join([part, "".join(rng.choices("abcdefg ", k=3000)), part])).encode(), np.uint8)
    at = np.array([0, len(data)])
    whole = set(zip(*suffix_dedup.window_anchors(data, at, 400)[:3], strict=True))
    windows = lambda found: {(p, w) for p, a, b in found for w in range(a, b + 1)}
    parts = {(p + s, a + s, b + s) for s, d, bounds in suffix_dedup._pieces(data, at, 400) for p, a, b in zip(*suffix_dedup.window_anchors(d, bounds, 400)[:3], strict=True)}
    assert windows(parts) == windows(whole)


def test_suffix_sort():
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=rng.randint(1, 30))).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    group = np.sort(np.array([rng.randint(0, 9) for _ in texts]))
    order, shared = suffix_dedup.Suffixes(data, ends - [len(t) for t in texts], ends).sort(group)
    assert [(group[i], texts[i]) for i in order] == sorted(zip(group, texts, strict=True))
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == (common if group[order[k]] == group[order[k - 1]] else -1)


# ------------------------------------------------------------ n-gram join


def brute_components(rows, n, num, den):
    sets, up = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        up[d] = d

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(seed, count=90):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, "two one"), (6, " \n")]
    bases = [rng.choices(vocabulary, k=rng.randint(3, 120)) for _ in range(10)]
    for d in range(10, 10 + count):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else rng.choices(vocabulary, k=rng.randint(1, 60))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("n, num, den, block, crowd", [(3, 9, 10, 1024, 4096), (5, 4, 5, 8, 4)])
def test_components_equal_brute_force(spark, monkeypatch, n, num, den, block, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rows = near_copies(n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "key", "node", "cluster", "size")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, n=n, num=num, den=den, block=block).collect()}
    want = brute_components(rows, n, num, den)
    assert got == want
    kept = ngram_join.keep_first(docs, n=n, num=num, den=den)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (k, c) in want.items() if k == 0 or c == d)


def test_ngrams_of_the_same_classes_count_once(spark):
    rows = [(t, n, 10) for t in range(5) for n in (1, 2)] + [(7, n, 10) for n in (1, 2, 3)] + [(8, 4, 10), (8, 5, 12)] + [(9, 4, 9), (9, 6, 10)]
    held = spark.createDataFrame(rows, "token long, node long, size long")
    assert sorted(tuple(r) for r in ngram_join.telling_tokens(held, 9, 10).collect()) == [(0, 2), (7, 3), (9, 2)]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, ""), (3, "")], SCHEMA)
    assert [r["component_id"] for r in ngram_join.ngram_components(docs).where("n_shingles > 0").collect()] == [1] * 4
    kept = [r["doc_id"] for r in ngram_join.keep_first(docs).collect()]
    assert sorted(kept) == [1, 3, 3]
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(10_000, rng.integers(1, 200), replace=False).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(60):
        s = base[rng.integers(6)].copy()
        s[: rng.integers(0, 1 + len(s) // 6)] = rng.choice(10_000, 1)[0]
        sets.append(np.unique(s))
    sets = list({s.tobytes(): s for s in sets}.values())
    for split in (None, 20):
        links = ngram_join.block_links(sets[:split], None if split is None else sets[split:], 4, 5)
        up = list(range(len(sets)))
        root = lambda x: x if up[x] == x else root(up[x])
        for i, j in links:
            up[root(i)] = root(j)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                linked = 9 * both >= 4 * (len(sets[i]) + len(sets[j]))
                if linked and (split is None or (j < split <= i)):
                    assert root(i) == root(j)
        for i, j in links:
            assert 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))


def test_components_of_graphs(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ lines


def brute_lines(rows):
    sets, index, out = [], defaultdict(list), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        kept, lines = [], (t or "").split("\n")
        for line in lines:
            w = [x for x in line.split(" ") if x]
            s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            count = Counter(e for g in s for e in index[g])
            if not any(9 * k >= 4 * (len(s) + len(sets[e])) for e, k in count.items()):
                kept.append(line)
            for g in s:
                index[g].append(len(sets))
            sets.append(s)
        out.append((d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


def test_clashing_names_of_lines(spark):
    docs = spark.createDataFrame([(1, "a b c d e f\nshort"), (2, "a b c d e f")], SCHEMA).withColumns({c: F.lit("own") for c in ("kept", "n_removed", "n_lines", "gone", "k1", "c0", "first", "h1")})
    found = line_dedup.dedup_lines(docs)
    assert [tuple(r) for r in found.select("doc_id", "n_lines", "n_removed", "kept", "gone", "first").orderBy("doc_id").collect()] == [(1, 2, 0, "a b c d e f\nshort", "own", "own"), (2, 1, 1, "", "own", "own")]
    left = line_dedup.keep_lines(docs)
    assert left.columns == docs.columns and [(r["doc_id"], r["kept"]) for r in left.collect()] == [(1, "own")]


@pytest.mark.parametrize("crowd", [64, 2])
def test_lines_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    vocabulary = [f"w{i}" for i in range(40)]
    bases = [rng.choices(vocabulary, k=rng.randint(1, 60)) for _ in range(12)]

    def line():
        words = list(rng.choice(bases)) if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return rng.choice([" ", "  "]).join(words)

    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "x " * 20_000)] + [(d, "\n".join(line() for _ in range(rng.randint(0, 6)))) for d in range(4, 60)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "key", "pos", "line", "tokens")})
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "kept").collect()
    want = [(d, 0 if k is None else n, m, k) for d, n, m, k in brute_lines(rows)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_lines_of_repeated_rows(spark):
    text = "a b c d e f\nshort\na b c d e f"
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a b c d e f")], SCHEMA)
    got = [(r["doc_id"], r["kept"]) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == [(1, "short"), (1, "short"), (None, "a b c d e f")]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_only_crowded_tokens_are_joined(spark):
    sets = spark.createDataFrame([(1, [9, 2, 7, 4]), (2, [3, 2, 1]), (3, [5, 6])], "node long, tokens array<long>")
    crowd = spark.createDataFrame([(2, 10), (7, 9), (8, 9)], "token long, level int")
    found = line_dedup._reordered(sets, crowd)
    assert sorted((r["node"], r["tokens"]) for r in found.collect()) == [(1, [4, 9, 7, 2]), (2, [1, 3, 2])]
    assert "LeftOuter" not in found._jdf.queryExecution().toString()


def test_telling_tokens_of_lines(spark):
    rows = [(1, 10, 0, 100), (2, 10, 0, 100), (1, 10, 1, 101), (2, 10, 1, 101)]  # same holders: the first in order
    rows += [(3, 10, 0, 102), (4, 14, 0, 102), (5, 10, 6, 103), (6, 10, 6, 103)]  # too far apart in size; too late in both
    rows += [(7, 10, 0, 104), (7, 10, 0, 104), (8, 10, 0, 105), (8, 10, 0, 105)]  # a repeated row's line
    rows += [(1, 10, 2, 106), (2, 10, 2, 106), (3, 10, 1, 106)]
    found = spark.createDataFrame(rows, "h1 long, size int, i int, token long").withColumn("h2", F.xxhash64("h1"))
    assert sorted(r["token"] for r in line_dedup._telling(found).collect()) == [100, 104, 105, 106]


def test_tables_of_lines_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(line_dedup, "checkpointed", lambda df, real=line_dedup.checkpointed: made.append(df.columns) or real(df))
    docs = spark.createDataFrame([(1, "a b c d e f\nshort"), (2, "a b c d e f g"), (3, "short\nb c d e f")], SCHEMA)
    assert line_dedup.dedup_lines(docs, least=1).orderBy("doc_id").collect()[2]["kept"] == "b c d e f"
    assert made == [["k1", "k2", "gone"]]  # a checkpoint computes its last stage twice


def test_prefixes_are_the_first_tokens(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choices("abcdefghijklmnopqrstuvw"[:v], k=rng.randint(0, 70))) for _ in range(20)) for v in (1, 2, 4, 23)]
    rows = line_dedup._documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "doc_id", "text")
    whole = line_dedup._tokenized(rows.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")))
    tokens = {(r["id"], r["pos"]): sorted(r["tokens"]) for r in whole.collect()}
    got = line_dedup.line_prefixes(rows, 1).collect()
    assert len(got) == 80 and any(r["low"] < len(tokens[r["id"], r["pos"]]) < r["size"] for r in got)
    for r in got:
        want, taken = tokens[r["id"], r["pos"]], r["size"] // 5 + line_dedup.COMMON
        assert r["low"] <= len(want) <= r["size"] and r["prefix"] == want[:taken]


def test_lines_of_a_common_phrase_are_not_tokenized_again(spark, monkeypatch):
    made = []

    def tokenized(lines, *least, real=line_dedup._tokenized):
        made.append(lines.count())
        return real(lines, *least)

    monkeypatch.setattr(line_dedup, "_tokenized", tokenized)
    lines = ["in the middle of the night " + " ".join(f"w{i}x{k}" for k in range(34)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, lines[7] + " more"])], SCHEMA)
    assert [r["doc_id"] for r in line_dedup.dedup_lines(docs).where("n_removed > 0").collect()] == [60]
    assert made == [2]  # the lines share two shingles, three are asked for


def test_unusual_characters_hold_odd_space(spark):
    signs = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("sign"))
    found = signs.select("id", F.col("sign").rlike(line_dedup.ODD_SPACE).alias("odd"), F.col("sign").rlike(line_dedup.UNUSUAL).alias("unusual"))
    assert found.where("odd").count() == 25 and found.where("odd and not unusual").count() == 0
    assert found.where("not unusual").count() == 95 + 95


def brute_all_lines(rows):
    sets, out = [], []
    for d, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            w = line.split()
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            if not s or not any(9 * len(s & e) >= 4 * (len(s) + len(e)) for e in sets):
                kept.append(line)
            sets.append(s)
        out.append((d, "\n".join(kept)))
    return out


@pytest.mark.parametrize("crowd", [64, 2])
def test_short_and_unspaced_lines(spark, monkeypatch, tmp_path, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    chinese, thai, tabs = "\u4eca\u5929\u5929\u6c14\u5f88\u597d" * 9, "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49" * 9, "a\tb\tc\td\te\tf"
    lines = ["Les.", "Les. ", "les.", "And ornd.", "And\tornd.", "", " ", "a b c d", "a b c d e", chinese, thai, thai + "\u3000x", tabs, tabs.replace("\t", "\u00a0"), "a b c d e f\r"]
    rows = [(0, "Les.\nLes.\n\n\nLes."), (1, chinese), (2, chinese), (3, tabs), (4, "a b c d e f")]
    rows += [(d, "\n".join(rng.choices(lines, k=rng.randint(1, 5)))) for d in range(5, 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_all_lines(rows)
    got = line_dedup.dedup_lines(docs, least=1).select("doc_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == want and want[0][1] == "Les.\n\n" and want[2][1] == want[4][1] == ""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    digests = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert digests == {d: hashlib.sha256(k.encode()).hexdigest() for d, k in want}


# ------------------------------------------------------------ urls


def test_urls(spark):
    urls = ["http://A.Example.com/en/7x", "https://x.com/en/", "http://com/en/1", "ftp://d.example.net/de/88?q", "http://m.net/de/", "https://org/es/", "http://xcom/en/", "no scheme", None, "http://h?://x/en/", "http://example.com/EN/7", "http://", "http://a.co.uk/p#f"]
    pages = spark.createDataFrame([(i, u, "<p>" + "good words " * 20) for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "bound", "good", "id")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert [got[i][2] for i in range(len(urls))] == ["example.com/en/7", "com/en/", "com/en/", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None, None, None]
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3][3] == "block" and got[8] == ("", "", None, got[8][3]) and got[9][:2] == ("h", "")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    domains = pages.select(url_filter.domain_of(url_filter.host_of(F.col("url"))).alias("d"), url_filter.suffix_of(url_filter.host_of(F.col("url"))).alias("s")).collect()
    assert tuple(domains[12]) == ("a.co.uk", "co.uk") and tuple(domains[0]) == ("example.com", "com")


def test_rules_give_the_contracts_verdicts(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(url_filter.RULES) == rules
    pages = spark.createDataFrame([(i, f"http://{r}") for i, r in enumerate(rules)], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))  # null html: the method blocks
    assert {r["rule"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()} == rules
    assert all(f"WHEN rule = '{rule}' THEN '{verdict}'" in url_filter.ORACLE for rule, verdict in rules.items())


def test_reputation_shrinks(spark):
    rows = [("big.a.com", int(i < 95)) for i in range(100)] + [("bad.b.com", int(i < 5)) for i in range(100)] + [("new.a.com", 0), ("fresh.b.com", 1)] + [(f"h{i}.c.org", i % 2) for i in range(40)]
    got = {r["host"]: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["new.a.com"]["mean"] > 0.3 and got["fresh.b.com"]["mean"] < 0.7
    assert got["big.a.com"]["above"] > 0.99 and got["bad.b.com"]["above"] < 0.01
    assert 0.05 < got["new.a.com"]["above"] < 0.99
    pages = spark.createDataFrame([(i, f"http://{h}/x", None) for i, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    verdicts = {r["host"]: r["verdict"] for r in url_filter.filter_urls(pages, outcomes=spark.createDataFrame(rows, "host string, good int")).collect()}
    assert verdicts["big.a.com"] == "allow" and verdicts["bad.b.com"] == verdicts["h1.c.org"] == "block"


def test_share_of_a_beta_distribution(spark):
    rng = np.random.default_rng(2)
    cases = [(1.0, 1.0), (2.5, 7.0), (40.0, 30.0), (0.6, 3.0), (900.0, 1000.0)]
    df = spark.createDataFrame(cases, "a double, b double").select(url_filter.beta_above(F.col("a"), F.col("b"), 0.5).alias("x"))
    for (a, b), r in zip(cases, df.collect(), strict=True):
        assert abs(r["x"] - (rng.beta(a, b, 400_000) >= 0.5).mean()) < 0.01


def test_odd_pages(spark):
    rows = [(1, "http://a.com/" + "x" * 100_000, "<p>" + "good words " * 20_000), (2, None, None), (2, None, None), (3, "http://a.com/", ""), (None, "http://b.com/?q", "<p>" + "words " * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "above", "mean", "a", "b", "good", "domain")})
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == 5 and all(r["verdict"] in ("allow", "block") and 0 <= r["above"] <= 1 for r in got)
    assert [(r["host"], r["path"]) for r in got if r["page_id"] == 2] == [("", "")] * 2


def test_urls_match_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(url_filter.ORACLE).df()
    got = url_filter.query(spark, sf).toPandas()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].where(df.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


# ------------------------------------------------------------ pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline
    from plumbline.llm import decontaminate, quality
    from plumbline.session import stored

    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        kept[name] = docs
        if name != "best-fit packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
    rows = {n: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for n, df in kept.items() if n != "best-fit packing"}
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    scores = quality.score_quality(before, quality.fit_quality(before, labels))
    assert set(rows["quality classifier"]) == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    want = dict(brute_all_lines(list(rows["quality classifier"].items())))
    assert rows["line dedup"] == {d: k for d, k in want.items() if k.strip() or k == rows["quality classifier"][d]}
    groups = brute_components(list(rows["line dedup"].items()), 5, 4, 5)
    assert set(rows["n-gram Jaccard join"]) == {d for d, (k, c) in groups.items() if k == 0 or c == d}
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(kept["n-gram Jaccard join"], bench).collect()}
    assert set(rows["benchmark decontamination"]) == set(rows["n-gram Jaccard join"]) - leaks
    assert {r["doc_id"] for r in kept["best-fit packing"].collect()} == set(rows["benchmark decontamination"])


def test_pipeline_of_odd_rows(spark, sf):
    import corpus_pipeline

    text = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 800 and 2000").orderBy("doc_id").first()["text"]
    rows = [(1, text, "en", "a", 1, 7), (1, text, "en", "b", 1, 8), (None, text + " more", "en", None, None, 9), (3, None, None, None, None, None), (4, "", "en", "a", 0, 1), (5, "x" * 200_000, "en", "a", 0, 1), (6, text + "\nOne more line stands here.", "en", "a", 0, 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    docs = spark.createDataFrame(rows, names).withColumns({c: F.lit("clash") for c in ("n_removed", "n_lines", "gone", "key", "k1", "c0", "first", "rank", "score", "piece")})
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf)
        if name == "best-fit packing":
            assert {r["doc_id"] for r in found.collect()} >= {3, 4, 5}
            continue
        assert found.schema.simpleString() == docs.schema.simpleString()
        ids = [r["doc_id"] for r in found.collect()]
        if name == "quality classifier":  # a null text is judged as an empty one, equal texts alike; the documents at hand hold no labelled row, so every score is that of a fit on nothing
            scores = quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            assert len(scores) == len(rows) and sorted(ids, key=str) == sorted((r["doc_id"] for r in scores if r["predicted"] == 1), key=str)
            assert len({r["score"] for r in scores if r["doc_id"] in (3, 4)}) == len({r["score"] for r in scores if r["doc_id"] == 1}) == 1
        elif name == "line dedup":  # null stands before all ids; repeated rows are judged alike, and lose every word to it
            assert sorted(ids, key=str) == [3, 4, 5, 6, None]
            assert found.where("doc_id = 6").first()["text"] == "One more line stands here."
        elif name == "n-gram Jaccard join":
            assert sorted(ids, key=str) == [1, 3, 4, 5]
            assert [r["source"] for r in found.where("doc_id = 1").collect()] == ["a"]
        else:
            assert len(ids) == len(rows)


def test_pipeline_of_nothing(spark, sf, tmp_path):
    import corpus_pipeline

    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_registered(sf):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
