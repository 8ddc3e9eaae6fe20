"""Per-document operators against brute force, with their edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, licenses, packing, quality, quality_rules, toxicity
from plumbline.llm import textkit as tk
from plumbline.llm.labelled import fold

SCHEMA = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, "word"), (4, "word"), (None, "no id here"), (5, "x" * 300_000), (6, "a b c " * 40_000), (7, "é ß \x00 \t mixed\r\nLINES")]


def edge_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use themselves."""
    return spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "score", "key", "line", "tokens", "labels", "piece", "size", "length")})


# ------------------------------------------------------------ words and hashes


def test_words_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choices("ab Zé9_\n\t\x0b|\x00", k=rng.randint(0, 30))) for _ in range(5)]
        batch = pa.RecordBatch.from_pydict({"text": pa.array([*texts, None])})
        for _, data, at in tk.slabs(batch):
            words = tk.Words(data, at, tk.NOT_SPACE)
            got = [[bytes(data[a:b]) for a, b in zip(words.starts[i:j], words.ends[i:j], strict=True)] for i, j in zip(words.first, words.first[1:], strict=False)]
            assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in [*texts, ""]]


def test_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 5000, dtype=np.uint8)
    prefix = tk.PrefixHash(data)
    starts = rng.integers(0, 4900, 3000)
    hashes = prefix.of(starts, starts + 6)
    by_bytes = {}
    for s, h in zip(starts, hashes, strict=True):
        assert by_bytes.setdefault(data[s : s + 6].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)


def test_shingle_sets():
    texts = ["a b c d", "A B c", "a b", "b a", "", "a b c a b c"]
    data, at = tk.flat(pa.array(texts))
    row, grams = tk.shingle_sets(data, at, 3)
    sets = [set(grams[row == i]) for i in range(len(texts))]
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 3]
    assert sets[1] < sets[0] and sets[2] != sets[3] and sets[1] < sets[5]


# ------------------------------------------------------------ licences


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(hits)


def test_licence_places(spark):
    rng = random.Random(2)
    vocabulary = "under the mit license apache version 2 cc by nc licensed x 4 0".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(300)] + ["Released Under THE MIT License.", "CC-BY-NC", "under the mit the mit license", None]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for row in licenses.scan_licenses(docs).collect():
        n, hits = brute_places(texts[row["doc_id"]])
        assert (row["n_words"], row["n_base"]) == (n, len(hits))
        assert (row["first_word"], row["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert row["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def test_licence_spans(spark):
    text = "intro words. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files. This work is licensed under the GNU General Public License, version 3."
    row = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "the license of the software is free")], SCHEMA)).orderBy("doc_id").collect()
    assert row[0]["labels"] == "gpl-3,mit" and {s["label"] for s in row[0]["spans"]} == {"gpl-3", "mit"}
    assert row[1]["labels"] == "" and row[1]["score"] == 0


def test_automaton_holds_every_factor():
    machine = licenses.LicenseAutomaton({"a b": "x"}, {"t": ["a b c a b d", "b c a"]})
    for text in ("a b c a b d", "b c a"):
        words = text.encode().split()
        for i in range(len(words)):
            *_, (_, length, _) = machine.statistics(words[i:])
            assert length == len(words) - i


# ------------------------------------------------------------ packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(3)
    texts = [None, "", "²½ Ⅳ <|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext |>"] + [" ".join(rng.choices(["alpha", "béta", "don't", "12", "\n", "##"], k=rng.randint(1, 3000))) for _ in range(60)] + ["same"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = packing.pack_documents(docs, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = b"".join(p["ids"] for p in parts)
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert [p["length"] for p in parts[1:]] == [1024] * (len(parts) - 1)
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] for p in parts)
    total = 0
    for members in by_sequence.values():
        members.sort(key=lambda r: r["offset"])
        assert [m["offset"] for m in members] == np.cumsum([0, *(m["length"] for m in members)])[:-1].tolist()
        assert sum(m["length"] for m in members) <= 1024
        total += sum(m["length"] for m in members)
    assert len(by_sequence) <= -(-total // 1024) + 1


@pytest.mark.parametrize("seed", range(6))
def test_complements_fill_sequences_and_never_lose_to_best_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(60)}
    exact = packing.complements(counts, 100)
    assert exact and all(sum(slots) == 100 and 1 <= len(slots) <= 4 for slots, _ in exact)
    spent = {x: sum(slots.count(x) * n for slots, n in exact) for x in counts}
    assert all(spent[x] <= n for x, n in counts.items())
    left = [x for x in counts for _ in range(min(4, counts[x] - spent[x]))]  # no length has a complement of one to three left
    sums = {0: 1} | {sum(c): 1 for k in (1, 2, 3, 4) for c in itertools.combinations(left[:40], k)}
    assert 100 not in sums
    plan = packing.plan_patterns(counts, 100)
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 100))


def test_the_query_uses_pairs_and_triples(spark, sf):
    rows = packing.query(spark, sf).select("sequence_id", "length").collect()
    sizes, filled = Counter(r["sequence_id"] for r in rows), Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    exact = Counter(sizes[s] for s, n in filled.items() if n == 1024)
    assert exact[2] and exact[3] and exact[4]
    lengths = Counter(r["length"] for r in rows)
    assert len(sizes) <= min(193, sum(n for _, n in packing.best_fit(dict(lengths))))


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_all_counts(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(0, 40))}
    used = {}
    plan = packing.plan_patterns(counts, 64)
    for slots, n in plan:
        assert sum(slots) <= 64
        for s in slots:
            used[s] = used.get(s, 0) + n
    assert used == counts
    bins = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):  # first fit decreasing
        at = next((i for i, room in enumerate(bins) if room >= length), None)
        if at is None:
            bins.append(64 - length)
        else:
            bins[at] -= length
    assert sum(n for _, n in plan) <= len(bins) * 1.02 + 1
    big = {k: v * 10**9 for k, v in counts.items()}
    assert sum(s.count(k) * n for s, n in packing.plan_patterns(big, 64) for k in set(s)) == sum(big.values())
    ranges = packing._ranges(plan)
    for length, n in counts.items():
        spans = sorted((lo, hi) for k, lo, hi, _, _ in ranges if k == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


# ------------------------------------------------------------ quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_rule_counts(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "a\n", "a\na\na", "\n\n a"] + ["".join(rng.choices("ab é#\n \t\x0b|\x00", k=rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in quality_rules.judge_rules(docs, quality_rules.fit_field([])).collect():
        want = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(3)
    field = quality_rules.LineField(rng.normal(size=(quality_rules.WIDTH, 2)), rng.normal(size=(2, 2)))
    lengths = [1, 4, 3, 1, 6]
    features, row = rng.random((sum(lengths), quality_rules.WIDTH)), np.repeat(np.arange(5), lengths)
    got = field.viterbi(features, row)
    for r in range(5):
        score = (features @ field.weights)[row == r]
        value = lambda path, score=score: sum(score[i, y] for i, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))
        assert tuple(got[row == r]) == max(product((0, 1), repeat=lengths[r]), key=value)


def test_field_slopes_are_those_of_the_likelihood():
    from itertools import product

    rng = np.random.default_rng(4)
    features = [rng.random((n, quality_rules.WIDTH)) for n in (1, 3, 2, 4)]
    chains = quality_rules._Chains(features)
    weights, moves, y = rng.normal(size=(quality_rules.WIDTH, 2)), rng.normal(size=(2, 2)), rng.integers(0, 2, 10)
    value, *slopes = chains.value_and_slopes(weights, moves, y)
    # by listing all labellings
    want = 0.0
    for c in range(4):
        rows = np.flatnonzero(chains.chain == c)
        score = chains.x[rows] @ weights
        total = lambda path, score=score: sum(score[i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
        want += total(y[rows]) - np.log(sum(np.exp(total(p)) for p in product((0, 1), repeat=len(rows))))
    assert np.isclose(value, want)
    for i, param in enumerate((weights, moves)):
        for at in np.ndindex(param.shape):
            moved = [weights.copy(), moves.copy()]
            moved[i][at] += 1e-6
            assert np.isclose((chains.value_and_slopes(*moved, y)[0] - value) / 1e-6, slopes[i][at], atol=1e-4)


def test_lines_of_one_document_may_differ(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_rules.fit_rules(docs, labels)
    judged = quality_rules.judge_rules(docs, field)
    assert judged.where("content_share > 0 and content_share < 1").count() > 0
    held = judged.where(fold(F.col("doc_id")) == 0).join(labels, "doc_id").where("quality is not null and not base_failed").toPandas()
    assert (held["kept"] == (held["quality"] == 1)).mean() > 0.85
    assert held["kept"][held["quality"] == 1].mean() > 0.95
    junk = "\n".join(["$$ ## || <> &&"] * 12)
    good = docs.join(labels.where("quality = 1"), "doc_id").where("n_chars > 2000 and lang = 'en'").orderBy("doc_id").first()["text"]
    both = quality_rules.judge_rules(spark.createDataFrame([(1, good + "\n" + junk)], SCHEMA), field).first()
    assert 0 < both["content_share"] < 1


def test_field_learns():
    rng = np.random.default_rng(0)
    make = lambda y, n: (np.clip(rng.normal(0.3 + 0.4 * y, 0.1, (n, quality_rules.WIDTH)), 0, 1), y)
    field = quality_rules.fit_field([make(i % 2, int(rng.integers(1, 9))) for i in range(200)])
    right = [field.viterbi(x, np.zeros(len(x))).mean().round() == y for x, y in (make(i % 2, 5) for i in range(100))]
    assert np.mean(right) > 0.95


# ------------------------------------------------------------ classifiers


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert scores.count() == docs.count()
    assert scores.where((F.col("held_out") != (fold(F.col("doc_id")) == 0)) | (F.col("predicted") != (F.col("score") >= 0.3).cast("int"))).count() == 0
    held = scores.where("held_out").join(labels, "doc_id").where("quality is not null").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_slopes_are_those_of_the_losses():
    rng = np.random.default_rng(6)
    row, feature, value = np.repeat(np.arange(30), 3), rng.integers(0, 7, 90), rng.random(90)
    grade, w, g = rng.integers(0, 4, 30), rng.normal(size=7), rng.normal(size=3)
    loss, *slopes = toxicity.loss_and_slopes((row, feature, value), grade, w, g, 0.1)
    dense = np.zeros((30, 7))
    np.add.at(dense, (row, feature), value)
    steps = [g[0], g[0] + np.exp(g[1]), g[0] + np.exp(g[1]) + np.exp(g[2])]
    above = [[1.0] + [1 / (1 + np.exp(t - s)) for t in steps] + [0.0] for s in dense @ w]
    assert np.isclose(loss, -np.mean([np.log(a[k] - a[k + 1]) for a, k in zip(above, grade, strict=True)]) + 0.05 * (w @ w))
    layers = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), np.array(0.3)]
    x, y = rng.normal(size=(20, 5)), rng.random(20)
    whole, back = quality.loss_and_slopes(layers, x, y, 0.1)
    naive = [np.tanh([sum(a * b for a, b in zip(r, layers[0][:, j], strict=True)) + layers[1][j] for j in range(3)]) @ layers[2] + 0.3 for r in x]
    naive = np.mean([np.log1p(np.exp(z)) - t * z for z, t in zip(naive, y, strict=True)]) + 0.05 * ((layers[0] ** 2).sum() + (layers[2] ** 2).sum())
    assert np.isclose(whole, naive)
    for params, found, value_of, start in (([w, g], slopes, lambda p: toxicity.loss_and_slopes((row, feature, value), grade, *p, 0.1)[0], loss), (layers, back, lambda p: quality.loss_and_slopes(p, x, y, 0.1)[0], whole)):
        for i, param in enumerate(params):
            for at in np.ndindex(param.shape):
                moved = [p.copy() for p in params]
                moved[i][at] += 1e-6
                assert np.isclose((value_of(moved) - start) / 1e-6, np.asarray(found[i])[at], atol=1e-4)


def test_index_sums_equal_naive_ones(spark):
    texts = ["a b c, a", None, "", "b b", "x " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    sums, counts = quality.index_sums(docs)
    want, seen = np.zeros_like(sums), np.zeros_like(counts)
    for text in texts:
        data, at = tk.flat(pa.array([text], pa.string()))
        _, bucket = quality.tokens(data, at)
        for i, b in enumerate(bucket):
            seen[b] += 1
            for j in range(max(0, i - quality.REACH), min(len(bucket), i + quality.REACH + 1)):
                if i != j:
                    want[b, quality._PLACES[bucket[j]]] += quality._SIGNS[bucket[j]]
    assert np.allclose(sums, want) and (counts == seen).all()


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    assert (np.diff(model.steps) > 0).all()
    held = docs.where(fold(F.col("doc_id")) == 0)
    found = toxicity.score_toxicity(held, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("label is not null").toPandas()
    assert found["severity"].between(0, 3).all()
    assert found["toxic"][found["label"] == 0].mean() < 0.02 and found["toxic"][found["label"] == 1].mean() > 0.8
    assert found["severity"][found["label"] == 1].mean() > found["severity"][found["label"] == 0].mean() + 0.5


# ------------------------------------------------------------ decontamination


def brute_edits(item, words):
    column = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(column[j] + 1, new[-1] + 1, column[j - 1] + (x != y)))
        column = new
    return min(column)


def test_leaks_reach_the_recall(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 50)))) for i in range(30)] + [(90, "too short item"), (91, None)]
    rows, want = [], set()
    for d in range(300):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if d % 2:
            item, text = rng.choice(items[:30])
            piece = text.split()
            for _ in range(rng.randint(0, len(piece) // 5)):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [piece[at], rng.choice(vocabulary)]])
            at = rng.randint(0, len(words))
            words[at:at] = piece
        rows.append((d, " ".join(words).upper()))
        for item, text in items[:30]:
            if brute_edits(text.split(), words) <= int(0.2 * len(text.split()) + 1e-9):
                want.add((d, item))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want and len(got) >= 0.99 * len(want)
    texts, by_item = dict(rows), dict(items)
    for r in found:
        part = texts[r["doc_id"]].lower().split()[r["first_word"] : r["first_word"] + r["n_words"]]
        assert brute_edits(by_item[r["item_id"]].split(), part) == r["edits"]
    blocks = decontaminate.find_leaks(docs, bench, block=7)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got
    kept = {r["doc_id"] for r in decontaminate.drop_leaking(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


@pytest.mark.parametrize(("n", "max_edits"), [(5, 0.2), (6, 0.34), (9, 0.34)])
def test_spoilt_grams_open_windows(n, max_edits):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(n)]
    items = decontaminate.Benchmark([7], [" ".join(words)], max_edits)
    k = int(max_edits * n + 1e-9)
    hit = 0
    for _ in range(50):
        piece = list(words)
        for e in range(k):  # edits spread over the item spoil the most grams
            piece[(e + 1) * n // (k + 1)] = f"x{rng.randrange(10**6)}"
        text = " ".join(["before"] * rng.randint(0, 9) + piece + ["after"] * rng.randint(0, 9)).encode()
        data = np.frombuffer(text, dtype=np.uint8)
        view = tk.Words(tk.LOWER[data], np.array([0, len(data)]), tk.ALNUM)
        assert items.windows(view, view.hashes(tk.PrefixHash(tk.LOWER[data])))
        hit += len(items.search(data, np.array([0, len(data)])))
    assert hit >= 49


@pytest.mark.parametrize("n", [5, 6, 8, 10, 14, 20, 35, 50])
def test_recall_by_length(n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(500)]
    hit, trials = 0, 200
    for _ in range(trials):
        words = rng.choices(vocabulary, k=n)
        items = decontaminate.Benchmark([7], [" ".join(words)])
        piece = list(words)
        for e in range(int(0.2 * n)):  # as many edits as may be, spread over the item
            at = min(len(piece) - 1, int((e + rng.random()) * n / int(0.2 * n)))
            piece[at : at + 1] = rng.choice([[], ["new"], [piece[at], "new"]])
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)) + piece + rng.choices(vocabulary, k=rng.randint(0, 40))).encode()
        hit += len(items.search(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])))
    assert hit >= 0.95 * trials


def test_candidates_come_from_keys():
    text = b"before one two three four five six seven after"
    items = decontaminate.Benchmark(["x"], ["one two three four five six seven"])
    data, at = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    assert [h[2:] for h in items.search(data, at)] == [(1, 7, 0)]
    items.keys = {n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for n in items.keys}
    assert items.search(data, at) == []


def test_short_items_are_found_exactly(spark):
    bench = spark.createDataFrame([(1.5, "Two words"), (2.5, "one"), (3.5, "of four words here"), (4.5, " ,;")], "item_id double, text string")
    docs = spark.createDataFrame([(1, "just two, words."), (2, "two other words"), (3, "One"), (4, "of four words here"), (5, "of four word here")], SCHEMA)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 1.5), (3, 2.5), (4, 3.5)]


def test_edge_rows(spark):
    docs = edge_rows(spark)
    n = len(EDGES)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c a b c a b")], "item_id long, text string")
    assert licenses.scan_licenses(docs).count() == n
    assert quality.score_quality(docs, quality.fit_quality(docs, labels)).where("score between 0 and 1").count() == n
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == n
    assert quality_rules.judge_rules(docs, quality_rules.fit_rules(docs, labels)).count() == n
    assert packing.pack_documents(docs).where("piece = 0").count() == n
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()] == [6]
    assert decontaminate.drop_leaking(docs, bench).columns == docs.columns
    none, no_labels = docs.limit(0), labels.limit(0)
    assert licenses.scan_licenses(none).count() == packing.pack_documents(none).count() == decontaminate.find_leaks(none, bench).count() == decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, no_labels)).collect()} == {0.5}
    assert {r["toxic"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, no_labels)).collect()} == {False}
    assert quality_rules.judge_rules(none, quality_rules.fit_rules(none, labels)).count() == quality.keep_quality(none, quality.fit_quality(none, labels)).count() == 0


# ------------------------------------------------------------ selection of words and thresholds


def test_words_are_selected_as_by_hand(spark):
    rng = random.Random(12)
    vocabulary = [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(300):
        toxic = i % 4 == 0
        words = rng.choices(vocabulary, k=rng.randint(0, 12)) + (["bad"] * rng.randint(0, 3) if toxic else []) + (["nice"] if not toxic and rng.random() < 0.8 else [])
        rng.shuffle(words)
        rows.append((" ".join(words), float(toxic)))
    sample = spark.createDataFrame(rows, "text string, target double").repartition(4)
    n_yes, n_no = sum(t for _, t in rows), sum(1 - t for _, t in rows)
    want, own = {}, set()
    for word in {w for text, _ in rows for w in text.split()}:
        yes, no = sum(t for text, t in rows if word in text.split()), sum(1 - t for text, t in rows if word in text.split())
        if yes + no < 3:
            continue
        a, b = yes + 0.5, no + 0.5
        z = (np.log(a / (n_yes + 1 - a)) - np.log(b / (n_no + 1 - b))) / np.sqrt(1 / a + 1 / (n_yes + 1 - a) + 1 / b + 1 / (n_no + 1 - b))
        if abs(z) >= 3:
            want[word] = z
        if no == 0 and z >= 3 and yes >= max(3, 0.02 * n_yes):
            own.add(word)
    hashed = {}
    for word in want:
        data = np.frombuffer(word.encode(), np.uint8)
        hashed[word] = toxicity._words(data, np.array([0, len(data)]))[1][0]
    chosen, only = toxicity._select(sample, int(n_yes), int(n_no), 50)
    assert {"bad", "nice"} <= set(want) and "bad" in own
    assert chosen.tolist() == sorted(hashed.values()) and only.tolist() == sorted(hashed[w] for w in own)
    strongest = sorted(want, key=lambda w: -abs(want[w]))[:1]
    assert toxicity._select(sample, int(n_yes), int(n_no), 1)[0].tolist() == [hashed[w] for w in strongest]


@pytest.mark.parametrize("seed", range(3))
def test_threshold_is_the_middle_of_the_best(seed):
    draw = np.random.default_rng(seed)
    toxic = draw.random(200) < 0.3
    probability = np.clip(draw.normal(0.3 + 0.4 * toxic, 0.15), 0, 1)
    worth = {}
    for k in range(91):
        t = 0.05 + 0.01 * k
        caught = sum(1 for p, y in zip(probability, toxic, strict=True) if y and p >= t - 1e-12) / toxic.sum()
        false = sum(1 for p, y in zip(probability, toxic, strict=True) if not y and p >= t - 1e-12) / (~toxic).sum()
        worth[t] = caught - 5 * false
    best = [t for t, w in worth.items() if w >= max(worth.values()) - 1e-9]
    assert abs(toxicity.choose_least(probability, toxic) - best[len(best) // 2]) < 1e-9
    assert toxicity.choose_least(probability, np.zeros(200, bool)) == toxicity.choose_least(probability, np.ones(200, bool)) == 0.5
