"""Benchmark decontamination: documents that hold a benchmark item up to a few edited words.

Items and texts are words of letters and digits, lower-cased A-Z. A document leaks an item of n
words where some stretch of it is within ``floor(max_edits * n)`` word edits of the item.

1. Windows. For each size that items have, every place of a document starts a window of it. A window
   that lacks runs of g words cannot hold an item of its size: k edits spoil at most g * k of an item's
   n - g + 1 runs, so fewer than n - g + 1 - g * k runs that items of its size have, within n + k words,
   rule the place out. This looks at pairs and triples of all items of a size at once and names no item.
2. CGK embedding. A walk repeats the word it stands on at each step and moves on by a coin that the
   word, the step and the walk decide; after a word that only one side has, two walks meet again
   soon, so few edits become few differing places (edit distance becomes Hamming distance).
3. Bit sampling. A key is made of ``sampled`` places of a walk. A window and an item of its size that
   have a key of one of ``repeats`` walks in common are a candidate; there are no other candidates.
   ``repeats`` and ``sampled`` are set for a recall of 0.95 and more at the largest distance allowed,
   for items of every length.
4. Candidates are verified by exact edit distance; the closest place of each item in each row counts.

Items too short for an edit have keys of their whole sequence, so they are found exactly.

The items of a block (``block`` at most) are sent to the tasks; a larger benchmark goes in blocks,
each against all documents. Documents are read once a block and never shuffled, so hot sources and
groups of copies cost what other rows cost.

Null and empty texts leak nothing; items without words are not searched for. Repeated documents and
repeated items each give their rows; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import textkit as tk
from plumbline.session import checkpointed

#: Lengths of the runs that windows are looked through for.
RUNS = (2, 3)


class Benchmark:
    """The items of a block: their word hashes, the runs of words they have, and the keys of their embeddings."""

    def __init__(self, ids: list, texts: list[str], max_edits: float = 0.2, min_words: int = 1, repeats: int = 40, sampled: int = 2):
        self.repeats, self.sampled = repeats, sampled
        self.ids, self.words = [], []
        runs: dict[int, list] = {g: [] for g in RUNS}
        for item, text in zip(ids, texts, strict=True):
            data = tk.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
            words = tk.Words(data, np.array([0, len(data)]), tk.ALNUM)
            if len(words.starts) < max(1, min_words):
                continue
            hashes = words.hashes(tk.PrefixHash(data))
            for g in RUNS:
                runs[g].append(words.grams(hashes, g)[0])
            self.ids.append(item)
            self.words.append(hashes)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.edits = np.floor(max_edits * self.size + 1e-9).astype(np.int64)
        draw = np.random.default_rng(11)
        self.walks = draw.integers(1, 1 << 62, repeats, dtype=np.uint64)
        self.share = np.sort(draw.random((repeats, sampled)), axis=1)
        self.sizes = np.unique(self.size)
        # for each hash of a run the sizes of the items that have it, as bits (sizes share bits beyond 64 of them)
        self.shift = np.uint64(64 - min(24, max(16, int(self.size.sum()).bit_length() + 5)))
        self.bit = {n: np.uint64(i % 64) for i, n in enumerate(self.sizes.tolist())}
        self.runs = {g: np.zeros(1 << (64 - int(self.shift)), dtype=np.uint64) for g in RUNS}
        for g, parts in runs.items():
            for n, part in zip(self.size.tolist(), parts, strict=True):
                self.runs[g][self._slot(part)] |= np.uint64(1) << self.bit[n]
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.sizes.tolist():
            items = np.flatnonzero(self.size == n)
            joined = np.concatenate([self.words[i] for i in items])
            starts = np.arange(len(items)) * n
            keys = self._keys(joined, starts, starts + n, [n])[n]
            order = np.argsort(keys.ravel(), kind="stable")
            self.keys[n] = keys.ravel()[order], items[order // repeats]

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return (runs >> self.shift).astype(np.int64)

    def places(self, n: int) -> np.ndarray:
        """(repeats, sampled) steps at which walks over ``n`` words are sampled; walks end early, so the last steps are not."""
        return (self.share * 1.5 * n).astype(np.int64)

    def _keys(self, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
        """For each size, the (windows, repeats) keys of the windows of so many words at ``starts``, which end at ``stops`` at the latest.

        The walks from a place are the same for every size; a walk beyond its window stands on nothing.
        """
        out = {n: np.zeros((len(starts), self.repeats), dtype=np.uint64) for n in sizes}
        wanted: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n in sizes:
            if self._whole(n):
                total = np.zeros(len(starts), dtype=np.uint64)
                for k in range(n):
                    total = total * tk.BASE + hashes[np.minimum(starts + k, len(hashes) - 1)]
                out[n][:] = tk.mix(total)[:, None]
                continue
            places = self.places(n)
            for step in np.unique(places).tolist():
                for s in range(self.sampled):
                    r = np.flatnonzero(places[:, s] == step)
                    if len(r):
                        wanted.setdefault(step, []).append((n, r))
        if wanted and len(starts):
            coins = tk.mix(hashes[:, None] ^ self.walks[None, :])
            at = np.repeat(starts[:, None], self.repeats, axis=1)
            walk = np.arange(self.repeats)[None, :]
            end = stops[:, None] - 1
            for step in range(max(wanted) + 1):
                for n, r in wanted.get(step, ()):
                    p = at[:, r]
                    word = np.where(p < np.minimum(stops, starts + n)[:, None], hashes[np.minimum(p, len(hashes) - 1)], np.uint64(0))
                    out[n][:, r] = out[n][:, r] * tk.BASE + word
                here = np.minimum(at, end)
                at = at + ((coins[here, walk] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
            for n in sizes:
                if not self._whole(n):
                    out[n] = tk.mix(out[n] ^ tk.mix(self.walks)[None, :])
        return out

    def _whole(self, n: int) -> bool:
        return not self.edits[self.size == n][0]

    def windows(self, words: tk.Words, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """For each size, the places (word indices) where a window of it holds enough of the items' runs."""
        count = len(hashes)
        marks, before = {}, {}  # the sizes that a run at a word speaks for; runs of any size that begin before a word
        for g, table in self.runs.items():
            grams, _, at = words.grams(hashes, g)
            marks[g] = np.zeros(count, dtype=np.uint64)
            marks[g][at] = table[self._slot(grams)]
            before[g] = np.zeros(count + 1 + 2 * int(self.sizes[-1]), dtype=np.int32)
            np.cumsum(marks[g] != 0, out=before[g][1 : count + 1])
            before[g][count + 1 :] = before[g][count]
        last = words.first[1:][words.row]
        out = {}
        for n in self.sizes.tolist():
            k = int(self.edits[self.size == n][0])
            need = {g: n - g + 1 - g * k for g in reversed(RUNS) if n - g + 1 - g * k > 0}
            found = np.arange(count)
            for i, (g, least) in enumerate(need.items()):  # runs of any size, into the next rows too
                width = n + k - g + 1
                if i == 0:
                    found = np.flatnonzero(before[g][width : width + count] - before[g][:count] >= least)
                else:
                    found = found[before[g][found + width] - before[g][found] >= least]
            for g, least in need.items():  # runs of this size, within the row
                if len(found):
                    total = np.concatenate([[0], np.cumsum((marks[g] >> self.bit[n]) & np.uint64(1), dtype=np.int32)])
                    found = found[total[np.minimum(found + n + k - g + 1, last[found])] - total[found] >= least]
            if k == 0:
                found = found[found + n <= last[found]]
            if len(found):
                out[n] = found
        return out

    def candidates(self, words: tk.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the windows and items that have a key in common, each once."""
        found = self.windows(words, hashes)
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if found:
            starts = np.unique(np.concatenate(list(found.values())))
            # walks of many places are taken in parts of bounded size
            for part in np.array_split(starts, -(-len(starts) // 4096)):
                sizes = {n: s for n, x in found.items() if len(s := np.intersect1d(x, part, assume_unique=True))}
                if not sizes:
                    continue
                low = int(part[0])
                high = min(len(hashes), int(part[-1]) + 2 * int(self.sizes[-1]) + 2)
                every = self._keys(hashes[low:high], part - low, np.minimum(words.first[1:][words.row[part]], high) - low, list(sizes))
                for n, own in sizes.items():
                    known, item = self.keys[n]
                    keys = every[n][np.searchsorted(part, own)].ravel()
                    a, b = (np.searchsorted(known, keys, side=s) for s in ("left", "right"))
                    hit = np.flatnonzero(b > a)
                    count = (b - a)[hit]
                    index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a[hit], count)
                    places.append(own[np.repeat(hit, count) // self.repeats])
                    items.append(item[index])
        place, item = np.concatenate(places), np.concatenate(items)
        both = np.unique(np.stack([item, place]), axis=1) if len(place) else np.zeros((2, 0), np.int64)
        return both[1], both[0]

    def distance(self, item: int, part: np.ndarray) -> tuple[int, int]:
        """(edits, words of ``part`` up to the end) of the stretch of ``part`` closest to the item."""
        return _closest(self.words[item], part, np.zeros(len(part) + 1, dtype=np.int64))

    def distance_back(self, item: int, part: np.ndarray) -> tuple[int, int]:
        """As ``distance`` from the end of ``part`` backwards: where the stretch that ends there begins."""
        return _closest(self.words[item][::-1], part[::-1], np.arange(len(part) + 1))

    def search(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, edits) of each leak: the closest place of each item in each row."""
        if not self.ids:
            return []
        data = tk.LOWER[data]
        words = tk.Words(data, at, tk.ALNUM)
        hashes = words.hashes(tk.PrefixHash(data))
        place, item = self.candidates(words, hashes)
        if not len(place):
            return []
        row = words.row[place]
        # places of an item within its edits of each other are one region
        near = np.zeros(len(place), dtype=bool)
        near[1:] = (item[1:] == item[:-1]) & (row[1:] == row[:-1]) & (place[1:] - place[:-1] <= np.maximum(1, self.edits[item[1:]]))
        begin = np.flatnonzero(~near)
        end = np.append(begin[1:], len(place)) - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            r, x = int(row[a]), int(item[a])
            n, k = int(self.size[x]), int(self.edits[x])
            first, last = int(words.first[r]), int(words.first[r + 1])
            low, high = max(first, int(place[a]) - k), min(last, int(place[b]) + n + k)
            edits, stop = self.distance(x, hashes[low:high])
            if edits <= k and (edits, low) < best.get((r, x), (k + 1, 0))[:2]:
                _, length = self.distance_back(x, hashes[low : low + stop])
                best[r, x] = (edits, low + stop - length - first, length)
        return [(r, x, start, length, edits) for (r, x), (edits, start, length) in sorted(best.items())]


def _closest(item: np.ndarray, part: np.ndarray, column: np.ndarray) -> tuple[int, int]:
    """(least edits, words of ``part`` used) against the item, from a first column of edit distances."""
    step = np.arange(len(part) + 1)
    for i, word in enumerate(item):
        best = np.minimum(column + 1, np.concatenate([[i + 1], column[:-1] + (part != word)]))
        column = np.minimum.accumulate(best - step) + step
    end = int(np.argmin(column))
    return int(column[end]), end


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int, **settings):
    """Benchmarks of at most about ``block`` items each; repeated items are dealt like others."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    parts = -(-items.count() // block)
    if parts > 1:
        items = checkpointed(items.withColumn("place", F.monotonically_increasing_id()))  # so that each row stays where it is dealt
    for part in range(parts):
        rows = (items.where(F.pmod(F.xxhash64("place"), F.lit(parts)) == part) if parts > 1 else items).collect()
        yield Benchmark([r["item"] for r in rows], [r["text"] for r in rows], **settings)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = 20_000, max_edits: float = 0.2, min_words: int = 1) -> DataFrame:
    """(id, item, first_word, n_words, edits, similarity): each item that a document holds, at its closest place."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"id {kind}, item {item_kind.simpleString()}, first_word long, n_words long, edits int, similarity double"
    item_type = to_arrow_type(item_kind)
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, block, max_edits=max_edits, min_words=min_words):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                for part, data, at in tk.slabs(batch):
                    hits = items.search(data, at)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": part.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                            "item": pa.array([items.ids[h[1]] for h in hits], item_type),
                            "first_word": pa.array([h[2] for h in hits], pa.int64()),
                            "n_words": pa.array([h[3] for h in hits], pa.int64()),
                            "edits": pa.array([h[4] for h in hits], pa.int32()),
                            "similarity": pa.array([1 - h[4] / int(items.size[h[1]]) for h in hits], pa.float64()),
                        }
                    )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = 20_000, max_edits: float = 0.2, min_words: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item."""
    kept = docs
    for items in _blocks(benchmark, item_col, item_text_col, block, max_edits=max_edits, min_words=min_words):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for batch in batches:
                for part, data, at in tk.slabs(batch, text_col):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[h[0] for h in sent.value.search(data, at)]] = False
                    yield part.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every benchmark item that a document holds."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
