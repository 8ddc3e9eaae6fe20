"""Exact Jaccard self-join of word n-gram sets by prefix trees, and the components of its links.

1. Rows with equal sets are one class; only classes go on, so copies cost nothing.
2. Candidates by prefix filter: under one global order of n-grams, two sets that reach the threshold
   share an n-gram among their first ``size - need + 1``. The order puts n-grams of crowded hash
   buckets last (a table of fixed size, counted over all documents) and is by hash within a level,
   so common passages fall out of the prefixes. Any order gives the same links.
3. Two classes that share a prefix n-gram are candidates if their sizes and their sketches allow the
   needed overlap. A sketch counts a set's n-grams in ``PARTS`` parts of the hash range; the sum of
   the smaller counts bounds the overlap from above, so no link is lost. Candidates are not listed:
   each n-gram's classes, in blocks of bounded size, give edges that span their candidate graph;
   n-grams of exactly the same classes give the same graph, so one of them is taken. The components
   of those edges are clusters; a cluster's sets meet once, again in blocks.
4. In a block the sets, in the cluster's order, rarest first, stand in a trie. A set walks it level by
   level: partial overlaps are shared by all sets below a node, and a subtree is left as soon as what
   remains of it, or of the walker, cannot reach the needed overlap. Sets already connected are not
   walked for again: only links that join components are kept, which is all that components need.

N-gram hashes have 64 bits, set digests 128. Null texts and texts without words have the empty set
and are linked with nothing; shorter texts are one n-gram. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.textkit import runs
from plumbline.llm.graph import connected_components
from plumbline.session import checkpointed, scratch, sized, stored

#: Buckets of the rarity table, over the lowest quarter of the hash range, where prefixes lie.
BUCKETS, LOWEST = 1 << 20, 62
#: Sets of a cluster that meet in one task.
BLOCK = 1024
#: Rows of 28 bytes of cluster members that may be broadcast; beyond it texts are shuffled to meet them.
SMALL = 1_000_000
#: Tokens of a trie level.
STEP = 32
#: Parts of a sketch, classes of one n-gram that meet in one task, and rows taken together.
PARTS, CROWD, ROWS = 512, 4096, 1 << 15
#: N-grams of a cluster that meet in one block, whatever its sets.
GRAMS = 1 << 19


def _bucket(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.flatnonzero(hashes < np.uint64(1 << LOWEST))
    return low, (hashes[low] >> np.uint64(LOWEST - BUCKETS.bit_length() + 1)).astype(np.int64)


def rarity_levels(docs: DataFrame, n: int, block: int = 4096) -> np.ndarray:
    """uint8 level of each bucket: 0 where it holds about the mean, else a binary logarithm of its crowd.

    Each task sends its bucket counts in blocks; Spark adds them up. The driver gets one byte a bucket.
    """

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, data, at in tk.slabs(batch):
                total += np.bincount(_bucket(tk.shingle_sets(data, at, n)[1])[1], minlength=BUCKETS)
        parts = [(i, p) for i, p in enumerate(total.reshape(-1, block)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([np.minimum(p, 2**32 - 1).astype("<u4").tobytes() for _, p in parts], pa.binary())], names=["block", "values"])

    found = tk.add_up(docs.select("text").mapInArrow(count, "block int, values binary"), "<u4", "<i8").collect()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in found:
        counts[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["values"], "<i8")
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / (3 * counts.mean() + 24))) + 1).astype(np.uint8)


def _sets(docs: DataFrame, n: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """(id, key, n_shingles, d1, d2, prefix, sketch): a row's set digest, the n-grams of its prefix, its sketch."""
    kind = docs.schema["id"].dataType.simpleString()
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch):
                row, grams = tk.shingle_sets(data, at, n)
                sizes = np.bincount(row, minlength=rows.num_rows)
                level = np.zeros(len(grams), dtype=np.uint8)
                low, bucket = _bucket(grams)
                level[low] = table.value[bucket]
                order = np.lexsort((grams, level, row))
                first = np.cumsum(sizes) - sizes
                keep = np.where(sizes > 0, sizes - -(-sizes * num // den) + 1, 0)
                taken = order[(np.arange(len(grams)) - first[row]) < keep[row]]
                view = memoryview(grams.tobytes())
                digests = b"".join([xxhash.xxh3_128_digest(view[8 * a : 8 * (a + k)]) for a, k in zip(first.tolist(), sizes.tolist(), strict=True)])
                d = np.frombuffer(digests, "<i8").reshape(-1, 2)
                prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep)).astype(np.int32)), pa.array(grams[taken].view(np.int64)))
                part = np.bincount(row * PARTS + (grams & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS * rows.num_rows)
                sketch = pa.array([x.tobytes() for x in np.minimum(part, 255).astype(np.uint8).reshape(-1, PARTS)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sizes), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), prefix, sketch], names=["id", "key", "n_shingles", "d1", "d2", "prefix", "sketch"])

    return docs.mapInArrow(run, f"id {kind}, key struct<k1:long,k2:long>, n_shingles long, d1 long, d2 long, prefix array<long>, sketch binary")


def candidate_edges(group: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that span the candidate graph of rows sorted by group and size: same group, sizes and sketches near enough.

    Row i is held against row i + d for d = 1, 2, ... all rows at once; a pair already connected is
    passed over, and a group all of whose rows are connected is left.
    """
    names, at = np.unique(node, return_inverse=True)
    union, out = _Union(len(names)), []
    label = at.copy()
    begin, count = runs(group)
    own = np.repeat(np.arange(len(begin)), count)
    full = sketch.max(axis=1) == 255 if len(sketch) else np.zeros(0, dtype=bool)  # counts beyond a byte bound nothing
    left = np.flatnonzero(np.arange(len(group)) - begin[own] < count[own] - 1)
    d = 1
    while len(left):
        left = left[left + d < len(group)]
        left = left[(own[left] == own[left + d]) & (size[left] * den >= size[left + d] * num)]
        fresh = left[label[left] != label[left + d]]
        for k in range(0, len(fresh), ROWS):
            i = fresh[k : k + ROWS]
            most = np.minimum(sketch[i], sketch[i + d]).sum(axis=1, dtype=np.int64)
            for x in i[full[i] | full[i + d] | ((num + den) * most >= num * (size[i] + size[i + d]))]:
                a, b = union.root(int(at[x])), union.root(int(at[x + d]))
                if a != b:
                    union.up[max(a, b)] = min(a, b)
                    out.append((int(node[x]), int(node[x + d])))
        if len(fresh):
            label = union.roots()[at]
        if d & (d - 1) == 0 and len(left):
            whole = np.minimum.reduceat(label, begin) == np.maximum.reduceat(label, begin)
            left = left[~whole[own[left]]]
        d += 1
    return out


def telling_tokens(held: DataFrame, num: int, den: int) -> DataFrame:
    """(token, n) of ``held`` (token, node, size): one n-gram of those that the same classes hold, and none of two classes whose sizes are too far apart.

    Equal groups of classes have the same candidates, so nothing is lost; groups are told apart by 128 bits.
    """
    groups = held.groupBy("token").agg(F.count("*").alias("n"), F.min("size").alias("small"), F.max("size").alias("large"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)))
    groups = groups.where((F.col("n") > 2) | (F.col("small") * den >= F.col("large") * num))
    return groups.groupBy("n", "x1", "x2").agg(F.min("token").alias("token")).select("token", "n")


def _whole_groups(batches, keys: int, least: int) -> Iterator[list[pa.RecordBatch]]:
    """Parts of sorted batches that hold whole groups (equal first ``keys`` columns) and ``least`` rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and sum(b.num_rows for b in held) >= least:
            last = [held[-1].column(k)[-1].as_py() for k in range(keys)]
            same = np.ones(batch.num_rows, dtype=bool)
            for k in range(keys):
                same &= batch.column(k).to_numpy(zero_copy_only=False) == last[k]
            cut = batch.num_rows if same.all() else int(np.argmin(same))
            held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield held
                held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield held


def _edges(batches, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, i, j, size, node, sketch) sorted by all but the last two: candidate edges."""
    for held in _whole_groups(batches, 3, ROWS):
        table = pa.Table.from_batches(held).combine_chunks()
        token, i, j, size, node = (table.column(c).to_numpy() for c in range(5))
        group = np.cumsum(np.append(0, (np.diff(token) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
        sketch = tk.flat(table.column(5))[0].reshape(-1, PARTS)
        found = candidate_edges(group, node, size, sketch, num, den)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
        tk.give_back()


# ---------------------------------------------------------------- trie join


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


class SetTrie:
    """Sets as ascending rank arrays in a trie of ``STEP`` ranks a level."""

    def __init__(self, sets: list[np.ndarray], vocabulary: int):
        self.by = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        ordered = [sets[i] for i in self.by]
        self.size = np.array([len(s) for s in ordered])
        same = np.zeros(len(ordered), np.int64)
        for i in range(1, len(ordered)):
            m = min(self.size[i - 1], self.size[i])
            differ = ordered[i - 1][:m] != ordered[i][:m]
            same[i] = np.argmax(differ) if differ.any() else m
        self.levels = []
        parent = np.zeros(len(ordered), np.int64)
        for k in range(-(-int(self.size.max()) // STEP)):
            there = np.flatnonzero(self.size > k * STEP)
            new = same[there] < (k + 1) * STEP
            # a set that ended above stands between two others only where their shared part is shorter
            new[0] = True
            node = np.cumsum(new) - 1
            first = there[new]
            ranks = np.full((len(first), STEP), vocabulary, dtype=np.int64)
            for r, i in enumerate(first):
                part = ordered[i][k * STEP : (k + 1) * STEP]
                ranks[r, : len(part)] = part
            count = len(first)
            small, large = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)
            np.minimum.at(small, node, self.size[there])
            np.maximum.at(large, node, self.size[there])
            last = np.where(ranks < vocabulary, ranks, -1).max(axis=1)
            ended = np.flatnonzero(self.size[there] <= (k + 1) * STEP)
            self.levels.append({"ranks": ranks, "parent": parent[first], "small": small, "large": large, "last": last, "end_node": node[ended], "end_set": there[ended]})
            parent = np.zeros(len(ordered), np.int64)
            parent[there] = node
        self.mask = np.zeros(vocabulary + 1, dtype=bool)

    def walk(self, own: np.ndarray, num: int, den: int) -> np.ndarray:
        """Indices of the sets whose Jaccard similarity with ``own`` is at least num / den."""
        self.mask[own] = True
        size, found = len(own), []
        overlap = np.zeros(1, np.int64)
        for k, level in enumerate(self.levels):
            alive = np.arange(len(level["parent"])) if k == 0 else np.flatnonzero(overlap[level["parent"]] >= 0)
            if not len(alive):
                break
            here = self.mask[level["ranks"][alive]].sum(axis=1)
            here += 0 if k == 0 else overlap[level["parent"][alive]]
            reached = np.full(len(level["parent"]), -1, np.int64)
            reached[alive] = here
            ends = reached[level["end_node"]]
            sets = level["end_set"]
            found.append(sets[(ends >= 0) & ((num + den) * ends >= num * (size + self.size[sets]))])
            rest = np.minimum(level["large"][alive] - (k + 1) * STEP, size - np.searchsorted(own, level["last"][alive], side="right"))
            dead = (num + den) * (here + np.maximum(rest, 0)) < num * (size + level["small"][alive])
            reached[alive[dead]] = -1
            overlap = reached
        self.mask[own] = False
        hits = np.concatenate(found) if found else np.zeros(0, np.int64)
        return np.array([self.by[i] for i in hits], dtype=np.int64)


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links (index, index) that span the components of the sets in ``left`` and ``right`` (None: within ``left``).

    Indices of ``right`` follow those of ``left``.
    """
    every = left + (right or [])
    union, out = _Union(len(every)), []
    if not left or right == [] or len(every) < 2:
        return out
    grams, ranks, df = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    order = np.argsort(df, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    cut = np.cumsum([len(s) for s in every])[:-1]
    ranked = [np.sort(r) for r in np.split(rank[ranks], cut)]
    trie = SetTrie(ranked[: len(left)], len(grams))
    for i in range(0 if right is None else len(left), len(every)):
        hits = trie.walk(ranked[i], num, den)
        for j in hits[union.roots()[hits] != union.root(i)] if len(hits) else ():
            a, b = union.root(i), union.root(int(j))
            if a != b:
                union.up[max(a, b)] = min(a, b)
                out.append((int(j), i))
    return out


def _join_blocks(batches, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, node, mine, grams) sorted by (cluster, i, j): links of each block pair.

    Sets are read where Arrow holds them; only those of a block pair that goes on in the next batch are copied.
    """

    def done(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        once = list({(node, mine): (node, mine, s) for node, mine, s in rows}.values())
        _, i, j = key
        left, right = ([r for r in once if r[1] == side] for side in ((i, j) if i != j else (i, -1)))
        links = block_links([r[2] for r in left], [r[2] for r in right] if i != j else None, num, den)
        nodes = [r[0] for r in left + right]
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], names=["a", "b"])

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
        raw, at = tk.flat(batch.column(5))
        begin, count = runs(*columns[:3])
        for b, n in zip(begin.tolist(), count.tolist(), strict=True):
            this = tuple(int(c[b]) for c in columns[:3])
            if key is not None and this != key:
                yield done(key, held)
                held = []
            key = this
            held += [(int(columns[3][r]), int(columns[4][r]), raw[at[r] : at[r + 1]].view("<u8")) for r in range(b, b + n)]
        held = [(node, mine, s.copy()) for node, mine, s in held]
        del raw, at
        tk.give_back()
    if held:
        yield done(key, held)


def _read_sets(batches, n: int):
    for batch in batches:
        for rows, data, at in tk.slabs(batch):
            row, grams = tk.shingle_sets(data, at, n)
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            raw = grams.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array([raw[8 * a : 8 * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["node", "cluster", "split", "grams"])


def _block_pairs(rows: DataFrame, split: str) -> DataFrame:
    """Each row in every pair (i, j) of blocks, i <= j, that its own block ``mine`` of ``split`` is in."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col(split)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(split) - 1)))
    return rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))


def _keys(id_: Column, text: Column) -> list[Column]:
    """Two hashes that stand for a row's id and text."""
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(text, id_, F.lit(29)).alias("k2")]


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 9, den: int = 10, block: int = BLOCK, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(id, n_shingles, component_id, first_of_component) per row; ``keep`` stores tables that the result reads.

    Rows link when the Jaccard similarity of their ``n``-gram sets is at least num / den; the
    component is the smallest id reachable. ``first_of_component`` marks one row of each component,
    the one with the smallest id (and hash, where rows repeat an id).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.struct(*_keys(F.col("id"), F.col("text"))).alias("key"), "text")
    sets = keep(_sets(rows, n, num, den, rarity_levels(rows, n)))
    classes = (
        sets.where("n_shingles > 0")
        .groupBy("d1", "d2")
        .agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = keep(classes)
    tokens = classes.select("node", "size", F.explode("prefix").alias("token"))
    held = keep(tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "token"))
    crowds = telling_tokens(held, num, den)
    split = F.ceil(F.col("n") / CROWD).cast("int")
    shared = held.join(crowds, "token").join(classes.select("node", "sketch"), "node").select("token", split.alias("split"), "size", "node", "sketch")
    shared = _block_pairs(shared, "split").select("token", "i", "j", "size", "node", "sketch")
    edges = shared.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size", "node").mapInArrow(lambda b: _edges(b, num, den), "a long, b long")
    clusters = checkpointed(connected_components(edges).select("node", F.col("component").alias("cluster")))
    inside = clusters.join(classes.select("node", "key", "size"), "node")
    sizes = inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / GRAMS)).cast("int").alias("split"))
    wanted = checkpointed(inside.join(sizes, "cluster").select("key", "node", "cluster", "split"))
    members = rows.join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted.hint("shuffle_hash"), "key").select("node", "cluster", "split", "text").mapInArrow(lambda b: _read_sets(b, n), "node long, cluster long, split int, grams binary")
    pairs = _block_pairs(members, "split").select("cluster", "i", "j", "node", "mine", "grams")
    links = pairs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lambda b: _join_blocks(b, num, den), "a long, b long")
    found = connected_components(checkpointed(links))
    nodes = classes.select("d1", "d2", "least", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select("d1", "d2", "component", "component_id")
    out = sets.drop("prefix", "sketch").join(nodes, ["d1", "d2"], "left")
    single = F.col("component").isNull()
    first = out.where(~single).groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    out = out.join(first, "component", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(single, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (single | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")))).alias("first_of_component"),
        "key",
    )
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are first of their component.

    Of rows that repeat id and text one stays, the one whose other columns come first as text. Texts
    without words are linked with nothing and all stay.
    """
    with scratch(docs.sparkSession) as keep:
        found = ngram_components(docs, id_col, text_col, n, num, den, keep=keep).where("n_shingles > 0").groupBy("key").agg(F.count("*").alias("n"), F.max("first_of_component").alias("first"))
        found = checkpointed(found.where("n > 1 or not first"))
    lost = checkpointed(found.where("not first").select("key"))
    twice = checkpointed(found.where("n > 1 and first").select("key"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    text, id_ = (F.col(own[docs.columns.index(c)]) for c in (text_col, id_col))
    keyed = docs.toDF(*own).withColumn("key", F.struct(*_keys(id_, F.coalesce(text.cast("string"), F.lit("")))))
    kept = keyed.join(sized(lost), "key", "left_anti")
    if not twice.isEmpty():
        order = F.row_number().over(Window.partitionBy("key").orderBy(F.to_json(F.struct(*own))))
        again = kept.join(sized(twice), "key", "left_semi").withColumn("rank", order).where("rank = 1").drop("rank")
        kept = kept.join(sized(twice), "key", "left_anti").unionByName(again)
    return kept.select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document's set size and component."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
