"""Removal of every byte that lies in a repeated string of ``length`` bytes, exactly.

Which strings repeat is decided for all places at once without listing them. Each window of
``length`` bytes names as its anchor the place of its smallest ``GRAM``-byte hash (the leftmost
one); equal windows have equal anchors at equal offsets. An anchor serves a stretch of windows and
its context, the bytes of all of them, so a text gives one small row in some 170 bytes.

1. Anchors with equal contexts form a class. Where a class has two members, all its windows repeat.
2. Classes whose anchors share the hash but not the context are compared. Their suffixes from the
   anchor, and the reversed prefixes before it, are sorted by a mergesort whose comparisons take
   polynomial prefix hashes and a binary search for the common extension; neighbours' extensions are
   verified against the bytes. A window at offset o repeats if another class agrees with it on
   ``length - o`` bytes to the right and o to the left, read off the two sorted orders.
3. Groups of more than ``hot_classes`` such classes (one passage in very many surroundings) are not
   sorted in one task: their windows are counted by 128-bit digest, which Spark combines and spreads.

Only anchors, contexts of compared classes and spans are shuffled; a document's spans meet at the
document. A null text is an empty one; a repeated row repeats all of its windows; repeated ids with
other texts are documents of their own. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.session import checkpointed, sized

GRAM = 64
#: Rows of 8 bytes that may be broadcast.
HASHES = 2_000_000
#: Contexts sorted together, in bytes, once whole groups are gathered.
CHUNK = 2 << 20


def window_anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first window, last window, anchor hash), windows by their first byte, never across rows."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    starts = np.arange(len(data) - gram + 1)
    hashes = tk.mix(tk.PrefixHash(data).of(starts, starts + gram))
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    least = (hashes >> bits << bits) | starts.astype(np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n], least[width - size : width - size + n])
    place = (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(row[:n] == row[length - 1 :])
    if not len(inside):
        return none, none, none, np.zeros(0, np.uint64)
    begin, count = tk.runs(place[inside], row[inside])
    first = inside[begin]
    return place[first], first, first + count - 1, hashes[place[first]]


def _pieces(data: np.ndarray, at: np.ndarray, length: int):
    """A slab, or a longer text in parts that overlap so that each window lies in one part."""
    if len(data) <= 2 * tk.SLAB or len(at) > 2:
        yield 0, data, at
        return
    for i in range(0, len(data), tk.SLAB):
        part = data[i : i + tk.SLAB + length - 1]
        yield i, part, np.array([0, len(part)])


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2) of the row, place, offsets of the last and first window, hash h, class (c1, c2)."""
    schema = "k1 long, k2 long, place long, near int, far int, h long, c1 long, c2 long"

    def run(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch):
                keys = [rows.column(i).to_numpy() for i in (0, 1)]
                for shift, part, bounds in _pieces(data, at, length):
                    place, first, last, h = window_anchors(part, bounds, length)
                    if not len(place):
                        continue
                    near, far = place - last, place - first
                    view, row = memoryview(np.ascontiguousarray(part)), np.searchsorted(bounds, place, side="right") - 1
                    seeds = (h ^ (near.astype(np.uint64) * tk.BASE + far.astype(np.uint64))).tolist()
                    digest = b"".join([xxhash.xxh3_128_digest(view[a:b], s) for a, b, s in zip(first.tolist(), (last + length).tolist(), seeds, strict=True)])
                    c = np.frombuffer(digest, dtype="<i8").reshape(-1, 2)
                    local = place - bounds[row] + shift
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[0][row], keys[1][row], local, near.astype(np.int32), far.astype(np.int32), h.view(np.int64), np.ascontiguousarray(c[:, 0]), np.ascontiguousarray(c[:, 1]))], names=["k1", "k2", "place", "near", "far", "h", "c1", "c2"])

    return docs.select("k1", "k2", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- suffix sort


class Suffixes:
    """Suffixes data[start:end] compared by prefix hashes and binary search."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.size = data, starts, ends - starts
        self.prefix = tk.PrefixHash(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes i and j."""
        a, b = self.starts[i], self.starts[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix.of(a, a + mid) == self.prefix.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        over = (n == self.size[i]) | (n == self.size[j])
        top = len(self.data) - 1
        x, y = self.data[np.minimum(self.starts[i] + n, top)], self.data[np.minimum(self.starts[j] + n, top)]
        shorter = np.where(or_equal, self.size[i] <= self.size[j], self.size[i] < self.size[j])
        return np.where(over, shorter, x < y)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common extension with the one before) by group, then suffix; ``group`` is ascending, -1 at a group's first.

        A bottom-up mergesort of all groups together: an element's place in the merged run is its
        own index plus its binary-searched place in the neighbour run.
        """
        begin, count = tk.runs(group)
        base, total = np.repeat(begin, count), np.repeat(count, count)
        order = np.arange(len(group))
        level = 0
        while len(count) and (1 << level) < count.max():
            at = np.flatnonzero(total > (1 << level))
            q = at - base[at]
            run = q >> level
            low = base[at] + ((run ^ 1) << level)
            stop = np.minimum(low + (1 << level), base[at] + total[at])
            low = np.minimum(low, stop)
            first, left = low.copy(), (run & 1) == 0
            while (low < stop).any():
                open_ = np.flatnonzero(low < stop)
                mid = (low[open_] + stop[open_]) >> 1
                before = self.less(order[mid], order[at[open_]], ~left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                stop[open_] = np.where(before, stop[open_], mid)
            merged = base[at] + (run >> 1 << (level + 1)) + (q - (run << level)) + (low - first)
            new = order.copy()
            new[merged] = order[at]
            order, level = new, level + 1
        shared = np.full(len(order), -1, np.int64)
        inner = np.setdiff1d(np.arange(len(order)), begin)
        shared[inner] = self.verified(order[inner - 1], order[inner])
        return order, shared

    def verified(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extensions, held against the bytes; where a hash collided the bytes decide."""
        n = self.common(i, j)
        if not n.sum():
            return n
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = self.data[np.repeat(self.starts[i], n) + within] != self.data[np.repeat(self.starts[j], n) + within]
        for k in np.unique(np.repeat(np.arange(len(n)), n)[differ]):
            a, b = (self.data[self.starts[x[k]] :][: n[k]] for x in (i, j))
            n[k] = int(np.argmax(a != b))
        return n


def repeated_offsets(contexts: list[bytes], group: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context, the ranges of offsets whose window another context of its group holds at the same offset.

    A context holds the windows of offsets near..far; its anchor is ``far`` bytes in. ``group`` is ascending.
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    begin = ends - np.array([len(c) for c in contexts])
    anchor, n = begin + far, len(contexts)
    right = Suffixes(data, anchor, ends)
    left = Suffixes(data[::-1].copy(), len(data) - anchor, len(data) - begin)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]

    start, count = tk.runs(group)
    two = start[count == 2]
    if len(two):
        low = np.maximum(length - right.verified(two, two + 1), np.maximum(near[two], near[two + 1]))
        high = np.minimum(left.verified(two, two + 1), np.minimum(far[two], far[two + 1]))
        for k, a, b in zip(two[low <= high], low[low <= high], high[low <= high], strict=True):
            out[k].append((int(a), int(b)))
            out[k + 1].append((int(a), int(b)))
    more = np.flatnonzero(np.repeat(count, count) > 2)
    if len(more):
        sub = [np.zeros(0)] * 4
        for side, suffixes in enumerate((right, left)):
            part = Suffixes.__new__(Suffixes)
            part.data, part.prefix, part.starts, part.size = suffixes.data, suffixes.prefix, suffixes.starts[more], suffixes.size[more]
            sub[2 * side], sub[2 * side + 1] = part.sort(group[more])
        r_order, r_same, l_order, l_same = sub
        m = len(more)
        hit = np.zeros((length - GRAM + 2, m), dtype=bool)
        r_class, l_class = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for o in range(int(near[more].min()), int(far[more].max()) + 1):
            active = np.flatnonzero((near[more] <= o) & (o <= far[more]))
            if len(active) < 2:
                continue
            r_class[r_order] = np.cumsum(r_same < length - o)
            l_class[l_order] = np.cumsum(l_same < o)
            pair = r_class[active] * (m + 1) + l_class[active]
            by = np.argsort(pair, kind="stable")
            equal = pair[by][1:] == pair[by][:-1]
            hit[o, active[by[1:][equal]]] = True
            hit[o, active[by[:-1][equal]]] = True
        for k in range(m):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[:, k].astype(np.int8), [0]])))
            out[more[k]] += [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def _compare(batches, length: int):
    """Contexts sorted by h: whole groups, some at a time, through ``repeated_offsets``."""

    def done(rows: list[tuple]):
        h = np.array([r[0] for r in rows])
        group = np.cumsum(np.append(0, h[1:] != h[:-1]))
        found = repeated_offsets([r[5] for r in rows], group, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), length)
        flat = [(r[1], r[2], a, b) for r, spans in zip(rows, found, strict=True) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["c1", "c2", "low", "high"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if size >= CHUNK and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield done(held)


# ---------------------------------------------------------------- crowded groups

#: Offsets that share one digest, of the bytes that all their windows share.
BLOCK = 32


def _digests(batches, length: int, block: int):
    """(c1, c2, low, high, digest) of the common bytes of the windows at offsets low..high of each context."""
    names, kinds = ["c1", "c2", "low", "high", "w1", "w2"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row in batch.to_pylist():
            far, context = row["far"], row["context"]
            ranges = [(r["low"], r["high"]) for r in row["ranges"]] if "ranges" in row else [(row["near"], far)]
            for low, high in ranges:
                for a in range(low // block * block, high + 1, block):
                    b = a + block - 1
                    w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(context[far - a : far - b + length], a), dtype="<i8")
                    for values, v in zip(out, (row["c1"], row["c2"], max(a, low), min(b, high), int(w1), int(w2)), strict=True):
                        values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)


def _shared(digests: DataFrame) -> DataFrame:
    """The rows whose digest another context has too; the digests come as a plain table, so that a hot one can be split."""
    twice = checkpointed(digests.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return digests.join(sized(twice), ["w1", "w2"], "left_semi").select("c1", "c2", "low", "high")


# ---------------------------------------------------------------- the operator


def repeated_spans(docs: DataFrame, length: int = 400, hot_classes: int = 20_000) -> DataFrame:
    """(k1, k2, spans): for each row of ``docs`` (k1, k2, text, ...) with repeats, the byte spans its repeated windows cover."""
    every = _anchors(docs, length)
    repeated = checkpointed(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    # computed twice, so that those of unique text are never stored; where the hashes are too many to be
    # broadcast, both sides are plain shuffles, of which Spark splits a hot hash
    anchors = checkpointed(every.join(sized(repeated, HASHES), "h"))
    classes = anchors.groupBy("c1", "c2").agg(F.min("h").alias("h"), F.count("*").alias("n"), F.min("near").alias("near"), F.min("far").alias("far"), F.min(F.struct("k1", "k2", "place")).alias("rep"))
    classes = checkpointed(classes)
    groups = checkpointed(classes.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1"))
    classes = checkpointed(classes.join(sized(groups), "h", "left").withColumn("classes", F.coalesce("classes", F.lit(1))))
    whole = classes.where("classes = 1 or n > 1").select("c1", "c2", F.col("near").alias("low"), F.col("far").alias("high"))

    wanted = (
        classes.where("classes > 1")
        .groupBy(F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))
        .agg(F.collect_list(F.struct("h", "c1", "c2", "near", "far", F.col("rep.place").alias("place"), "classes")).alias("wanted"))
    )

    def contexts(batches):
        names = ["h", "c1", "c2", "near", "far", "context", "classes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        for batch in batches:
            out = []
            for text, wants in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "wanted")), strict=True):
                raw = text.encode()
                out += [(w["h"], w["c1"], w["c2"], w["near"], w["far"], raw[w["place"] - w["far"] : w["place"] - w["near"] + length], w["classes"]) for w in wants]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(7)], names=names)

    # A repeated row gives its contexts twice, which marks no more than n > 1 has marked.
    found = docs.join(wanted, ["k1", "k2"]).mapInArrow(contexts, "h long, c1 long, c2 long, near int, far int, context binary, classes long")
    cold = (
        found.where(F.col("classes") <= hot_classes)
        .drop("classes")
        .repartition("h")
        .sortWithinPartitions("h")
        .mapInArrow(lambda batches: _compare(batches, length), "c1 long, c2 long, low int, high int")
    )
    parts = whole.unionByName(cold)
    if not classes.where(F.col("classes") > hot_classes).isEmpty():
        hot = checkpointed(found.where(F.col("classes") > hot_classes).select("c1", "c2", "near", "far", "context"))
        cores = hot.mapInArrow(lambda batches: _digests(batches, length, BLOCK), "c1 long, c2 long, low int, high int, w1 long, w2 long")
        ranges = _shared(cores).groupBy("c1", "c2").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))  # at most length / BLOCK
        single = hot.join(ranges, ["c1", "c2"]).mapInArrow(lambda batches: _digests(batches, length, 1), "c1 long, c2 long, low int, high int, w1 long, w2 long")
        parts = parts.unionByName(_shared(single))
    spans = anchors.join(parts, ["c1", "c2"]).select("k1", "k2", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("stop"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot_classes: int = 20_000, with_kept: bool = False) -> DataFrame:
    """One row per document: byte counts, maximal removed runs, SHA-256 of the kept bytes; with ``with_kept`` also both themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id").alias("k2"))
    spans = repeated_spans(rows, length, hot_classes)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")}
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "spans"))
            for raw, found in zip(*(c.to_pylist() for c in columns), strict=True):
                raw = raw.encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["stop"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for span in merged for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for k, v in zip(out, (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in merged]), strict=True):
                    out[k].append(v)
            arrays = [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")] + [pa.array(out["kept_sha256"], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                arrays += [pa.array(out["kept"], pa.binary()), pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *arrays], names=names)

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, removed array<struct<start:long,stop:long>>" if with_kept else "")
    return rows.join(spans, ["k1", "k2"], "left").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document's bytes after removal of its repeated 400-byte strings."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
