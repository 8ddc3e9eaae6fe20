"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Spark tokenizes, counts how many pieces have each length and ranks the pieces of a length; what is
planned on the driver is only that histogram, at most ``capacity`` counts whatever the corpus
holds. The plan is by exact complements: for each length, longest first, the index of single, pair
and triple sums gives combinations that fill its gap to the token, each consumed as often as the
counts allow, up to the point from which best fit places the rest in fewest sequences. Every pattern takes a range of ranks of each of its
lengths, so a piece finds its sequence and offset from its length and rank alone.

A hot length is ranked in parts, as many as its pieces ask for, whose counts are added up before, so
no task holds it.

A null text is an empty one: its only token is the end mark. Each row is packed, repeated ids and
repeated rows too; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.textkit import give_back
from plumbline.session import checkpointed

CAPACITY = 1024
END_ID = 2
#: Words kept encoded by a task; beyond it the memory is emptied and fills again.
CACHE_WORDS = 100_000

#: Fixed pattern: how the byte-level vocabulary splits text, with letters as all of \\w but digits and _.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters for which Python's classes and the vocabulary's may differ (numbers that are no digits, some controls, rare scripts).
_UNSURE = re.compile("[\x1c-\x1f²³¹¼-¾֐-῿⁰-₟⅐-↏①-⓿✀-➿Ⰰ-\U0010ffff]")


class _Words(dict):
    """Word to id bytes, encoded when first asked for."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        ids = self.merge(word)
        self[word] = out = pack_ids(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Token ids of whole texts; a word is encoded once and remembered as bytes.

    The vocabulary file lists tokens in the order they were merged, so the rank-merging encoder
    over the same vocabulary gives a word the ids that the file's own tokenizer gives it, faster.
    Texts with characters on which the two ways of splitting might differ, or with the text of a special
    token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        byte_of = {c: i for i, c in enumerate(_byte_letters(pre_tokenizers.ByteLevel.alphabet()))}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.merge)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if _UNSURE.search(text) or self.special.search(text):
            return self.whole(text)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))


def _byte_letters(alphabet: list[str]) -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    own = {c for c in alphabet if ord(c) < 256}
    rest = iter(sorted(c for c in alphabet if ord(c) >= 256))
    return [chr(i) if chr(i) in own else next(rest) for i in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids and ``end_id``, cut into full pieces behind a shorter first one."""
    path = tokenizer_path or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                bounds = [0, *range(first, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["crc"].append(zlib.crc32(part))
                    out["ids"].append(part if with_ids else None)
            columns = [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc"))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            del columns, out
            give_back()

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _complement(gap: int, length: int, left: np.ndarray) -> list[int] | None:
    """Lengths in stock that fill ``gap`` exactly beside ``length``: one, else two, else three.

    Of the sums of two and three the most even is taken: short lengths fit anywhere, and best fit needs
    them later.
    """

    def enough(combo: list[int]) -> bool:
        return all(left[x] >= k for x, k in Counter([length, *combo]).items())

    def pair(rest: int, least: int, before: list[int]) -> list[int] | None:
        low = np.arange(rest // 2, least - 1, -1)
        for x in low[(left[low] > 0) & (left[rest - low] > 0)].tolist():
            if enough([*before, x, rest - x]):
                return [*before, x, rest - x]
        return None

    if gap == 0:
        return []
    if left[gap] and enough([gap]):
        return [gap]
    found = pair(gap, 1, [])
    for a in range(gap // 3, 0, -1):
        if found is not None:
            break
        found = pair(gap - a, a, [a]) if left[a] else None
    return found


def complements(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that fill a sequence exactly, how many such sequences), longest lengths first, as far as the counts go."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    for length in sorted(counts, reverse=True):
        while left[length]:
            combo = _complement(capacity - length, length, left)
            if combo is None:
                break
            use = Counter([length, *combo])
            n = min(int(left[x]) // k for x, k in use.items())
            for x, k in use.items():
                left[x] -= n * k
            patterns.append((tuple(use.elements()), n))
    return patterns


#: Stopping points tried at each of two rounds.
TRIED = 16


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up all ``counts``.

    Exact complements waste nothing, but taken to the end they leave a stock whose lengths no longer fit
    each other. So they are taken in order up to some point, and the rest is placed best-fit; of the
    points tried (evenly spread, then around the best) that of fewest sequences is kept, the latest of several.
    """
    counts = {k: v for k, v in counts.items() if v}
    exact = complements(counts, capacity)
    plans: dict[int, tuple[int, list]] = {}

    def try_at(points) -> int:
        for at in points:
            if at not in plans:
                rest = Counter(counts)
                for slots, n in exact[:at]:
                    for x in slots:
                        rest[x] -= n
                plan = exact[:at] + best_fit({k: v for k, v in rest.items() if v}, capacity)
                plans[at] = (sum(n for _, n in plan), plan)
        return min(plans, key=lambda at: (plans[at][0], -at))

    step = max(1, len(exact) // TRIED)
    best = try_at({*range(0, len(exact) + 1, step), len(exact)})
    best = try_at(range(max(0, best - step), min(len(exact), best + step) + 1, max(1, 2 * step // TRIED)))
    return plans[best][1]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Plan of ``counts`` by decreasing length, each into the smallest gap that holds it."""
    left = counts
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # gap -> open sequences
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        for gap in sorted(g for g in bins if g >= length):
            while n and bins[gap]:
                slots, m = bins[gap].pop()
                k = min(gap // length, n)
                t = min(m, n // k)
                if m > t:
                    bins[gap].append((slots, m - t))
                bins.setdefault(gap - k * length, []).append((slots + (length,) * k, t))
                n -= k * t
        if n:
            k = capacity // length
            if n >= k:
                bins.setdefault(capacity - k * length, []).append(((length,) * k, n // k))
            if n % k:
                bins.setdefault(capacity - n % k * length, []).append(((length,) * (n % k), 1))
    return [x for open_ in bins.values() for x in open_]


def _ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset) of each slot of each pattern."""
    used: Counter = Counter()
    out, base = [], 0
    for slots, n in patterns:
        offset = 0
        for length in slots:
            out.append((length, used[length], used[length] + n, base, offset))
            used[length] += n
            offset += length
        base += n
    return out


def pack(pieces: DataFrame, id_col: str = "id", capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; they are read twice, so pass a stored table.

    The pieces of a length are ranked in ``salts`` parts: by default as many as hold a million pieces each, 64 at least.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    salts = salts or max(64, max(counts.values(), default=0) >> 20)
    plan = _ranges(plan_patterns(counts, capacity))
    ranges = spark.createDataFrame(plan, "length long, lo long, hi long, base long, offset long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(parts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # One row per slot of a pattern: bounded by the capacity, not by the corpus.
    p, r = ranked.alias("p"), F.broadcast(ranges).alias("r")
    hit = (F.col("p.length") == F.col("r.length")) & (F.col("p.rank") >= F.col("r.lo")) & (F.col("p.rank") < F.col("r.hi"))
    return p.join(r, hit).select(*(F.col(f"p.{c}") for c in pieces.columns), (F.col("r.base") + F.col("p.rank") - F.col("r.lo")).alias("sequence_id"), F.col("r.offset").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each piece of each document with its place: ``sequence_id`` and gapless ``offset``."""
    pieces = checkpointed(tokenize_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id, with_ids))
    return pack(pieces, "id", capacity).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every piece of every document, packed."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
