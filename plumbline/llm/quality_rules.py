"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

A document's lines are a sequence of two labels. Each line has features in [0, 1] (its length, its
marks, digits, capitals, repeats, whether it ends a sentence, ...); the field has a weight for each
feature and label and one for each pair of neighbouring labels, fitted by gradient ascent on the
exact log likelihood (forward-backward) over a bounded sample of labelled documents. Only documents
are labelled, so the labels of their lines are latent: they are decoded and fitted in turn, the
document's label being evidence for each of its lines. Viterbi decoding labels the lines; a document is kept when the
content lines hold at least ``least`` of its words. Plain counts come beside it, and the base rule:
under ``min_words`` words, or over half of the words in 3-word windows found twice, is rejected.

Words are runs of other than space and \\t-\\r. One pass over whole texts without a shuffle; a row's
state is its own lines. Null and empty texts have no words and are rejected by the base rule. Without
labelled rows the field keeps every document. Repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.labelled import labelled_sample

#: Labelled rows that the field is fitted on, the most lines that one of them has, and the width of a line's features.
MOST_LABELLED, MOST_LINES, WIDTH = 4000, 500, 13
#: The features that hold a line's words (as ln(1 + words) / 6) and whether an equal line stands above it.
WORDS_OF, REPEATED = 1, 9
MIN_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _class(*bytes_: int) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(bytes_)] = 1
    return table


_HEAD = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)])
_DIGIT, _CAPITAL = _class(*range(48, 58)), _class(*range(65, 91))
_MARK = _class(*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))
_STOP = _class(*b".!?")


def _add(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring edges."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


class Lines:
    """Counts by row and features by line of a slab."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        words = tk.Words(data, at, tk.NOT_SPACE)
        prefix = tk.PrefixHash(data)
        hashes = words.hashes(prefix)
        inside = tk.NOT_SPACE[data]
        self.n_words = np.diff(words.first)
        self.word_chars = _add(_HEAD[data] * inside, at)
        self.n_symbols = _add(_SYMBOL[data], at)

        # words in 3-word windows found twice or more in the row
        grams, row, first = words.grams(hashes, 3)
        order = np.lexsort((grams, row))
        begin, count = tk.runs(row[order], grams[order])
        twice = first[order[np.repeat(count, count) > 1]]
        covered = np.zeros(len(hashes), dtype=bool)
        for k in range(3):
            covered[twice + k] = True
        self.n_repeat_words = _add(covered, words.first)

        # lines: row by row, cut at \n
        cuts = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([at[:-1], cuts + 1])) if n else np.zeros(0, np.int64)
        line_row = np.searchsorted(at, starts, side="right") - 1
        # a text that ends in \n, or is empty, has its last line at the next row's beginning
        own = np.sort(np.concatenate([np.arange(n), np.searchsorted(at, cuts, side="right") - 1])) if n else line_row
        self.line_row = own
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[cuts] = True
        last = np.zeros(len(starts), dtype=bool)
        last[:-1] = own[1:] != own[:-1]
        if len(last):
            last[-1] = True
        ends = np.where(last, at[1:][own], ends - 1) if len(starts) else ends
        starts = np.minimum(starts, ends)
        word_line = np.searchsorted(starts, words.starts, side="right") - 1
        # among lines that start at one byte only the last can hold words
        self.line_words = np.bincount(word_line, minlength=len(starts))[: len(starts)]
        line_hash = tk.mix(prefix.of(starts, ends) + (ends - starts).astype(np.uint64))
        order = np.lexsort((np.arange(len(starts)), line_hash, own))
        order = order[self.line_words[order] > 0]
        begin, _ = tk.runs(own[order], line_hash[order])
        repeat = np.ones(len(order), dtype=bool)
        repeat[begin] = False
        self.repeated = np.zeros(len(starts), dtype=bool)
        self.repeated[order[repeat]] = True
        self.n_dup_lines = np.bincount(own[self.repeated], minlength=n)

        total = lambda values: np.concatenate([[0], np.cumsum(values)])
        span = lambda values: (t := total(values))[ends] - t[starts]
        size = np.maximum(1, ends - starts)
        count = self.line_words
        again = np.bincount(word_line, weights=covered, minlength=len(starts))[: len(starts)]
        ender = _STOP[data[np.maximum(ends - 1, 0)]] if len(data) else np.zeros(len(starts), np.int64)
        chars = np.maximum(1, span(_HEAD[data]))
        many = np.maximum(1, count)
        self.features = np.stack(
            [
                np.ones(len(starts)),
                np.minimum(1, np.log1p(count) / 6),
                count == 0,
                span(_SYMBOL[data]) / chars,
                np.minimum(1, 5 * span(_SYMBOL[data]) / many),
                span(_MARK[data]) / chars,
                span(_DIGIT[data]) / chars,
                span(_CAPITAL[data]) / chars,
                ender * (ends > starts),
                self.repeated,
                again / many,
                np.minimum(1, size / many / 20),
                (count > 0) & (count < 4),
            ],
            axis=1,
        ).astype(float)


@dataclass
class LineField:
    """Label 1 is content: weights (WIDTH, 2) and transitions (2, 2), both as scores."""

    weights: np.ndarray
    moves: np.ndarray

    def viterbi(self, features: np.ndarray, row: np.ndarray, bias: np.ndarray | float = 0.0) -> np.ndarray:
        """The best label of each line, with ``bias`` log odds for content; rows are stepped through together."""
        score = features @ self.weights
        score[:, 1] += bias
        begin, count = tk.runs(row)
        label = np.zeros(len(row), dtype=np.int64)
        if not len(row):
            return label
        order = np.argsort(-count, kind="stable")
        begin, count = begin[order], count[order]
        best = np.zeros((len(count), 2))
        came = np.zeros((len(row), 2), dtype=np.int8)
        active = len(count)
        for t in range(int(count[0])):
            while count[active - 1] <= t:
                active -= 1
            here = begin[:active] + t
            if t:
                over = best[:active, :, None] + self.moves
                came[here] = over.argmax(axis=1)
                best[:active] = over.max(axis=1) + score[here]
            else:
                best[:active] = score[here]
        now = best.argmax(axis=1)
        for t in range(int(count[0]) - 1, -1, -1):
            active = int(np.searchsorted(-count, -t, side="left"))
            here = begin[:active] + t
            label[here] = now[:active]
            now[:active] = came[here, now[:active]]
        return label


class _Chains:
    """Sequences of lines laid end to end, the longest first, so that all of them are stepped through together."""

    def __init__(self, features: list[np.ndarray]):
        self.order = sorted(range(len(features)), key=lambda i: -len(features[i]))
        self.count = np.array([len(features[i]) for i in self.order], dtype=np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.x = np.concatenate([features[i] for i in self.order]).astype(float)
        self.active = [int(np.searchsorted(-self.count, -t, side="left")) for t in range(int(self.count[0]))]
        self.chain = np.repeat(np.arange(len(self.count)), self.count)

    def value_and_slopes(self, weights: np.ndarray, moves: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The log likelihood of the labels ``y`` and its slopes in weights and moves, by forward-backward."""
        x, begin, count = self.x, self.begin, self.count
        score = x @ weights
        forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t, n in enumerate(self.active):
            here = begin[:n] + t
            forward[here] = score[here] + (np.logaddexp.reduce(forward[here - 1][:, :, None] + moves, axis=1) if t else 0)
        whole = np.logaddexp.reduce(forward[begin + count - 1], axis=1)
        pairs = np.zeros((2, 2))
        for t in range(len(self.active) - 2, -1, -1):
            n = self.active[t + 1]
            here = begin[:n] + t
            ahead = moves + (score[here + 1] + backward[here + 1])[:, None, :]
            backward[here] = np.logaddexp.reduce(ahead, axis=2)
            pairs += np.exp(forward[here][:, :, None] + ahead - whole[:n, None, None]).sum(axis=0)
        share = np.exp(forward + backward - np.repeat(whole, count)[:, None])
        follows = np.flatnonzero(self.chain[1:] == self.chain[:-1])
        own_moves = np.zeros((2, 2))
        np.add.at(own_moves, (y[follows], y[follows + 1]), 1)
        own = np.stack([x[y == k].sum(axis=0) for k in (0, 1)], axis=1)
        value = score[np.arange(len(x)), y].sum() + (own_moves * moves).sum() - whole.sum()
        return float(value), own - x.T @ share, own_moves - pairs

    def fit(self, y: np.ndarray, rounds: int = 80, rate: float = 0.5, alone: bool = False) -> LineField:
        """Weights and moves by Adam on the log likelihood a line, with a small penalty on their squares; no moves if lines stand ``alone``."""
        params, m, v = [np.zeros((WIDTH, 2)), np.zeros((2, 2))], [0.0, 0.0], [0.0, 0.0]
        for r in range(1, rounds + 1):
            _, *slopes = self.value_and_slopes(*params, y)
            for i, s in enumerate(slopes[: 1 if alone else 2]):
                g = s / len(y) - 1e-3 * params[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] + rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.999**r)) + 1e-8)
        return LineField(*params)


def fit_field(sequences: list[tuple[np.ndarray, int]], passes: int = 2, trust: float = 1.0) -> LineField:
    """The field from (features, label of the document) sequences; the lines' own labels are latent.

    At first a document's label stands for its lines, but for lines repeated in a good document, which
    are boilerplate; lines are then fitted alone, for moves between equal labels would tie them. Each
    further pass decodes the lines anew under the field, with ``trust`` log odds for the document's
    label, and fits to what it finds: lines of one document may differ. A good document keeps at least
    half of its words as content and a bad one less than half (trust grows for documents where the
    decoding says otherwise).
    """
    sequences = [s for s in sequences if len(s[0])]
    if not sequences or len({y for _, y in sequences}) < 2:
        field = LineField(np.zeros((WIDTH, 2)), np.zeros((2, 2)))
        field.weights[0, 1] = 1.0
        return field
    chains = _Chains([x for x, _ in sequences])
    label = np.array([sequences[i][1] for i in chains.order], dtype=np.int64)
    own = label[chains.chain]
    y = np.where((own == 1) & (chains.x[:, REPEATED] > 0), 0, own)
    words = np.expm1(6 * chains.x[:, WORDS_OF])
    field = chains.fit(y, alone=True)
    for _ in range(passes - 1):
        extra = np.full(len(label), trust)
        for _ in range(4):
            bias = np.where(own == 1, 1, -1) * extra[chains.chain]
            y = field.viterbi(chains.x, chains.chain, bias)
            content = np.bincount(chains.chain, weights=words * y) - 0.5 * np.bincount(chains.chain, weights=words)
            wrong = np.where(label == 1, content < 0, content >= 0) & (np.bincount(chains.chain, weights=words) > 0)
            if not wrong.any():
                break
            extra[wrong] *= 3
        still = wrong[chains.chain]
        y[still] = own[still]
        field = chains.fit(y)
    return field


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED, most_lines: int = MOST_LINES) -> LineField:
    """The field from at most ``most_labelled`` labelled rows, those of at most ``most_lines`` lines."""

    def lines(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch):
                found = Lines(data, at)
                cut = np.searchsorted(found.line_row, np.arange(rows.num_rows + 1))
                parts = [found.features[a:b].astype("<f4").tobytes() if b - a <= most_lines else None for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(parts, pa.binary())], names=["target", "features"])

    sample = labelled_sample(docs, labels, label, id_col, text_col, most_labelled).select("text", "target")
    found = sample.mapInArrow(lines, "target double, features binary").where("features is not null").collect()
    found = sorted((int(r["target"] >= 0.5), bytes(r["features"])) for r in found)
    return fit_field([(np.frombuffer(f, "<f4").reshape(-1, WIDTH), y) for y, f in found])


def judge_rules(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, n_words, counts, base_failed, content_share, kept) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            for rows, data, at in tk.slabs(batch):
                found = Lines(data, at)
                label = sent.value.viterbi(found.features, found.line_row)
                content = np.bincount(found.line_row, weights=found.line_words * label, minlength=rows.num_rows)
                share = content / np.maximum(1, found.n_words)
                failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > MOST_REPEATED * found.n_words)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(found.n_words), *(pa.array(getattr(found, c).astype(np.int64)) for c in counts), pa.array(failed), pa.array(share), pa.array(~failed & (share >= least))],
                    names=["id", "n_words", *counts, "base_failed", "content_share", "kept"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"id {kind}, n_words long, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, content_share double, kept boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's counts and verdict."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge_rules(docs, fit_rules(docs, labels))
