"""Column functions: all built-in expressions, so they stay in generated code and push down with their columns.

Arrays may be ``array<float>`` or ``array<double>``; mathematics is in double unless said otherwise.
A null argument gives null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import counter

CLIP = 1e-12
GENESIS = "0" * 64


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    """Sum of an array of doubles, in order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda an outer expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ------------------------------------------------------------ probabilities


def clip_probs(p: Column) -> Column:
    """Probabilities held within [1e-12, 1]."""
    return F.transform(doubles(p), lambda x: F.least(F.greatest(x, F.lit(CLIP)), F.lit(1.0)))


def entropy_bits(p: Column) -> Column:
    """Shannon entropy in bits of clipped probabilities."""
    return -total(F.transform(clip_probs(p), lambda x: x * F.log2(x)))


def entropy_nats(p: Column) -> Column:
    """Shannon entropy in nats of clipped probabilities."""
    return -total(F.transform(clip_probs(p), lambda x: x * F.ln(x)))


def entropy_calib(p: Column) -> Column:
    """Entropy in nats with the small constant inside the logarithm, as calibration uses it."""
    return -total(F.transform(doubles(p), lambda x: x * F.ln(x + F.lit(CLIP))))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats, never below 0."""
    term = lambda x, y: (x * F.ln(x / ((x + y) / 2)) + y * F.ln(y / ((x + y) / 2))) / 2
    return F.greatest(F.lit(0.0), total(F.zip_with(clip_probs(p), clip_probs(q), term)))


def softmax(logits: Column) -> Column:
    """Softmax shifted by the largest logit."""
    share = lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))
    shifted = lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return let(let(doubles(logits), shifted), share)


def argmax(p: Column) -> Column:
    """Index of the largest value, the lowest where several are."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


# ------------------------------------------------------------ pixels


def scale_pixels(pixels: Column) -> Column:
    """0..255 integers: values of at most 1 are multiplied by 255 in single precision, then clipped and cut."""
    factor = F.when(F.array_max(pixels) <= 1.0, F.lit(255.0)).otherwise(F.lit(1.0)).cast("float")
    low, high = F.lit(0.0).cast("float"), F.lit(255.0).cast("float")
    return let(factor, lambda f: F.transform(pixels.cast("array<float>"), lambda x: F.least(F.greatest((x * f).cast("float"), low), high).cast("int")))


def to_grayscale(pixels: Column, channels: Column, plane: Column) -> Column:
    """Mean over channels of a channel-first image with ``plane`` pixels a channel."""
    def gray(values):
        at = lambda c, i: F.element_at(values, (c * plane + i + 1).cast("int"))
        each = lambda i: F.aggregate(F.sequence(F.lit(0), channels.cast("int") - 1), F.lit(0.0), lambda a, c: a + at(c, i)) / channels
        return F.transform(F.sequence(F.lit(0), plane.cast("int") - 1), each)

    return let(doubles(pixels), gray)


def blend(x: Column, overlay: Column, alpha: float = 0.5) -> Column:
    return F.zip_with(doubles(x), doubles(overlay), lambda a, b: a * alpha + b * (1 - alpha))


def brightness(x: Column, factor: float = 1.10) -> Column:
    return F.transform(doubles(x), lambda a: F.least(a * factor, F.lit(1.0)))


def translate(x: Column, width: int, shift: int = 1) -> Column:
    """Image moved right and down by ``shift`` pixels, zeros moving in."""
    def moved(values):
        inside = lambda i: (i % width >= shift) & (i >= shift * width)
        return F.transform(values, lambda _, i: F.when(inside(i), F.element_at(values, F.greatest(i - shift * width - shift + 1, F.lit(1)))).otherwise(0.0))

    return let(doubles(x), moved)


def blur_weights(sigma: float = 0.8, reach: int = 2) -> list[float]:
    """Weights of a Gaussian at whole distances, which add up to 1."""
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [w / sum(weights) for w in weights]


def blur(x: Column, width: int, sigma: float = 0.8, reach: int = 2) -> Column:
    """Separable Gaussian blur with edge pixels repeated."""
    weights = blur_weights(sigma, reach)

    def along(values: Column, step: int) -> Column:
        size = F.size(values)

        def at(i, k):
            column, row = i % width, F.floor(i / width).cast("int")
            if step == 1:
                return row * width + F.least(F.greatest(column + k, F.lit(0)), F.lit(width - 1))
            return F.least(F.greatest(row + k, F.lit(0)), F.floor(size / width).cast("int") - 1) * width + column

        return F.transform(values, lambda _, i: reduce(lambda a, b: a + b, (F.element_at(values, at(i, k) + 1) * w for k, w in zip(range(-reach, reach + 1), weights, strict=True))))

    return let(let(doubles(x), lambda v: along(v, 1)), lambda v: along(v, width))


def noise(x: Column, sigma: float, seed: Column) -> Column:
    """Normal noise by Box and Muller from counters of seed and position, clipped to [0, 1]."""

    def moved(v, i):
        normal = F.sqrt(-2 * F.ln(counter.unit(seed, i, seed=1))) * F.cos(2 * F.pi() * counter.unit(seed, i, seed=2))
        return F.least(F.greatest(v + normal * sigma, F.lit(0.0)), F.lit(1.0))

    return F.transform(doubles(x), moved)


def seed_from_hash(sha: Column) -> Column:
    """The number of the first eight hex digits."""
    return F.conv(F.substring(sha, 1, 8), 16, 10).cast("bigint")


def dhash(pixels: Column, width: int, height: int) -> Column:
    """Difference hash: row by row a bit for each pixel brighter than its right neighbour, highest bit first; up to 64 bits, the 64th being the sign."""
    places = [(r * width + c + 1) for r in range(height) for c in range(width - 1)]

    def bits(values):
        each = [F.when(F.element_at(values, i) > F.element_at(values, i + 1), F.lit(_signed(1 << (len(places) - 1 - k)))).otherwise(F.lit(0)).cast("bigint") for k, i in enumerate(places)]
        return reduce(lambda a, b: a.bitwiseOR(b), each)

    return let(doubles(pixels), bits)


def _signed(bits: int) -> int:
    """The signed 64-bit number of these bits."""
    return bits - (1 << 64) if bits >> 63 else bits


def hash_of_hex(text: Column) -> Column:
    """The signed 64-bit number that up to sixteen hex digits stand for."""
    return F.conv(text, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def resize_weights(source: int, target: int) -> list[list[float]]:
    """Bilinear (triangle) resampling weights with support scaled to the ratio when shrinking."""
    ratio = source / target
    support = max(1.0, ratio)
    out = []
    for t in range(target):
        centre = (t + 0.5) * ratio - 0.5
        row = [max(0.0, 1 - abs(s - centre) / support) for s in range(source)]
        out.append([w / sum(row) for w in row])
    return out


# ------------------------------------------------------------ roles, files, images

#: Dataset roles and the labels of their protocols.
ROLES = ("training_eval", "perturbation_overlay", "live_input_batch")
PROTOCOLS = {
    "training_eval": "Training / Evaluation Dataset Assurance",
    "perturbation_overlay": "Perturbation Overlay Assurance",
    "live_input_batch": "Live Input Batch Assurance",
}


def normalize_role(role: Column) -> Column:
    """An unknown or missing role counts as training_eval."""
    return F.when(role.isin(*ROLES), role).otherwise(ROLES[0])


def protocol_name(role: Column) -> Column:
    role = normalize_role(role)
    return reduce(lambda w, r: w.when(role == r, PROTOCOLS[r]), ROLES[1:], F.when(role == ROLES[0], PROTOCOLS[ROLES[0]]))


def has_extension(path: Column, extensions: tuple[str, ...], any_case: bool) -> Column:
    path = F.lower(path) if any_case else path
    return reduce(lambda a, b: a | b, (path.endswith(e) for e in extensions))


#: Leading bytes (hex) of formats, in the order they are tried.
MAGIC = (
    ("89504E470D0A1A0A", "PNG"),
    ("FFD8FF", "JPEG"),
    ("474946383761", "REJECTED_GIF"),
    ("474946383961", "REJECTED_GIF"),
    ("49492A00", "REJECTED_TIFF"),
    ("4D4D002A", "REJECTED_TIFF"),
    ("25504446", "REJECTED_PDF"),
    ("504B0304", "REJECTED_ARCHIVE"),
    ("1F8B", "REJECTED_ARCHIVE"),
    ("526172211A07", "REJECTED_ARCHIVE"),
    ("377ABCAF271C", "REJECTED_ARCHIVE"),
    ("4D5A", "REJECTED_EXECUTABLE"),
    ("7F454C46", "REJECTED_EXECUTABLE"),
)


def sniff_format(head_hex: Column) -> Column:
    """Format by the hex of the first 512 bytes: a known magic, WEBP in RIFF, an svg tag in any case, else UNKNOWN."""
    found = F.when(head_hex.startswith(MAGIC[0][0]), MAGIC[0][1])
    found = found.when(head_hex.startswith(MAGIC[1][0]), MAGIC[1][1]).when(head_hex.startswith("52494646") & (F.substring(head_hex, 17, 8) == "57454250"), "WEBP")
    for magic, name in MAGIC[2:]:
        found = found.when(head_hex.startswith(magic), name)
    # '<svg' with each letter in either case: 3C, 53 or 73, 56 or 76, 47 or 67, on byte boundaries
    return found.when(head_hex.rlike("^([0-9A-F]{2})*3C[57]3[57]6[46]7"), "REJECTED_SVG").otherwise("UNKNOWN")


def head_hex(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 512))


# ------------------------------------------------------------ scores


def anomaly_confidence(score: Column, threshold: float, low: Column, high: Column) -> Column:
    """Percentage shown beside an anomaly score: how far it lies from the threshold within the scores' span."""
    span_below = F.greatest(F.lit(threshold) - low, F.lit(0.01))
    span_above = F.greatest(high - F.lit(threshold), F.lit(0.01))
    below = F.least(F.lit(99.4), 70 + 29.4 * (F.lit(threshold) - score) / span_below)
    above = 100 - F.least(F.lit(99.8), 65 + 34.8 * (score - F.lit(threshold)) / span_above)
    return F.when(score < threshold, below).otherwise(above)


def sentinel_risk(suspicious: Column, flip: Column, js: Column) -> Column:
    return F.when(suspicious, F.round(F.least(F.lit(90.0), 50 + 40 * flip + 100 * js), 2)).otherwise(2.5)


def hash_pick(key: Column, k: Column, count: Column) -> Column:
    """A draw from 0..count-1 that depends on key and k alone and that other engines repeat."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), k.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % count


def canonical_json(fields: dict[str, Column], compact: bool = True) -> Column:
    """JSON of already encoded values with sorted keys; compact or with a space after ',' and ':'."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    parts = [F.concat(F.lit(f'"{name}"{colon}'), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))


def json_text(value: Column) -> Column:
    """A string as JSON (quotes and backslashes escaped), null as null."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def micros(ts: Column) -> Column:
    """Timestamp as whole microseconds: exact, and written alike by every engine."""
    return F.unix_micros(ts)
