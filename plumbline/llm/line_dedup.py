"""Line dedup: an exact set-similarity join of all lines, in built-in expressions only.

A line's tokens are its distinct ``WORDS``-word shingles, words being split by whitespace of any kind,
letter case kept; a line of fewer words has one token, all its words, so it matches lines of the same
words. Two lines match when the Jaccard similarity of their tokens is at least 0.8. A line is removed
when some line before it, in an earlier document (by id) or above it in its own, matches it; what is
judged is the input, so a removed line still removes those after it. Lines of fewer than ``least``
words and blank lines are left as they are.

1. Equal lines are one class, represented by its first place; only first lines are joined.
2. Under any one order of tokens, matching sets share one among their first ``size - need + 1``, and
   each token more that both must share is among one token more. Under the order by hash (that of the
   first word leads, so shingles outside the prefix are not hashed), the tokens of all prefixes are
   counted (counts combine before the shuffle); only lines that share ``COMMON`` go on, and are
   tokenized whole. Of tokens with the same holders the first one is enough, and one of two lines only
   must pass the filters of 4, by the bounds that are known of their sizes.
3. Rarity: tokens that more than ``CROWD`` first lines hold go behind all others, by the binary
   logarithm of that count, then by hash. A prefix without such tokens is the same under both
   orders; the others are taken anew.
4. Prefix tokens are joined with a length filter (sizes within the similarity), a positional filter
   (what is left behind the token must suffice) and a sketch: 256 bits, each the parity of the tokens
   that hash to it. Two sketches differ in no more bits than the sets differ in tokens, so the filter
   loses nothing and leaves few that do not match.
5. One match before a class settles it. Each class is held against the first and the most copied
   class of each of its prefix tokens, on all tokens where the filters let it pass. Classes that this
   leaves open and that share a token with further classes ask by semi-joins whether any earlier class
   matches, first by the filters alone, then on all tokens: an entry gives a row or none, so no pairs
   of a crowd are ever listed.
6. A class with a match before it loses all its lines, any other those behind its first.

Text is not shuffled while what it meets is small: small sides are broadcast behind a count of their
rows; beyond it the text is shuffled to them. Null texts are empty; rows repeated with id and text
are one document and are judged alike; a null id stands before all others. Columns of the documents
may have any names; a result column takes the place of one of its own name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exprs import let
from plumbline.session import checkpointed, scratch, sized

WORDS, CROWD = 5, 512
#: Tokens that a line must share with others to be tokenized whole, or all that it must share with a match if those are fewer.
COMMON = 3
#: Bits of a token that stand for the whole shingle; those above are of its first word's hash.
LOW = (1 << 48) - 1
#: Words of 64 bits in a sketch.
PARITY = 4
#: Whitespace of any kind, that of Unicode included, and any of it but the space.
SPACE, ODD_SPACE = r"[\h\v]+", r"[\h\v&&[^ ]]"
#: Anything but the ASCII and Latin-1 characters that are no odd space. Listed one by one they are a set of bits, in which Java looks up a character some times faster than in ``ODD_SPACE``.
UNUSUAL = "[^" + "".join(rf"\x{c:02X}" for c in (*range(0x20, 0x7F), *range(0xA1, 0x100))) + "]"
#: Rows of 16 bytes that may be broadcast.
SHARED = 4_000_000


def _need(size: Column) -> Column:
    """ceil(0.8 * size) in integers."""
    return F.floor((size * 4 + 4) / 5).cast("int")


def _prefix(size: Column) -> Column:
    return size - _need(size) + 1


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): null texts empty; the keys stand for id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", *_keys(F.col("id"), F.col("text")))


def _keys(id_: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(text, id_, F.lit(29)).alias("k2")]


def _words() -> Column:
    """Hashes of the words of ``line``.

    No filter stands on the words, as Spark would split every line for it once more.
    """
    odd = F.col("line").rlike(UNUSUAL) & F.col("line").rlike(ODD_SPACE)
    words = F.array_remove(F.when(odd, F.split("line", SPACE)).otherwise(F.split("line", " ")), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle(word: Column, i: Column, hashes: Column) -> Column:
    """The token at place ``i``, whose word is ``word``: tokens stand in the order of their first words' hashes, by the upper bits."""
    whole = F.xxhash64(word, *(F.get(hashes, i + k) for k in range(1, WORDS)))
    return word.bitwiseAND(~LOW).bitwiseOR(whole.bitwiseAND(LOW))


def _starts(hashes: Column, least: int = 1) -> Column:
    """How many tokens start in a line, repeated ones too: none if it has fewer than ``least`` words."""
    return F.when(F.size(hashes) < max(1, least), 0).otherwise(F.greatest(F.size(hashes) - (WORDS - 1), F.lit(1)))


def _tokenized(lines: DataFrame) -> DataFrame:
    """``lines`` with ``tokens`` for their text: words are hashed once, shingles from those."""

    def shingles(hashes: Column) -> Column:
        return F.slice(F.transform(hashes, lambda w, i: _shingle(w, i, hashes)), F.lit(1), _starts(hashes))

    return lines.withColumn("tokens", F.array_distinct(let(_words(), shingles))).drop("line")


def _place() -> Column:
    """Places in order: by id (null first), then text, then line."""
    return F.struct("id", "k1", "pos")


def _place_hash(place: str = "") -> Column:
    """A place as one number: what is broadcast of a class tells its first place from its others by this alone."""
    return F.xxhash64(*(f"{place}{c}" for c in ("id", "k1", "pos")))


def line_prefixes(rows: DataFrame, least: int) -> DataFrame:
    """(id, k1, k2, pos, h1, h2, size, low, prefix) of every line, ``prefix`` by hash, empty for lines of fewer than ``least`` words.

    ``size`` is at least the number of the line's tokens and ``low`` at most that, as shingles of
    different first words differ. As many first words as the prefix has tokens, the smallest by hash,
    start all that can be in it; only these shingles are hashed. The steps are projections of their
    own, as a lambda would compute again for each element what stands outside it.
    """
    own = ["id", "k1", "k2", "pos", "h1", "h2"]
    lines = rows.select("id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("id", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"), _words().alias("hashes"))
    size = _starts(F.col("hashes"), least)
    lines = lines.select(*own, "hashes", size.alias("size"), F.slice("hashes", F.lit(1), size).alias("starts"))
    first, most = F.array_distinct("starts"), F.least(F.col("size"), _prefix(F.col("size")) + (COMMON - 1))
    bound = F.get(F.sort_array(first), F.least(most, F.size(first)) - 1).bitwiseOR(LOW)
    lines = lines.select(*own, "hashes", "size", "starts", F.size(first).alias("low"), F.coalesce(bound, F.lit(0).cast("long")).alias("bound"))
    tokens = F.transform("starts", lambda w, i: F.when(w <= F.col("bound"), _shingle(w, i, F.col("hashes"))).otherwise(F.col("bound")))
    prefix = F.slice(F.array_remove(F.sort_array(F.array_distinct(tokens)), F.col("bound")), F.lit(1), most)
    return lines.select(*own, "size", "low", prefix.alias("prefix"))


def prefix_entries(rows: DataFrame, lines: DataFrame, copied: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entries (token, node, size, i, copies, s0..) of the first lines that share a token, their sets (node, tokens), sketches (node, size, s0..) and names (node, h1, h2, ...).

    Nodes are numbered in the order of the lines' places.
    """
    firsts = lines.join(sized(copied), ["h1", "h2"], "left").where(F.col("first").isNull() | (_place_hash() == F.col("first")))
    counts = firsts.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    shared = keep(counts.where("n > 1").select("token"))
    found = firsts.select("h1", "h2", "size", "low", F.size("prefix").alias("taken"), F.posexplode("prefix").alias("i", "token"))
    found = keep(found.join(sized(shared, SHARED), "token", "left_semi"))
    # a prefix of fewer tokens than it may have holds all of the line's
    common = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("taken").alias("taken"))
    common = keep(common.where(F.col("n") >= F.least(F.lit(COMMON), _need(F.col("taken")))).select("h1", "h2"))
    found = keep(found.where(F.col("i") < _prefix(F.col("size"))).drop("taken").join(sized(common), ["h1", "h2"], "left_semi"))
    # counted anew: tokens with the same holders are crowded alike, so one of them tells it of all
    crowd = found.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowd = keep(crowd.select("token", F.log2("n").cast("int").alias("level")))
    found = keep(found.drop("size", "low").join(sized(keep(_telling(found)), SHARED), "token", "left_semi"))
    asked = keep(found.select("h1", "h2").distinct())
    names = firsts.select("h1", "h2", "id", "k1", "k2", "pos", F.coalesce("copies", F.lit(1)).alias("copies")).join(sized(asked), ["h1", "h2"])
    names = names.dropDuplicates(["h1", "h2"])  # repeated rows have their lines at one place
    names = keep(keep(names).orderBy("id", "k1", "pos").withColumn("node", F.monotonically_increasing_id()))

    # only documents with such lines are split again; repeated rows give a line's set again
    asked = names.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "node")).alias("asked"))
    split = rows.join(sized(keep(asked)), ["k1", "k2"])
    # lines are picked before they are dealt out, so no line carries its whole document
    picked = let(F.split("text", "\n"), lambda lines: F.transform("asked", lambda a: F.struct(a["node"].alias("node"), F.get(lines, a["pos"]).alias("line"))))
    split = split.select(F.inline(picked))
    sets = keep(_tokenized(split))
    again = keep(sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
    if not again.isEmpty():
        sets = keep(sets.join(sized(again), "node", "left_anti").unionByName(sets.join(sized(again), "node", "left_semi").dropDuplicates(["node"])))

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(63).cast("int"))
    part = F.shiftright("token", 6).bitwiseAND(PARITY - 1)
    # tokens of a node stand together, so its sums are complete before the shuffle
    sketch = sets.select("node", F.explode("tokens").alias("token")).groupBy("node").agg(
        F.count("*").cast("int").alias("size"), *(F.bit_xor(F.when(part == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(PARITY))
    )
    known = keep(sketch.join(sized(names.select("node", "h1", "h2", "copies")), "node"))
    entries = found.join(sized(known.select("h1", "h2", "node")), ["h1", "h2"]).select("token", "node", "i")
    if not crowd.isEmpty():
        again = keep(entries.join(sized(crowd.select("token")), "token", "left_semi").select("node").distinct())
        fresh = _reordered(sets.join(sized(again), "node"), crowd).select("node", F.posexplode(F.slice("tokens", F.lit(1), _prefix(F.size("tokens")))).alias("i", "token")).select("token", "node", "i")
        entries = entries.join(sized(again), "node", "left_anti").unionByName(fresh)
    return keep(entries.join(sized(known.drop("h1", "h2")), "node")), sets, known.drop("h1", "h2", "copies"), names


def _telling(found: DataFrame) -> DataFrame:
    """(token) of ``found`` (h1, h2, size, i, token) that can be the first one of a matching pair; ``low``, if it is there, makes ``size`` a range.

    The first token that two matching sets share is, of all tokens with the same holders, the first in
    order, so one of each such group is enough. Where only two lines hold it, they must pass the
    length and the positional filter.
    """
    least = "low" if "low" in found.columns else "size"
    low, high = (lambda c: F.sum(F.col(c).bitwiseAND(2**32 - 1))), (lambda c: F.sum(F.shiftrightunsigned(c, 32)))
    tokens = found.groupBy("token").agg(
        F.count("*").alias("n"), F.min("i").alias("i"), F.min("size").alias("most"), F.min(least).alias("small"), F.max(least).alias("large"), F.min(F.col("size") - F.col("i")).alias("rest"),
        low("h1").alias("a"), high("h1").alias("b"), low("h2").alias("c"), high("h2").alias("d"),
    )
    both = (F.col("n") == 2) & (F.col("most") * 5 >= F.col("large") * 4) & (F.col("rest") * 9 >= (F.col("small") + F.col("large")) * 4)
    firsts = tokens.groupBy("n", "a", "b", "c", "d").agg(F.min("i").alias("i"), F.min_by("token", "i").alias("token"), F.min_by("rest", "i").alias("rest"), *(F.first(c).alias(c) for c in ("most", "small", "large")))
    return firsts.where((F.col("n") > 2) | both).select("token")


def _reordered(sets: DataFrame, crowd: DataFrame) -> DataFrame:
    """(node, tokens) of those sets that hold tokens of ``crowd`` (token, level): the others by hash, then these by level and hash.

    Only a set's crowded tokens are joined and gathered, the others stay in their array.
    """
    behind = sets.select("node", F.explode("tokens").alias("token")).join(sized(crowd), "token")
    behind = behind.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("level", "token"))).alias("behind"))
    late = F.col("behind.token")
    return sets.join(behind, "node").select("node", F.concat(F.sort_array(F.array_except("tokens", late)), late).alias("tokens"))


def _fits(x: str, y: str) -> Column:
    """Order, length and sketch filter of two classes: y may be an earlier match of x."""
    c = lambda t, name: F.col(f"{t}.{name}")
    length = F.least(c(x, "size"), c(y, "size")) * 5 >= F.greatest(c(x, "size"), c(y, "size")) * 4
    return (c(y, "node") < c(x, "node")) & length & (_apart(x, y) * 9 <= c(x, "size") + c(y, "size"))


def _near(x: str, y: str) -> Column:
    """``_fits`` and the positional filter of two entries that share a token."""
    c = lambda t, name: F.col(f"{t}.{name}")
    return (F.least(c(x, "size") - c(x, "i"), c(y, "size") - c(y, "i")) * 9 >= (c(x, "size") + c(y, "size")) * 4) & _fits(x, y)


def _apart(x: str, y: str) -> Column:
    """Bits in which two sketches differ: no more than the tokens that one of the sets lacks."""
    return sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(1, PARITY)), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))


def _equal_enough(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y)) * 9 >= (F.size(x) + F.size(y)) * 4


def _settled(entries: DataFrame, hubs: DataFrame, known: DataFrame, sets: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node) of the classes that match a hub, the first or the most copied class, of one of their tokens."""
    heads = hubs.select("token", F.array_distinct(F.array("first", "most")).alias("heads"))
    met = entries.drop("i", "copies").join(heads, "token").withColumn("head", F.explode("heads")).drop("token", "heads").where("head < node")
    pairs = met.alias("x").join(sized(known).alias("y"), (F.col("x.head") == F.col("y.node")) & _fits("x", "y"))
    pairs = keep(pairs.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct())
    left = sets.select(F.col("node").alias("x"), F.col("tokens").alias("tx")).join(sized(pairs), "x")
    right = sets.select(F.col("node").alias("y"), F.col("tokens").alias("ty")).join(sized(keep(pairs.select("y").distinct())), "y")
    return left.join(right, "y").where(_equal_enough("tx", "ty")).select(F.col("x").alias("node")).distinct()


def _match_before(entries: DataFrame, crowded: DataFrame, sets: DataFrame, settled: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node) of the classes not in ``settled`` that match any class before them.

    A token of two classes has brought them together already; those of the tokens in ``crowded`` meet
    in semi-joins, first by the filters, then on all tokens.
    """
    entries = entries.join(sized(crowded), "token", "left_semi")
    left = entries.join(sized(settled), "node", "left_anti")
    near = left.alias("x").join(entries.alias("y"), (F.col("x.token") == F.col("y.token")) & _near("x", "y"), "left_semi")
    near = keep(near)
    tokens = keep(near.select("token").distinct())
    held = keep(entries.join(sized(tokens), "token", "left_semi"))
    wanted = sets.join(sized(keep(held.select("node").distinct())), "node")
    xs, ys = near.join(wanted, "node"), held.join(wanted, "node")
    # the dearest test stands last, so it is made for what the filters leave
    match = (F.col("x.token") == F.col("y.token")) & _near("x", "y") & _equal_enough("x.tokens", "y.tokens")
    return xs.alias("x").join(ys.alias("y"), match, "left_semi").select("node").distinct()


def removed_lines(rows: DataFrame, least: int = WORDS) -> DataFrame:
    """(k1, k2, gone) of the documents that lose lines: the positions of those."""
    with scratch(rows.sparkSession) as keep:
        lines = keep(line_prefixes(rows, least))
        lines = lines.where(F.size("prefix") > 0)
        places = lines.select("id", "k1", "k2", "pos", "h1", "h2")
        copied = places.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("copies")).where("copies > 1")
        copied = keep(copied.select("h1", "h2", _place_hash("first.").alias("first"), "copies"))
        entries, sets, known, names = prefix_entries(rows, lines, copied, keep)
        hubs = keep(entries.groupBy("token").agg(F.count("*").alias("holders"), F.min("node").alias("first"), F.max_by("node", "copies").alias("most")).where("holders > 1"))
        settled = keep(_settled(entries, hubs, known, sets, keep))
        crowded = hubs.where("holders > 2").select("token")
        matched = keep(settled.unionByName(_match_before(entries, crowded, sets, settled, keep)))
        hit = names.join(sized(matched), "node").select("h1", "h2", F.lit(None).cast(copied.schema["first"].dataType).alias("first"))
        late = keep(copied.select("h1", "h2", "first").unionByName(hit))  # no place: all lines go
        gone = places.join(sized(late), ["h1", "h2"]).where(F.col("first").isNull() | (_place_hash() != F.col("first")))
        return checkpointed(gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone")))


def _judged(docs: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed (to the names given), ``n_lines``, ``n_removed`` and ``kept``."""
    gone = removed_lines(_documents(docs, id_col, text_col), least)
    own = [f"c{i}" for i in range(len(docs.columns))]
    text, id_ = (F.col(own[docs.columns.index(c)]) for c in (text_col, id_col))
    text = text.cast("string")
    joined = docs.toDF(*own).select(*own, *_keys(id_, F.coalesce(text, F.lit("")))).join(sized(gone), ["k1", "k2"], "left")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("gone", i)), "\n")
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    return joined.select(*own, n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.when(n_removed == 0, text).otherwise(kept).alias("kept")), own


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and ``kept``, the text without its removed lines (null text: null); lines of fewer than ``least`` words stay."""
    judged, own = _judged(docs, id_col, text_col, least)
    added = ["n_lines", "n_removed", "kept"]
    return judged.select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True) if c not in added), *added)


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``docs``, its own columns only, with the text that is left; a document that loses its last word goes.

    A column ``n_chars`` counts the text that is left.
    """
    judged, own = _judged(docs, id_col, text_col, least)
    lost = F.col("n_removed") > 0
    judged = judged.where(~lost | F.col("kept").rlike(r"[^\h\v]"))

    def column(own: str, name: str) -> Column:
        kind = docs.schema[name].dataType
        if name == text_col:
            return F.when(lost, F.col("kept").cast(kind)).otherwise(F.col(own))
        return F.when(lost, F.length("kept").cast(kind)).otherwise(F.col(own)) if name == "n_chars" else F.col(own)

    return judged.select(*(column(o, c).alias(c) for o, c in zip(own, docs.columns, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's lines, removed lines (short ones too), and the digest of what is kept."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
