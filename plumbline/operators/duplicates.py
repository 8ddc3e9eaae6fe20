"""Exact and near duplicate pairs without an all-pairs join, their risk, and leakage between two sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import exprs as E


def exact_duplicate_groups(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(digest, members, first_id) of contents held more than once: a row a group, however large."""
    return df.select(F.md5(content).alias("digest"), F.col(id_col).alias("id")).groupBy("digest").agg(F.count("*").alias("members"), F.min("id").alias("first_id")).where("members > 1")


def exact_duplicate_pairs(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """All (i, j), i < j, of equal content. The pairs of a group grow with its square; ``exact_duplicate_groups`` does not."""
    hashed = df.select(F.md5(content).alias("digest"), F.col(id_col).alias("id"))
    return hashed.alias("a").join(hashed.alias("b"), (F.col("a.digest") == F.col("b.digest")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))


def hash_bands(value: Column, bits: int, distance: int) -> Column:
    """(band, bits of the band) for each two of ``distance + 2`` disjoint parts: hashes within ``distance`` agree on two parts at least."""
    count, at, parts = distance + 2, 0, []
    for k in range(count):
        width = bits // count + (1 if k < bits % count else 0)
        parts.append(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    bands = [F.struct(F.lit(k * count + m).alias("band"), parts[k].alias("part"), parts[m].alias("other")) for k in range(count) for m in range(k + 1, count)]
    return F.explode(F.array(*bands))


def near_duplicate_classes(samples: DataFrame, bits: int, most_mse: float = 0.001, most_hamming: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near duplicates of samples (id, pixels, hash) as classes of equal hash and pixels, without listing members' pairs.

    Gives (members, classes, links): (id, rep); (rep, hash, size), a row a class, blank images being
    one; and (x, y, hamming, mse, exact) for the pairs of classes that match, by representatives.
    Complete: within ``most_hamming`` bits two of ``most_hamming + 2`` parts of the hash agree; hashes of
    up to 64 bits. Only hashes are joined on bands; pixels meet the surviving candidates.
    """
    rows = samples.select("id", "hash", F.xxhash64("pixels").alias("p1"), F.xxhash64(F.lit(1), "pixels").alias("p2"))
    classes = rows.groupBy("hash", "p1", "p2").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    members = rows.join(classes, ["hash", "p1", "p2"]).select("id", "rep")
    light = classes.withColumn("b", hash_bands(F.col("hash"), bits, most_hamming)).select("rep", "hash", "b.*")
    a, b = light.alias("a"), light.alias("b")
    near = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.other") == F.col("b.other")) & (F.col("a.rep") < F.col("b.rep")) & (E.hamming(F.col("a.hash"), F.col("b.hash")) <= most_hamming)
    pairs = a.join(b, near).select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y"), E.hamming(F.col("a.hash"), F.col("b.hash")).alias("hamming")).distinct()
    left, right = (samples.select(F.col("id").alias(r), F.col("pixels").alias(f"p{r}")) for r in ("x", "y"))
    links = pairs.join(left, "x").join(right, "y").select("x", "y", "hamming", E.mse(F.col("px"), F.col("py")).alias("mse"), (F.col("px") == F.col("py")).alias("exact"))
    return members, classes.select("rep", "hash", "size"), links.where(F.col("exact") | (F.col("mse") <= most_mse))


def near_duplicate_pairs(samples: DataFrame, bits: int, most_mse: float = 0.001, most_hamming: int = 4) -> DataFrame:
    """(i, j, hamming, mse, exact) of samples (id, pixels, hash): equal pixels, or hash and mse both near.

    Lists the pairs of members of ``near_duplicate_classes``, so it grows with the square of a class;
    ``class_risk`` needs no pairs.
    """
    members, _, links = near_duplicate_classes(samples, bits, most_mse, most_hamming)
    m, n = (members.select(F.col("id").alias(i), F.col("rep").alias(r)) for i, r in (("m", "x"), ("n", "y")))
    across = links.join(m, "x").join(n, "y").select(F.least("m", "n").alias("i"), F.greatest("m", "n").alias("j"), "hamming", F.round("mse", 6).alias("mse"), "exact")
    within = m.join(n, (F.col("x") == F.col("y")) & (F.col("m") < F.col("n")))
    within = within.select(F.col("m").alias("i"), F.col("n").alias("j"), F.lit(0).alias("hamming"), F.lit(0.0).alias("mse"), F.lit(True).alias("exact"))
    return across.unionByName(within)


def pair_severity(exact: Column, hamming: Column) -> Column:
    """How much a pair counts: 1 if exact, less the more bits differ."""
    return F.when(exact, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - hamming / 8.0))


def class_risk(classes: DataFrame, links: DataFrame, n: DataFrame) -> DataFrame:
    """The row of ``duplicate_risk``, by algebra over classes: a class of m members holds m(m-1)/2 exact pairs, a link of classes m times m' pairs.

    Sums are over classes and their links, whatever number of members these have.
    """
    sizes = classes.select("rep", "size")
    linked = links.join(sizes.select(F.col("rep").alias("x"), F.col("size").alias("m")), "x").join(sizes.select(F.col("rep").alias("y"), F.col("size").alias("k")), "y")
    count = F.col("m") * F.col("k")
    across = linked.agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col("exact"), count)), F.lit(0)).alias("e"),
        F.coalesce(F.sum(count * pair_severity(F.col("exact"), F.col("hamming"))), F.lit(0.0)).alias("s"),
    )
    touched = links.select(F.col("x").alias("rep")).union(links.select("y")).distinct().withColumn("touched", F.lit(True))
    own = sizes.join(touched, "rep", "left")
    within = own.agg(F.coalesce(F.sum(F.expr("size * (size - 1) div 2")), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(F.col("touched") | (F.col("size") > 1), F.col("size"))), F.lit(0)).alias("n_members"))
    row = one_row(across, within, n).select("n", (F.col("p") + F.col("w")).alias("n_pairs"), (F.col("e") + F.col("w")).alias("n_exact"), "n_members", (F.col("s") + F.col("w")).alias("severity"))
    return row.select("n", "n_pairs", "n_exact", "n_members", F.when(F.col("n_pairs") == 0, 0.0).otherwise(_risk(F.col("n_members") / F.col("n"), F.col("severity"))).alias("risk"))


def duplicate_members(pairs: DataFrame) -> DataFrame:
    """The distinct ids that are in some pair."""
    return pairs.select(F.col("i").alias("id")).union(pairs.select(F.col("j").alias("id"))).distinct()


def _risk(ratio: Column, severity: Column) -> Column:
    return F.round(F.least(F.lit(95.0), F.greatest(F.lit(15.0), 30 + 40 * ratio + F.least(F.lit(30.0), 2 * severity))), 1)


def duplicate_risk(pairs: DataFrame, n: DataFrame) -> DataFrame:
    """One row (n_pairs, n_exact, n_members, risk) from pairs and a one-row count ``n``; risk 0 without pairs."""
    members = duplicate_members(pairs).agg(F.count("*").alias("n_members"))
    summed = pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.col("exact").cast("long")), F.lit(0)).alias("n_exact"), F.coalesce(F.sum(pair_severity(F.col("exact"), F.col("hamming"))), F.lit(0.0)).alias("severity"))
    row = one_row(summed, members, n)
    return row.select("n", "n_pairs", "n_exact", "n_members", F.when(F.col("n_pairs") == 0, 0.0).otherwise(_risk(F.col("n_members") / F.col("n"), F.col("severity"))).alias("risk"))


def exact_duplicate_risk(groups: DataFrame, n: DataFrame) -> DataFrame:
    """As ``duplicate_risk`` for exact groups: severity is the sum of m(m-1)/2, no pair is made."""
    summed = groups.agg(F.coalesce(F.sum(F.expr("members * (members - 1) div 2")), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("members"), F.lit(0)).alias("n_members"))
    row = one_row(summed, n)
    return row.select("n", "n_pairs", F.col("n_pairs").alias("n_exact"), "n_members", F.when(F.col("n_pairs") == 0, 0.0).otherwise(_risk(F.col("n_members") / F.col("n"), F.col("n_pairs").cast("double"))).alias("risk"))


def one_row(*frames: DataFrame) -> DataFrame:
    """Aggregates of one row each, side by side."""
    out = frames[0].withColumn("__one", F.lit(1))
    for other in frames[1:]:
        out = out.join(F.broadcast(other.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one")


def duplicate_finding(risk: DataFrame) -> DataFrame:
    """The finding of a ``duplicate_risk`` row."""
    clean = F.col("n_pairs") == 0
    return risk.select(
        F.lit("DatasetDuplicateDetector").alias("detector_id"),
        F.when(clean, "DATASET_DUPLICATE_CLEAN").otherwise("DATASET_DUPLICATE_SAMPLES").alias("finding_type"),
        F.col("risk").alias("risk_score"),
        F.when(clean, "HIGH").otherwise("MEDIUM").alias("evidence_strength"),
        F.when(clean, "No Dataset Duplicate Pairs Detected").otherwise("Dataset Duplicate / Near-Duplicate Samples Detected").alias("title"),
        F.when(clean, F.format_string("No duplicate pairs among %d samples.", "n")).otherwise(F.format_string("%d pairs (%d exact) touch %d of %d samples.", "n_pairs", "n_exact", "n_members", "n")).alias("explanation"),
        F.lit(False).alias("is_hard_gate"),
    )


def cross_set_leakage(train: DataFrame, test: DataFrame, train_id: str, test_id: str, train_content: Column, test_content: Column) -> DataFrame:
    """(test_id, copies, first_train_id) of test rows whose content the other set holds too."""
    held = train.select(F.md5(train_content).alias("digest"), F.col(train_id).alias("id")).groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first_train_id"))
    return test.select(F.col(test_id).alias("test_id"), F.md5(test_content).alias("digest")).join(held, "digest").select("test_id", "copies", "first_train_id")


def page(pairs: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 0) of the pairs in order."""
    return pairs.orderBy("i", "j").offset(number * size).limit(size)


def page_exact(df: DataFrame, id_col: str, content: Column, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` of ``exact_duplicate_pairs`` in order, opening only the groups that the page can reach.

    Up to the page's end there are k pairs; they lie in the k groups of the smallest first ids, and in
    each among its 2k smallest ids, as an id is the first of a pair with each of those behind it.
    """
    k = (number + 1) * size
    hashed = df.select(F.md5(content).alias("digest"), F.col(id_col).alias("id"))
    groups = hashed.groupBy("digest").agg(F.count("*").alias("members"), F.min("id").alias("first_id")).where("members > 1").orderBy("first_id").limit(k)
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("id"))
    own = hashed.join(F.broadcast(groups.select("digest")), "digest", "left_semi").withColumn("rank", rank).where(F.col("rank") <= 2 * k)
    a, b = own.alias("a"), own.alias("b")
    reached = (F.col("a.digest") == F.col("b.digest")) & (F.col("a.id") < F.col("b.id")) & (F.col("b.rank") <= F.col("a.rank") + k)
    return page(a.join(b, reached).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")), number, size)
