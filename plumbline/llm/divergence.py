"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language.

All arithmetic is in integers. With ``p = 1 + floor(unit * (count + 1) / (N + V))`` for every kept term,
a source's distance from another is the sum over all kept terms of ``f = floor((p - q)^2 / q)``.
The sum depends on the pair of counts alone, so columns of counts are run-length encoded: the kept
vocabulary is reordered so that terms of equal counts lie together, each group's column becomes runs,
the run boundaries of a pair of groups are intersected, and f, taken once for each piece, is multiplied
by the piece's length.

As Spark jobs: tasks count the words of their own documents and send sums by (language, source, term);
terms whose counts are equal in every group are added up before anything is dealt out, with their
number as length; these columns are dealt into parts of bounded size, each part is ordered and encoded
by itself, and sends one sum a pair of groups. A frequent word or a large source sends one row a task.
Nothing but the number of columns comes to the driver.

Defined cases: null text, lang and source are ''. A group without kept terms has count 0 in all of
them; where a language keeps no term its values are 0 and it has no term rows. Every row counts as a
document, repeated rows and repeated or null ids too; ids are not read, nor are other columns. Ties
rank by the item's UTF-8 bytes. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.session import scratch, sized, stored

#: What words are split at.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
#: Bytes of text counted at a time, and counts of a part of the vocabulary held at a time.
TEXT, CELLS = 1 << 23, 1 << 18


def _unique_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of ``values`` (or the number of rows) at each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts, length = tk.runs(keys)
    return keys[starts], length, *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def count_words(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, df): occurrences and rows of each term, by lang and source, of some rows."""
    words = pc.split_pattern_regex(pc.ascii_lower(rows.column("text")), BETWEEN)
    row = np.asarray(pc.list_parent_indices(words)).astype(np.int64)
    terms = words.flatten().dictionary_encode()
    code, distinct = np.asarray(terms.indices).astype(np.int64), terms.dictionary
    real = np.asarray(pc.greater(pc.binary_length(distinct), 0))[code] if len(code) else np.zeros(0, bool)
    row, code = row[real], code[real]
    many = max(1, len(distinct))
    found, n = _unique_sums(row * many + code)[:2]
    langs, sources = rows.column("lang").dictionary_encode(), rows.column("source").dictionary_encode()
    group = np.asarray(langs.indices).astype(np.int64) * max(1, len(sources.dictionary)) + np.asarray(sources.indices)
    found, df, n = _unique_sums(group[found // many] * many + found % many, n)
    group, code = np.divmod(found, many)
    lang, source = np.divmod(group, max(1, len(sources.dictionary)))
    columns = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), distinct.take(pa.array(code)), pa.array(n), pa.array(df)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])


def _counted(batches):
    for batch in batches:
        for rows, _, _ in tk.slabs(batch, "text", TEXT):
            yield count_words(rows)


def run_columns(counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The vocabulary reordered so that equal counts lie together, as (offsets of the columns, (first column, count) of each run of each group).

    ``counts`` is (groups, columns) and ``lengths`` the number of terms behind each column.
    """
    wide = np.argsort(-(counts > 0).sum(axis=1), kind="stable")  # groups of most terms vary first
    order = np.lexsort(counts[wide[::-1]]) if len(counts) else np.arange(counts.shape[1])
    counts = counts[:, order]
    runs = []
    for own in counts:
        starts, _ = tk.runs(own)
        runs.append((starts, own[starts]))
    return np.concatenate([[0], np.cumsum(lengths[order])]), runs


def pair_sums(counts: np.ndarray, lengths: np.ndarray, totals: np.ndarray, kept: int, unit: int = UNIT) -> np.ndarray:
    """(groups, groups): at [g, h] the sum of floor((p - q)^2 / q) over the columns, p of g and q of h."""
    at, runs = run_columns(counts, lengths)
    shares = [1 + unit * (own + 1) // (total + kept) for (_, own), total in zip(runs, totals, strict=True)]
    out = np.zeros((len(runs), len(runs)), np.int64)
    for g, (mine, _) in enumerate(runs):
        for h in range(g):
            theirs = runs[h][0]
            cut = np.union1d(mine, theirs)
            weight = np.diff(np.append(at[cut], at[-1]))
            p = shares[g][np.searchsorted(mine, cut, side="right") - 1]
            q = shares[h][np.searchsorted(theirs, cut, side="right") - 1]
            apart = (p - q) * (p - q)
            out[g, h], out[h, g] = (apart // q * weight).sum(), (apart // p * weight).sum()
    return out


def _part_sums(columns: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of one part of a language's vocabulary, for all pairs of its groups; none where the part has no columns."""
    if not columns.num_rows:
        return pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())]).empty_table()
    by = np.argsort(np.asarray(groups["sid"]))
    totals, n = np.asarray(groups["n"])[by], len(by)
    counts = np.zeros((n, len(columns)), np.int64)
    lists = columns["counts"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    entries = lists.flatten()
    counts[np.asarray(entries.field("sid")), np.asarray(pc.list_parent_indices(lists))] = np.asarray(entries.field("n"))
    sums = pair_sums(counts, np.asarray(columns["terms"]), totals, int(groups["v"][0].as_py()))
    g, h = (x.ravel() for x in np.indices((n, n)))
    some = g != h
    return pa.table({"lang": pa.array([columns["lang"][0].as_py()] * int(some.sum()), pa.string()), "g": g[some].astype(np.int32), "h": h[some].astype(np.int32), "value": sums.ravel()[some]})


def kept_terms(rows: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(lang, term, counts by source number, total) of the terms in at least ``least`` rows of their language."""
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counted = counted.join(sized(groups.select("lang", "source", "sid")), ["lang", "source"])
    terms = counted.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("counts"), F.sum("n").alias("total"), F.sum("df").alias("df"))
    return terms.where(F.col("df") >= least).drop("df")


def _pairs(kept: DataFrame, groups: DataFrame, keep) -> DataFrame:
    """(lang, g, h, value) of the pairs of groups of languages that keep terms."""
    columns = keep(kept.groupBy("lang", "counts").agg(F.count("*").alias("terms")))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    parts = 1 + columns.count() * most // CELLS
    columns = columns.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(parts)).cast("int"))
    each = groups.select("lang", "sid", "n", "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sums = columns.groupBy("lang", "part").cogroup(each.groupBy("lang", "part"))
    sums = sums.applyInArrow(_part_sums, "lang string, g int, h int, value long")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): the ``pair`` rows of each group, and its ``top`` ``term`` rows."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    with scratch(docs.sparkSession) as keep:
        names = keep(rows.select("lang", "source").distinct().withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
        kept = keep(kept_terms(rows, names, least))
        each = kept.select("lang", "term", "total", F.inline("counts"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
        totals = each.groupBy("lang", "sid").agg(F.sum("n").alias("n"))
        groups = names.join(totals, ["lang", "sid"], "left").join(langs, "lang", "left")
        groups = keep(groups.select("lang", "source", "sid", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "all_n"))))

        sums = keep(_pairs(kept, groups, keep))
        own, other = groups.select("lang", "source", F.col("sid").alias("g")), groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("h"))
        pairs = own.join(other, "lang").where(F.col("g") != F.col("h")).join(sums, ["lang", "g", "h"], "left")
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

        p = f"(1 + {UNIT}L * (count + 1) div (n + v))"
        q = f"(1 + {UNIT}L * (total + 1) div (all_n + v))"
        terms = each.withColumnRenamed("n", "count").join(sized(groups), ["lang", "sid"]).withColumns({"p": F.expr(p), "q": F.expr(q)}).where("p > q")
        terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
        return stored(ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top)))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every group's distances and its most particular terms."""
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS all_n FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n)::BIGINT AS n FROM cnt GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000::BIGINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p,
         1 + (1000000000::BIGINT * (k.total + 1)) // (l.all_n + l.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE cnt > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
