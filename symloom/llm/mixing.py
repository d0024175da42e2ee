"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight from a hash of its id and text, so reruns agree.
Sources get targets: their weights share a total; a target stops at a multiple of its source's size and the excess is
shared again. Complete epochs of a source precede a fractional selection: documents in key order whose running sum of
sizes reaches the rest of the target. The running sum needs no task that holds a whole source: keys are dealt into BINS
equal bins per source, bin sums are accumulated, and only documents of the bin where the budget ends are ordered.

Passes: a document that overshoots the rest is left out, and the next pass fills the gap with documents that still fit.

Cases: null and empty texts have size 0 and take nothing (they belong to the epochs of their source); null sources are a
source of their own, last in order; documents with equal keys are ordered by id and size; sources of size 0 have target
0; repeated rows draw equal keys and count each; an empty table gives an empty result; other columns pass through mix().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.llm.common import WORD, fresh_name, materialize, table, text_of

BINS, PASSES, CYCLE, SHARE, MOST = 4096, 3, (3.0, 1.0, 2.0), 1.5, 2.0
#: Characters whose share of a text lowers its quality weight.
NOISE = "#*$%&|<>"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for a text of 50 words or more without noise characters and repeated lines, down to 0.1: the shares of other
    characters and of distinct lines, and how far the text is short of 50 words, multiplied."""
    noise = F.length(text) - F.length(F.translate(text, NOISE, ""))
    clean = 1.0 - F.least(F.lit(0.9), 4.0 * noise / F.greatest(F.length(text), F.lit(1)))
    lines = F.split(text, "\n", -1)
    distinct = F.size(F.array_distinct(lines)) / F.size(lines)
    return F.greatest(F.lit(0.1), clean * distinct * F.least(F.lit(1.0), (size + 10) / 60.0))


def uniform(key: Column) -> Column:
    """52 bits of the key's MD5 as a number over 0, below 1."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target. The level that all uncapped weights share is found from running sums over the
    sources in the order in which they reach their caps; there is one row for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = reduce(lambda c, i: F.when(F.col("i") % len(cycle) == i, F.lit(cycle[i])).otherwise(c), range(1, len(cycle)), F.lit(cycle[0]))
    d = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("w", w)
    d = d.withColumn("cap", most * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("w"))
    by = W.orderBy("reach", "i")
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    d = d.withColumn("total", share * F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    d = d.withColumn("level", level).withColumn("free", F.col("reach") >= F.col("level"))
    d = d.withColumn("common", F.min(F.when(F.col("free"), F.struct("reach", "i", "level"))).over(everything)["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("common") * F.col("w")), F.col("cap"))
    return d.select("source", "source_size", target.alias("target"))


def draws(docs: DataFrame, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size and the sampling key in 0..1: u^(1/weight), whose descending order is the ascending order of
    the exponential key -ln(u)/weight."""
    t = text_of()
    u = uniform(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = docs.select("doc_id", "source", n_words(t).alias("size"), quality_weight(t, n_words(t)).alias("weight"), u.alias("u"), *keep)
    return slim.select("doc_id", "source", "size", F.round(F.pow("u", 1 / F.col("weight")), 12).alias("draw"), *keep)


def select(slim: DataFrame, bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """slim: doc_id, source, size, draw and more -> with source_size, target and times (how often the mix has the row)."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    goal = goal.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
    goal = materialize(goal.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goal")
    cols = slim.columns
    open_ = slim.withColumn("bin", F.least(F.floor((1 - F.col("draw")) * bins), F.lit(bins - 1)))
    chosen, left = [], goal.select("source", "left")
    same = lambda a, b, *ks: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in ks))
    for p in range(passes):
        # Only documents that fit into what is left take part: what came before them in order is spent or too large.
        fits = open_.join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        fits = fits.where((F.col("size") <= F.col("left")) & (F.col("size") > 0))
        sums = fits.groupBy("source", "bin").agg(F.sum("size").alias("held"), F.first("left").alias("left"))
        upto = W.partitionBy("source").orderBy("bin")
        sums = sums.withColumn("before", F.sum("held").over(upto) - F.col("held"))
        last = sums.where(F.col("before") + F.col("held") > F.col("left"))
        last = last.groupBy("source").agg(F.min(F.struct("bin", "before")).alias("m")).select(F.col("source").alias("s"), "m.bin", "m.before")
        last = materialize(last, "mix-bins").withColumnRenamed("bin", "last_bin")
        fits = fits.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        whole = fits.where(F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")))
        edge = fits.where(F.col("bin") == F.col("last_bin"))
        order = W.partitionBy("source", "bin").orderBy(F.col("draw").desc(), F.col("doc_id").asc_nulls_last(), "size", "row")
        edge = edge.withColumn("sum", F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        edge = edge.where(F.col("sum") <= F.col("left")).drop("sum")
        got = materialize(whole.unionByName(edge).select("row", "source", "size"), "mix-taken")
        chosen.append(got)
        if p + 1 < passes:
            spent = got.groupBy("source").agg(F.sum("size").alias("spent")).withColumnRenamed("source", "s")
            left = left.join(spent, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"))
            left = materialize(left, "mix-left")
            open_ = open_.join(got.select("row"), "row", "left_anti")
    picked = reduce(DataFrame.unionByName, chosen).select("row", F.lit(1).alias("once"))
    out = slim.join(picked, "row", "left").join(goal.drop("left").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return out.select(*cols, "source_size", "target", (F.col("epochs") + F.coalesce("once", F.lit(0))).alias("times"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = materialize(draws(docs).withColumn("row", F.monotonically_increasing_id()), "mix-draws")
    out = select(slim)
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix has it, and no other columns than docs has."""
    row, times = fresh_name(docs, "mix_row"), fresh_name(docs, "mix_times")
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    slim = materialize(draws(kept, keep=(row,)).withColumnRenamed(row, "row"), "mix-draws")
    counts = select(slim).where("times > 0").select(F.col("row").alias(row), F.col("times").cast("int").alias(times))
    out = kept.join(counts, row)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, size,
    (('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    greatest(0.1, (1.0 - least(0.9, 4.0 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))
      / greatest(length(coalesce(text, '')), 1)))::DOUBLE * (list_unique(string_split(coalesce(text, ''), chr(10)))::DOUBLE / len(string_split(coalesce(text, ''), chr(10))))
      * least(1.0::DOUBLE, (size + 10) / 60.0::DOUBLE)) AS weight
  FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0 * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS reach FROM w),
l AS (SELECT *, reach >= (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY reach, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY reach, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
  (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY reach, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY reach, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, w, least(cap, coalesce((SELECT arg_min(level, reach) FROM l WHERE free), cap) * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs FROM g),
k AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS left0,
    round(pow(d.u, 1 / d.weight), 12) AS draw FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
p1 AS (SELECT *, size > 0 AND size <= left0 AND sum(CASE WHEN size > 0 AND size <= left0 THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY draw DESC, doc_id ROWS UNBOUNDED PRECEDING) <= left0 AS t1 FROM k),
q1 AS (SELECT *, left0 - coalesce(sum(size) FILTER (t1) OVER (PARTITION BY source), 0) AS left1 FROM p1),
p2 AS (SELECT *, NOT t1 AND size > 0 AND size <= left1 AND sum(CASE WHEN NOT t1 AND size > 0 AND size <= left1 THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY draw DESC, doc_id ROWS UNBOUNDED PRECEDING) <= left1 AS t2 FROM q1),
q2 AS (SELECT *, left1 - coalesce(sum(size) FILTER (t2) OVER (PARTITION BY source), 0) AS left2 FROM p2),
p3 AS (SELECT *, NOT t1 AND NOT t2 AND size > 0 AND size <= left2 AND sum(CASE WHEN NOT t1 AND NOT t2 AND size > 0 AND size <= left2 THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY draw DESC, doc_id ROWS UNBOUNDED PRECEDING) <= left2 AS t3 FROM q2)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((epochs + t1::INT + t2::INT + t3::INT) * size)::BIGINT AS taken FROM p3
"""
