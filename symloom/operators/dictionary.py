"""Dictionary operators over sequences: vocabularies, compact ids, delta and Rice coding of vocabularies, adjacent pairs,
merges and their expansion. All are scoped by seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from symloom.functions.numeric import rice_length, rice_parameter


def by_pos() -> WindowSpec:
    return W.partitionBy("seq").orderBy("pos")


def first_seen(tokens: DataFrame) -> DataFrame:
    """seq, tok, n, first_pos, cid: distinct symbols numbered in order of first occurrence."""
    seen = tokens.groupBy("seq", "tok").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return seen.withColumn("cid", (F.row_number().over(W.partitionBy("seq").orderBy("first_pos")) - 1).cast("long"))


def compact(tokens: DataFrame) -> DataFrame:
    """seq, tok, n, cid: distinct symbols numbered in their own order."""
    seen = tokens.groupBy("seq", "tok").agg(F.count(F.lit(1)).alias("n"))
    return seen.withColumn("cid", (F.row_number().over(W.partitionBy("seq").orderBy("tok")) - 1).cast("long"))


def remap(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """seq, pos, cid."""
    return tokens.join(vocabulary.select("seq", "tok", "cid"), ["seq", "tok"]).select("seq", "pos", "cid")


def restore(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """seq, pos, tok from compact ids; unknown ids are dropped."""
    return ids.join(vocabulary.select("seq", "tok", "cid"), ["seq", "cid"]).select("seq", "pos", "tok")


def joined(tokens: DataFrame, sep: str = " ") -> DataFrame:
    """seq, text: the symbols of each sequence in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "tok")))
    return tokens.groupBy("seq").agg(F.array_join(F.transform(rows, lambda r: r["tok"]), sep).alias("text"))


def vocabulary_deltas(ids: DataFrame) -> DataFrame:
    """seq, id, delta over a sequence's sorted distinct numeric ids (the first delta is from 0)."""
    before = F.lag("id", 1, 0).over(W.partitionBy("seq").orderBy("id"))
    return ids.select("seq", "id", (F.col("id") - before).alias("delta"))


def vocabulary_rice(ids: DataFrame) -> DataFrame:
    """seq, ve, k, bits: the Rice parameter from the mean gap and the coded length of the vocabulary."""
    stats = ids.groupBy("seq").agg(F.count(F.lit(1)).alias("ve"), F.max("id").alias("last"))
    gap = F.when(F.col("ve") > 1, F.col("last") / (F.col("ve") - 1)).otherwise(F.col("last"))
    stats = stats.select("seq", "ve", rice_parameter(gap).alias("k"))
    coded = vocabulary_deltas(ids).join(stats, "seq")
    return coded.groupBy("seq", "ve", "k").agg(F.sum(rice_length(F.col("delta"), F.col("k"))).cast("long").alias("bits"))


def pairs(tokens: DataFrame) -> DataFrame:
    """seq, pos, l, r for each adjacent pair; overlapping pairs count."""
    return tokens.select("seq", "pos", F.col("tok").alias("l"), F.lead("tok").over(by_pos()).alias("r")).where("r IS NOT NULL")


def pair_counts(tokens: DataFrame) -> DataFrame:
    return pairs(tokens).groupBy("seq", "l", "r").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))


def top_pair(tokens: DataFrame) -> DataFrame:
    """The most frequent pair of each sequence; of equal ones that whose count was complete first."""
    best = F.max(F.struct("n", (-F.col("last_pos")).alias("m"), "l", "r")).alias("b")
    return pair_counts(tokens).groupBy("seq").agg(best).select("seq", "b.l", "b.r", "b.n")


def merge_once(tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """Replaces the chosen pair of each sequence, leftmost first and not overlapping, by l + U+0001 + r, and renumbers.
    In a run of equal symbols every second one begins a pair."""
    rows = tokens.join(chosen.select("seq", "l", "r"), "seq", "left")
    hit = (F.col("tok") == F.col("l")) & (F.lead("tok").over(by_pos()) == F.col("r"))
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    new_run = F.when(F.col("hit") & F.coalesce(F.lag("hit").over(by_pos()), F.lit(False)) & (F.col("l") == F.col("r")), 0).otherwise(1)
    rows = rows.withColumn("new", new_run).withColumn("run", F.sum("new").over(by_pos()))
    place = F.row_number().over(W.partitionBy("seq", "run").orderBy("pos")) - 1
    rows = rows.withColumn("start", F.col("hit") & (place % 2 == 0))
    rows = rows.withColumn("gone", F.coalesce(F.lag("start").over(by_pos()), F.lit(False))).where(~F.col("gone"))
    tok = F.when(F.col("start"), F.concat("l", F.lit("\x01"), "r")).otherwise(F.col("tok"))
    return rows.select("seq", (F.row_number().over(by_pos()) - 1).alias("pos"), tok.alias("tok"))


def learn_merges(tokens: DataFrame, rounds: int, min_freq: int, cut) -> DataFrame:
    """tokens after so many rounds of merging the most frequent pair of each sequence, if it is found min_freq times.
    cut(df, label) writes and rereads a round's result, so that the lineage does not grow."""
    for i in range(rounds):
        chosen = top_pair(tokens).where(F.col("n") >= min_freq)
        tokens = cut(merge_once(tokens, chosen), f"merge{i}")
    return tokens


def expand_merges(tokens: DataFrame) -> DataFrame:
    """Undoes all merges at once: merged symbols are split into what they stand for."""
    flat = tokens.select("seq", F.col("pos").alias("p"), F.posexplode(F.split("tok", "\x01")).alias("q", "tok"))
    return flat.select("seq", (F.row_number().over(W.partitionBy("seq").orderBy("p", "q")) - 1).alias("pos"), "tok")
