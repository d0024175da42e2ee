"""Order transforms of sequences and their inverses: reversal and the Burrows-Wheeler transform of all rotations.

Equal rotations (periodic sequences) are ordered by position, so the transform is a permutation for every input and is
inverted without a sentinel. seq is the unit of work; all sequences advance together in each round."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from symloom.operators.coding import rotations, unrotated
from symloom.session import ship

PACKED = "seq long, toks array<string>, primary long"


def seq() -> WindowSpec:
    return W.partitionBy("seq")


def reverse(tokens: DataFrame) -> DataFrame:
    return tokens.select("seq", (F.count(F.lit(1)).over(seq()) - 1 - F.col("pos")).alias("pos"), "tok")


def rotation_ranks(tokens: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """seq, pos, tok, n, rank (from 0): the place of the rotation that begins at pos. Prefix doubling: the rank of 2h
    symbols comes from the ranks of h symbols at pos and at pos + h; rounds end once every rank is single or h covers the
    longest sequence. cut(df, label) writes and rereads a round."""
    rows = tokens.select("seq", "pos", "tok", F.count(F.lit(1)).over(seq()).alias("n"), F.dense_rank().over(seq().orderBy("tok")).alias("rank"))
    rows, h = cut(rows, "rank0"), 1
    while not rows.groupBy("seq", "rank").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where((F.col("c") > 1) & (F.col("n") > h)).isEmpty():
        later = rows.select("seq", F.pmod(F.col("pos") - h, F.col("n")).alias("pos"), F.col("rank").alias("next"))
        both = rows.join(later, ["seq", "pos"])
        rows = cut(both.select("seq", "pos", "tok", "n", F.dense_rank().over(seq().orderBy("rank", "next")).alias("rank")), f"rank{h}")
        h *= 2
    return rows.withColumn("rank", (F.row_number().over(seq().orderBy("rank", "pos")) - 1).cast("long"))


def bwt(tokens: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """seq, pos, tok (the symbol before each rotation, in order of rotations) and primary (the row of the sequence itself)."""
    ranked = cut(rotation_ranks(tokens, cut), "ranks")
    before = ranked.select("seq", F.pmod(F.col("pos") + 1, F.col("n")).alias("pos"), F.col("tok").alias("before"))
    rows = ranked.select("seq", "pos", "rank").join(before, ["seq", "pos"])
    primary = F.max(F.when(F.col("pos") == 0, F.col("rank"))).over(seq())
    return rows.select("seq", F.col("rank").alias("pos"), F.col("before").alias("tok"), primary.alias("primary"))


def lf_map(last: DataFrame) -> DataFrame:
    """last with lf, the row of the rotation one symbol earlier: symbols smaller than tok, plus equal ones before."""
    return last.withColumn("lf", (F.row_number().over(seq().orderBy("tok", "pos")) - 1).cast("long"))


def bwt_inverse(last: DataFrame) -> DataFrame:
    """seq, pos, tok of the original sequences: the chase along lf is done within each sequence. Rows with equal rotations
    follow one another in a cycle of their own, which holds the same symbols."""

    ship(last.sparkSession)

    def chase(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        lf, tok, n = rows["lf"].to_numpy(), rows["tok"].to_numpy(), len(rows)
        at, out = int(rows["primary"].iloc[0]), np.empty(n, object)
        for i in range(n - 1, -1, -1):
            out[i] = tok[at]
            at = lf[at]
        return pd.DataFrame({"seq": rows["seq"].iloc[0], "pos": np.arange(n), "tok": out})

    return lf_map(last).groupBy("seq").applyInPandas(chase, "seq long, pos long, tok string")


def _symbols(toks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The symbols of all rows as places among the distinct ones in order of bytes, where each row begins, the distinct ones."""
    held = toks.flatten().dictionary_encode()
    order = pc.sort_indices(held.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = toks.offsets.to_numpy().astype(np.int64)
    return place[held.indices.to_numpy()], first - first[0], held.dictionary.take(pa.array(order))


def _packed(seq: pa.Array, codes: np.ndarray, first: np.ndarray, kinds: pa.Array, primary: np.ndarray) -> pa.RecordBatch:
    toks = pa.ListArray.from_arrays(pa.array(first, pa.int32()), kinds.take(pa.array(codes)))
    return pa.RecordBatch.from_arrays([seq, toks, pa.array(primary)], names=["seq", "toks", "primary"])


def bwt_packed(packed: DataFrame) -> DataFrame:
    """PACKED: the transform of each row's array of symbols (seq, toks), as bwt() gives it. A row is a sequence of its own, even
    if others have its seq."""
    ship(packed.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, first, kinds = _symbols(batch.column("toks"))
            primary = np.zeros(len(batch), np.int64)
            for r, (i, j) in enumerate(pairwise(first.tolist())):
                if i < j:
                    order = rotations(codes[i:j])
                    codes[i:j], primary[r] = codes[i:j][order - 1], order.argmin()
            yield _packed(batch.column("seq"), codes, first, kinds, primary)

    return packed.select("seq", "toks").mapInArrow(work, PACKED)


def bwt_packed_inverse(last: DataFrame) -> DataFrame:
    """PACKED with the original symbols in toks, from PACKED as bwt_packed() gives it."""
    ship(last.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, first, kinds = _symbols(batch.column("toks"))
            primary = batch.column("primary").to_numpy()
            for r, (i, j) in enumerate(pairwise(first.tolist())):
                if i < j:
                    codes[i:j] = unrotated(codes[i:j], int(primary[r]))
            yield _packed(batch.column("seq"), codes, first, kinds, primary)

    return last.select("seq", "toks", "primary").mapInArrow(work, PACKED)
