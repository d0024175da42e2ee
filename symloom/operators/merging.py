"""Byte-pair encoding of whole byte sequences with a table of merges; merges may cross any bytes, also white space.

The order of merging is defined: the pair of the lowest rank first, of equal ranks the leftmost, and only between symbols
that still stand next to each other."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.session import ship


def merge_table(pairs: DataFrame) -> DataFrame:
    """l, r, m, rank: of rows with the same pair the one of the lowest rank."""
    return pairs.groupBy("l", "r").agg(F.min(F.struct("rank", "m")).alias("b")).select("l", "r", "b.m", "b.rank")


def frequent_pairs(counts: DataFrame, n: int) -> DataFrame:
    """l, r, m, rank: the n most frequent adjacent pairs (l, r, n) as merges; new ids begin at 256. At most n rows."""
    top = counts.orderBy(F.col("n").desc(), "l", "r").limit(n)
    rank = (F.row_number().over(W.orderBy(F.col("n").desc(), "l", "r")) - 1).cast("long")
    return top.withColumn("rank", rank).select("l", "r", (F.col("rank") + 256).alias("m"), "rank")


def look_up(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """pairs (l, r, ...) with m and rank, null where no merge applies."""
    return pairs.join(merges, ["l", "r"], "left")


def encode_bytes(data: bytes, ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids of data; ranks: pair -> (rank, merged id)."""
    ids, n = list(data), len(data)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(hit[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := ranks.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (hit := ranks.get((ids[i], ids[j]))):
            heapq.heappush(heap, (hit[0], i, ids[i], ids[j]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j >= n or ids[j] != b:  # one of them has been merged since
            continue
        ids[i], ids[j], right[i] = ranks[a, b][1], -1, right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [x for x in ids if x >= 0]


def expansions(ranks: dict[tuple[int, int], tuple[int, int]]) -> dict[int, bytes]:
    """The bytes of each id."""
    out = {i: bytes([i]) for i in range(256)}
    for (a, b), (_, m) in sorted(ranks.items(), key=lambda kv: kv[1]):
        out[m] = out[a] + out[b]
    return out


def encode(docs: DataFrame, merges: DataFrame) -> DataFrame:
    """seq, ids and data (decoded from the ids) of each row's data (binary). merges: a vocabulary, so of bounded size."""
    ship(docs.sparkSession)
    ranks = {(r.l, r.r): (r["rank"], r.m) for r in merge_table(merges).collect()}

    def work(batches):
        shown = expansions(ranks)
        for rows in batches:
            ids = [encode_bytes(bytes(x) if x is not None else b"", ranks) for x in rows["data"]]
            yield pd.DataFrame({"seq": rows["seq"], "ids": ids, "data": [b"".join(map(shown.__getitem__, x)) for x in ids]})

    return docs.select("seq", "data").mapInPandas(work, "seq long, ids array<int>, data binary")
