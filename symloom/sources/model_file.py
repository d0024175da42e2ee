"""Files of a byte-pair tokenizer: a magic, the number of symbols and of merges, the symbol of each byte, the bytes of each symbol and
the merges in order of rank. All numbers are little-endian; a symbol has at most 255 bytes.

Reading keeps to these rules: a merge that names a symbol beyond the vocabulary is passed over, but keeps its rank; of merges of
the same pair the first counts; symbols beyond POOL bytes in all are empty; a byte without a symbol (-1) reads as symbol 0."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The magic and the bytes that the symbols of a file may have in all.
MAGIC, POOL = b"BPET", 512 * 1024
SYMBOLS, MERGES, BYTES = "tok long, bytes binary", "l long, r long, m long, rank long", "byte long, tok long"


def pack(byte_symbols: list[int], symbols: list[bytes], merges: list[tuple[int, int, int]]) -> bytes:
    """The contents of a file."""
    head = MAGIC + struct.pack("<II", len(symbols), len(merges)) + struct.pack("<256i", *byte_symbols)
    return head + b"".join(bytes([len(s)]) + s for s in symbols) + b"".join(struct.pack("<III", *m) for m in merges)


def unpack(data: bytes) -> tuple[list[int], list[bytes], dict[tuple[int, int], tuple[int, int]]]:
    """The symbol of each byte, the bytes of each symbol, and pair -> (rank, merged symbol)."""
    if data[:4] != MAGIC or len(data) < 12 + 4 * 256:
        raise ValueError("not a tokenizer file")
    kinds, count = struct.unpack_from("<II", data, 4)
    of_byte, at, held, symbols = struct.unpack_from("<256i", data, 12), 12 + 4 * 256, 0, []
    for _ in range(kinds):
        size = data[at]
        fits = held + size < POOL
        symbols.append(data[at + 1 : at + 1 + size] if fits else b"")
        held, at = held + size * fits, at + 1 + size
    rows = np.frombuffer(data, "<u4", 3 * count, at).reshape(-1, 3)
    merges: dict = {}
    for rank in np.flatnonzero((rows < kinds).all(1)).tolist():
        left, right, made = rows[rank].tolist()
        merges.setdefault((left, right), (rank, made))
    return [max(t, 0) for t in of_byte], symbols, merges


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SYMBOLS, MERGES and BYTES of a file: dimension tables of at most the vocabulary's size."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    of_byte, symbols, merges = unpack(data)
    return (
        spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(symbols)], SYMBOLS),
        spark.createDataFrame([(a, b, m, rank) for (a, b), (rank, m) in merges.items()], MERGES),
        spark.createDataFrame(list(enumerate(of_byte)), BYTES),
    )


def base_symbols(tokens: DataFrame, of_byte: DataFrame) -> DataFrame:
    """seq, pos, tok: the symbol of each byte (byte: 0 to 255); bytes that the map lacks read as symbol 0."""
    found = tokens.join(F.broadcast(of_byte.select("byte", F.col("tok").alias("found"))), "byte", "left")  # 256 rows
    return found.select("seq", "pos", F.coalesce("found", F.lit(0)).alias("tok"))
