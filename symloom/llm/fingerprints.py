"""Document fingerprints by MinHash: universal hash permutations over word shingles, vectorised in numpy.

A permutation is a * x + b modulo 2^32 with odd a over the 32 leading bits of a shingle's identifier. The fingerprint is
the 16 leading bits of a hash of each of the PERMUTATIONS minima, in hexadecimal; the likeness of two fingerprints is the
share of equal values, corrected for values that are equal by chance.

Documents that have a band of minima in common are compared in Spark, all members of a bucket that links have not joined yet (see
linking), and Jaccard similarity of five-word shingles is verified on the full sets. Verified links make groups; a pair of similarity
0.8 meets in none of 32 bands of 4 with odds of 5e-8, so a link is as good as never missed, and none is wrong.

The neighbour of a document is the next one in descending order of doc_id (nulls last, equal ids by a hash of the text),
after the last the first. Texts lie in chunks; neighbours are found on rows of a few bytes in sorted ranges, which split rows of one
id too, and of a neighbour's text only the part that the edited text takes is sent.

Cases: null and empty texts and texts without words have the fingerprint of the empty set, which is fully like itself and
like no other, and are a group each; texts of fewer words than a shingle have one shingle; equal texts have equal fingerprints; a
single row is its own neighbour; repeated rows follow one another and are one group; a group's number is the least doc_id in it, null if
all are null; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from symloom.llm import arrays as A
from symloom.llm.chunks import Store, by_chunk, deal
from symloom.llm.common import begin, long_hash, materialize, new_path, ship, table, text_of
from symloom.llm.linking import components
from symloom.llm.minhash_dedup import digests, sets_of

PERMUTATIONS, WORDS, BANDS, PERCENT = 128, 5, 32, 80
_rng = np.random.default_rng(99)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
SKETCH = "uid long, doc_id long, h long, chunk string, idx int, n long, n_chars long, d1 long, d2 long, keys array<long>"
NEXT = "chunk string, idx int, group_id long, begun binary, theirs binary"
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, group_id long"


def minima(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least value of each permutation over each set; the greatest 32-bit value for empty sets."""
    out = np.full((len(first) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        x, starts = (ids >> np.uint64(32)).astype(np.uint32), first[full]
        for k in range(PERMUTATIONS):
            out[full, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return out


def signatures(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """16-bit fingerprint values of each text."""
    parts = [np.zeros((0, PERMUTATIONS), np.uint16)]
    for _, _, d, o in A.pieces(data, offsets, 1 << 18):
        low = minima(*A.shingle_sets(d, o, words)).astype(np.uint64)
        parts.append((A.mix(low + np.arange(PERMUTATIONS, dtype=np.uint64) * A.ODD[3]) >> np.uint64(48)).astype(np.uint16))
    return np.concatenate(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chance = 2.0**-16
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def shown(values: np.ndarray) -> list[str]:
    return [v.tobytes().hex() for v in values.astype(">u2")]


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of each text, in hexadecimal."""

    @arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(shown(signatures(*A.flat(column), words)), pa.string())

    return of(text)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of minima."""
    keys = np.full((len(low), BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64) * A.ODD[50]
    for r in range(PERMUTATIONS // BANDS):
        keys = A.mix(keys + low[:, r * BANDS : (r + 1) * BANDS].astype(np.uint64) * A.ODD[r])
    return keys


def sketches(docs: DataFrame, uri: str, words: int) -> DataFrame:
    """Deals docs (doc_id, text, h) into chunks below uri and gives a row of SKETCH for each."""

    def scan(batches):
        from pyspark import TaskContext

        for name, row, rows in deal(batches, "text"):
            Store(uri).put_table(name, rows.select(["doc_id", "text"]))
            data, offsets = A.flat(rows["text"])
            parts = [A.shingle_sets(d, o, words) for _, _, d, o in A.pieces(data, offsets, 1 << 18)]
            keys = np.concatenate([band_keys(minima(*p)) for p in parts]).view(np.int64)
            d1, d2 = map(np.concatenate, zip(*(digests(*p) for p in parts)))
            columns = [
                pa.array((TaskContext.get().partitionId() << 33) + row + np.arange(len(rows))),
                rows["doc_id"].combine_chunks(), rows["h"].combine_chunks(), pa.array([name] * len(rows), pa.string()), pa.array(np.arange(len(rows)), pa.int32()),
                pa.array(np.concatenate([np.diff(f) for _, f in parts])), pa.array(A.per_text((data & 0xC0) != 0x80, offsets)), pa.array(d1), pa.array(d2),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    return materialize(docs.mapInArrow(scan, SKETCH), "fingerprint-sketch")


def groups(sketched: DataFrame, uri: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """uid and group_id, the least doc_id of those linked with it, for each row with shingles."""
    real = sketched.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("m")
    reps = materialize(real.groupBy("d1", "d2").agg(least).select("d1", "d2", "m.none", F.col("m.doc_id").alias("lead"), F.col("m.uid").alias("rep")), "fingerprint-reps")
    items = sketched.join(reps.select(F.col("rep").alias("uid")), "uid").select("uid", "chunk", "idx", "keys")

    def load(chunk: str, idx: np.ndarray) -> list[bytes]:
        data, offsets = A.flat(Store(uri).table(chunk)["text"].take(pa.array(idx)))
        raw, press = memoryview(np.ascontiguousarray(data)), zstandard.ZstdCompressor(level=3)
        return [press.compress(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def unpack(held: list[bytes]):
        press = zstandard.ZstdDecompressor()
        return sets_of([press.decompress(x) for x in held], words)

    linked = lambda both, union: 100 * both >= percent * union
    # Members of a bucket are likely linked as it is: nothing but their sets is asked.
    roots = components(items, load, unpack, linked, lambda pairs: pairs, items.select("uid"), lambda _, open_: open_.any(1)).withColumnRenamed("uid", "rep")
    named = materialize(reps.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "fingerprint-named")
    best = named.groupBy("root").agg(F.min(F.struct("none", "lead")).alias("m")).select("root", F.col("m.lead").alias("group_id"))
    found = materialize(named.join(best, "root").select("d1", "d2", "group_id"), "fingerprint-groups")
    return real.select("uid", "d1", "d2").join(found, ["d1", "d2"]).select("uid", "group_id")


def _neighbours(sketched: DataFrame) -> DataFrame:
    """chunk, idx of each row's neighbour (as next_chunk, next_idx), with the row's uid, chunk, idx, n_chars."""
    spark = sketched.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("uid")]
    small = sketched.select("doc_id", "h", "uid", "chunk", "idx", "n_chars")
    dealt = small.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "fingerprint-order")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.expr("~doc_id").alias("down"), "h", "uid", "chunk", "idx")).alias("m")
    firsts = dealt.groupBy("range").agg(first).select("range", F.struct("m.chunk", "m.idx").alias("m"))  # a row for each range
    by = W.orderBy("range")
    then = F.coalesce(F.lead("m").over(by), F.first("m").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    firsts = firsts.select("range", then.alias("after"))
    nxt = F.lead(F.struct("chunk", "idx")).over(W.partitionBy("range").orderBy(*order))
    rows = dealt.withColumn("next", nxt).join(F.broadcast(firsts), "range")
    to = F.coalesce("next", "after")
    return rows.select("uid", "chunk", "idx", "n_chars", to["chunk"].alias("next_chunk"), to["idx"].alias("next_idx"))


def with_edited(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """EDITED for each document."""
    spark = docs.sparkSession
    ship(spark)
    uri = new_path(spark, "fingerprint-chunks")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", long_hash(F.col("text"), 5))
    sketched = sketches(slim, uri, words)
    alone = sketched.where("n = 0").select("uid", F.col("doc_id").alias("group_id"))
    named = groups(sketched, uri, words, percent).unionByName(alone)
    asked = _neighbours(sketched).join(named, "uid")
    asked = asked.select(F.col("next_chunk").alias("chunk"), F.col("next_idx").alias("idx"), F.expr("n_chars div 3").alias("want"), F.col("chunk").alias("to"), F.col("idx").alias("to_idx"), "group_id")
    asked = materialize(asked, "fingerprint-asked")
    n = -(-asked.count() // 500)  # chunks, about

    def begun(rows: pa.Table) -> pa.Table:
        """What the askers take of their neighbours' texts, and the neighbours' fingerprints."""
        begin("fingerprints")
        texts = Store(uri).table(rows["chunk"][0].as_py())["text"].take(rows["idx"].combine_chunks())
        theirs, press = signatures(*A.flat(texts), words), zstandard.ZstdCompressor(level=6)
        parts = [press.compress(t[:k].encode()) for t, k in zip(texts.to_pylist(), rows["want"].to_pylist())]
        return pa.table([rows["to"], rows["to_idx"], rows["group_id"], pa.array(parts, pa.binary()), pa.array([x.tobytes() for x in theirs], pa.binary())], names=["chunk", "idx", "group_id", "begun", "theirs"])

    def finish(rows: pa.Table) -> pa.Table:
        held = Store(uri).table(rows["chunk"][0].as_py()).take(rows["idx"].combine_chunks())
        texts, press = held["text"].to_pylist(), zstandard.ZstdDecompressor()
        own = signatures(*A.flat(held["text"]), words)
        theirs = np.frombuffer(b"".join(rows["theirs"].to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
        edited = [t[: len(t) - len(t) // 3] + press.decompress(x).decode() for t, x in zip(texts, rows["begun"].to_pylist())]
        other = signatures(*A.flat(pa.array(edited, pa.large_string())), words)
        columns = [
            held["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(shown(own), pa.string()), pa.array(shown(other), pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, theirs)), rows["group_id"],
        ]
        return pa.table(columns, names=[x.split()[0] for x in EDITED.split(", ")])

    sent = by_chunk(asked, n).applyInArrow(begun, NEXT)
    return by_chunk(sent, n).applyInArrow(finish, EDITED)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
