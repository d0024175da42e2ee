"""MinHash near-dedup by SetSketch registers.

A register holds the exponentially spaced, truncated minimum of the hash values that the shingles of a text draw for it:
floor(1 - log_b x), within 0 and q + 1. Registers of a union are the maxima of the registers, and two texts agree in a
register with a probability near their Jaccard similarity. Bands of registers are the keys under which texts meet; the
joint likelihood of the registers that are larger, smaller and equal estimates the similarity of those that meet, and
what is not clearly below the threshold is verified on the full sets of shingles (see linking).

Texts with equal sets are one item from the start. Words are maximal runs without white space of the text in ASCII lower
case; a set holds the distinct shingles of K words, one shingle of all words for shorter texts, nothing for texts without
words, which are linked with nothing.

Cases: null and empty texts have empty sets and stay by themselves; very long texts are worked off in memory of a few
times their size; repeated rows (equal texts, equal doc_ids or both) are items of one group, of which one row is kept;
a null doc_id comes after all others; a tie of doc_ids goes to the first row of the input; an empty table gives an empty
result; other columns, whatever their names, pass through keep_one().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from symloom.llm import arrays as A
from symloom.llm.chunks import Store, by_chunk, deal
from symloom.llm.common import materialize, new_path, ship, table
from symloom.llm.linking import components

#: 42 bands of 6 registers: a pair of similarity 0.8 meets in none with odds of 3e-6, one of 0.3 in some with odds of 0.03.
REGISTERS, BASE, RATE, TOP, BANDS = 252, 1.001, 20.0, 65534, 42
U = np.uint64
SKETCH = "uid long, doc_id long, chunk string, idx int, n long, d1 long, d2 long, keys array<long>, registers binary"


def set_sketch(ids: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The registers of each set. An element draws ascending values with the spacings of m exponential variables, for
    registers in an order of its own, and stops once a value cannot raise any register of its set."""
    n = len(first) - 1
    registers = np.zeros(n * m, np.uint16)
    text = A.owner(first)
    x = np.zeros(len(ids))
    start = A.mix(ids ^ U(0x5851F42D4C957F2D))
    # An element visits the registers in its own order: stepping by a stride that shares no factor with their number.
    strides = np.array([k for k in range(1, m) if np.gcd(k, m) == 1] or [1], np.uint64)
    stride = strides[((start >> U(20)) % U(len(strides))).astype(np.int64)]
    steps = np.arange(1, m + 1, dtype=np.uint64) * A.ODD[62]
    floor = np.zeros(n, np.uint16)
    for j in range(m):
        if not len(ids):
            break
        u = ((A.mix(ids + steps[j]) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (RATE * (m - j))
        k = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
        go = k > floor[text]
        if not go.all():
            ids, text, x, start, stride, k = (v[go] for v in (ids, text, x, start, stride, k))
        at = text * m + ((start + U(j) * stride) % U(m)).astype(np.int64)
        np.maximum.at(registers, at, k)
        floor = registers.reshape(n, m).min(1)
    return registers.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band of registers."""
    rows = registers.shape[1] // bands
    out = np.full((len(registers), bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64) * A.ODD[55]
    for r in range(rows):
        out = A.mix(out + registers[:, r::rows][:, :bands].astype(np.uint64) * A.ODD[r])
    return out


def likeness(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity of greatest joint likelihood, for registers a, b of sets of na, nb elements."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / np.maximum(na + nb, 1))[:, None]
    v = 1 - u
    j = np.minimum(np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12)), 1) * np.linspace(0, 1, 401)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    chance = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    best = chance.argmax(1)
    return j[np.arange(len(j)), best]


def digests(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(np.ascontiguousarray(ids)).cast("B")
    both = b"".join(hashlib.blake2b(raw[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(first[:-1].tolist(), first[1:].tolist()))
    both = np.frombuffer(both, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def registers_and_keys(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    registers = set_sketch(ids, first)
    return registers, band_keys(registers)


def sets_of(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingles of texts: ids and where each begins."""
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    parts = [A.shingle_sets(d, o, words) for _, _, d, o in A.pieces(data, offsets)]
    sizes = np.concatenate([np.diff(f) for _, f in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(sizes)])


def sketches(docs: DataFrame, words: int, uri: str, text: str, doc_id: str) -> DataFrame:
    """Deals docs into chunks below uri and gives a row of SKETCH for each document."""

    def scan(batches):
        for name, row, rows in deal(batches, text):
            from pyspark import TaskContext

            Store(uri).put_table(name, rows)
            uid = (TaskContext.get().partitionId() << 33) + row + np.arange(len(rows))
            data, offsets = A.flat(rows[text])
            parts = [A.shingle_sets(d, o, words) for _, _, d, o in A.pieces(data, offsets)]
            registers, keys = map(np.concatenate, zip(*(registers_and_keys(*p) for p in parts)))
            d1, d2 = map(np.concatenate, zip(*(digests(*p) for p in parts)))
            n = np.concatenate([np.diff(f) for _, f in parts])
            keys = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), rows[doc_id].combine_chunks().cast(pa.int64()), pa.array([name] * len(rows)), pa.array(np.arange(len(rows)), pa.int32()), pa.array(n), pa.array(d1), pa.array(d2)]
                + [pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel()), pa.array([r.tobytes() for r in registers], pa.binary())],
                names=["uid", "doc_id", "chunk", "idx", "n", "d1", "d2", "keys", "registers"],
            )

    return materialize(docs.mapInArrow(scan, SKETCH), "minhash-sketch")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", uri: str | None = None) -> DataFrame:
    """chunk, idx, uid, doc_id, n, component_id (least doc_id of those reachable by links) and first: whether the row is
    the one of its group that stays. Links: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    ship(spark)
    if uri is None:  # else the chunks hold all columns, for a caller that reads them again
        uri, docs = new_path(spark, "minhash-chunks"), docs.select(doc_id, text)
    sketched = sketches(docs, words, uri, text, doc_id)
    real = sketched.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("m")
    reps = materialize(real.groupBy("d1", "d2").agg(least).select("d1", "d2", F.col("m.doc_id").alias("lead"), F.col("m.uid").alias("rep")), "minhash-reps")
    items = sketched.join(reps.select(F.col("rep").alias("uid")), "uid").select("uid", "chunk", "idx", "keys")

    def load(chunk: str, idx: np.ndarray) -> list[bytes]:
        """The texts, compressed: they take less room than their sets."""
        data, offsets = A.flat(Store(uri).table(chunk)[text].take(pa.array(idx)))
        raw, press = memoryview(np.ascontiguousarray(data)), zstandard.ZstdCompressor(level=3)
        return [press.compress(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def unpack(held: list[bytes]):
        press = zstandard.ZstdDecompressor()
        return sets_of([press.decompress(x) for x in held], words)

    def linked(both, union):
        return 100 * both >= percent * union

    # The estimate's standard deviation is at most (0.8 * 0.2 / REGISTERS)^0.5, some 0.025; 5 of them below the threshold is out.
    lowest = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    @arrow_udf("double")
    def estimate(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        ra, rb = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (a, b))
        na, nb = na.to_numpy(), nb.to_numpy()
        out = [likeness(ra[i : i + 2048], rb[i : i + 2048], na[i : i + 2048], nb[i : i + 2048]) for i in range(0, len(ra), 2048)]
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    def likely(pairs: DataFrame) -> DataFrame:
        one = sketched.select("uid", F.col("registers").alias("ra"), F.col("n").alias("na"))
        two = sketched.select(F.col("uid").alias("pivot"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
        return pairs.join(one, "uid").join(two, "pivot").where(estimate("ra", "rb", "na", "nb") >= lowest).select("uid", "pivot")

    def near(columns: dict, open_: np.ndarray) -> np.ndarray:
        """Members whose best partner, by equal registers, among the open ones is likely to be linked."""
        registers, n = np.frombuffer(b"".join(columns["registers"]), np.uint16).reshape(-1, REGISTERS), np.array(columns["n"])
        same = np.array([(registers == r).sum(1) for r in registers])
        same[~open_] = -1
        best = same.argmax(1)
        rough = same[np.arange(len(n)), best]
        fine = likeness(registers, registers[best], n, n[best])
        return (rough >= 0) & ((fine >= lowest) | (rough >= lowest * REGISTERS))

    held = sketched.select("uid", "registers", "n")
    roots = components(items, load, unpack, linked, likely, held, near).withColumnRenamed("uid", "rep")
    named = reps.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = materialize(named, "minhash-named")
    best = F.min(F.struct(F.col("lead").isNull().alias("none"), "lead", "rep")).alias("m")
    groups = named.groupBy("root").agg(best).select("root", F.col("m.lead").alias("component_id"), F.col("m.rep").alias("kept_uid"))
    found = materialize(named.join(groups, "root").select("d1", "d2", "component_id", "kept_uid"), "minhash-found")
    rows = sketched.select("chunk", "idx", "uid", "doc_id", "n", "d1", "d2")
    full = rows.where("n > 0").join(found, ["d1", "d2"]).withColumn("first", F.col("uid") == F.col("kept_uid"))
    none = rows.where("n = 0").select("*", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    cols = ["chunk", "idx", "uid", "doc_id", "n", "component_id", "first"]
    return full.select(cols).unionByName(none.select(cols))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs, words=4)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns as they were."""
    spark = docs.sparkSession
    ship(spark)
    uri = new_path(spark, "minhash-chunks")
    # Chunks hold whole rows under names of their own, so that any column names pass through.
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = near_duplicates(inner, words, percent, name["text"], name["doc_id"], uri).where("first").select("chunk", "idx")

    def read(rows: pa.Table) -> pa.Table:
        idx = np.sort(rows["idx"].to_numpy())
        return Store(uri).table(rows["chunk"][0].as_py()).take(pa.array(idx))

    return by_chunk(kept, 0).applyInArrow(read, inner.schema).toDF(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.a = d.doc_id
"""
