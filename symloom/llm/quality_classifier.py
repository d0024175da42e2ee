"""Quality classifier by compression: zstandard dictionaries built from good and from bad labelled text. The difference
between the two compressed sizes, normalised by the text's size, becomes a calibrated score.

Texts are worked off in even blocks of at most BLOCK bytes, in fitting as in scoring, and always whole. The model is fitted on
a bounded, documented sample: at most FIT_BLOCKS blocks of either class, those of the smallest hash of doc_id and block
number among all blocks of all labelled texts. The curve (logistic, over the difference alone) is fitted crosswise: either half
of the sample is scored by dictionaries of the other, so that no block meets a dictionary that holds it. The dictionaries that
are used then come from all of the sample. A text's evidence (log-odds) is the mean of its blocks', weighted by their bytes.

Cases: null and empty texts get the share of good rows among the labelled rows; with fewer than 4 blocks of either class every
text gets that share too (0.5 without any label), and keep_good() rejects nothing. Labels that are null are not used; of
different labels of a doc_id the lower one counts. Repeated rows each get a score, equal texts the same one; an empty table gives
an empty result; other columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from symloom.llm import arrays as A
from symloom.llm.common import begin, long_hash, ship, table

FIT_BLOCKS, BLOCK, DICT_BYTES, LEVEL = 4000, 1024, 65536, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for d in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(d)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
        return out


def _blocks(n: int) -> list[tuple[int, int]]:
    """The bounds of even blocks of at most BLOCK bytes of n bytes."""
    k = -(-n // BLOCK)
    return [(n * j // k, n * (j + 1) // k) for j in range(k)]


def _sizes(blocks: list, compressors: list) -> np.ndarray:
    """Bytes of each block, and compressed with either dictionary."""
    return np.array([[len(t), *(len(c.compress(t)) for c in compressors)] for t in blocks], float).reshape(-1, 3)


def _features(sizes: np.ndarray) -> np.ndarray:
    """1, and the difference per byte; short blocks weigh less."""
    n, good, bad = (sizes[:, k] for k in range(3))
    return np.stack([np.ones(len(n)), (bad - good) / (n + 100)], 1)


def _curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge, on scaled columns."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return list(w / scale)


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts for the trainer: the text itself
        return b"".join(texts)[-DICT_BYTES:] or b" " * 8


def fit_model(good: list[bytes], bad: list[bytes]) -> Model:
    """A model of labelled texts."""
    total = len(good) + len(bad)
    if len(good) < 4 or len(bad) < 4:
        return Model(b"", b"", [], len(good) / total if total else 0.5)
    halves = [(good[k::2], bad[k::2]) for k in (0, 1)]
    rows, marks = [], []
    for own, other in (halves, halves[::-1]):
        held = Model(_dictionary(own[0]), _dictionary(own[1]), [], 0.5).compressors()
        rows.append(_features(_sizes(other[0] + other[1], held)))
        marks += [1.0] * len(other[0]) + [0.0] * len(other[1])
    return Model(_dictionary(good), _dictionary(bad), _curve(np.concatenate(rows), np.array(marks)), len(good) / total)


def scores(model: Model, texts: list) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    cuts = [_blocks(len(t)) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
    sizes = _sizes([t[i:j] for t, c in zip(texts, cuts) for i, j in c], model.compressors())
    evidence = np.bincount(of, _features(sizes) @ np.array(model.weights) * sizes[:, 0], minlength=len(texts))
    n = np.array([len(t) for t in texts])
    p = 1 / (1 + np.exp(-np.clip(evidence / np.maximum(n, 1), -30, 30)))
    return np.where(n > 0, p, model.prior)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """quality, rank, doc_id, block, text (bytes) of the blocks that the model is fitted on, and the labelled rows that they come
    from, which are never held out ones."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Blocks are drawn by number, so that of the texts only the drawn ones' bytes move.
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("n")).where("n > 0").distinct().join(marked, "doc_id")
    k = F.ceil(F.col("n") / BLOCK)
    blocks = sized.select("*", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("block"))
    blocks = blocks.withColumn("rank", long_hash(F.concat_ws(":", F.col("doc_id"), F.col("n"), F.col("block")), 11))
    order = ["rank", "doc_id", "n", "block"]
    drawn = [blocks.where(F.col("quality") == q).orderBy(order).limit(FIT_BLOCKS) for q in (1, 0)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]).withColumnRenamed("n", "size"))  # at most 2 * FIT_BLOCKS rows
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    both = raw.join(drawn, "doc_id").where(F.length("raw") == F.col("size"))
    begin, end = (F.expr(f"size * (block + {i}) div k").cast("int") for i in (0, 1))
    cut = both.select(*[c for c in drawn.columns], F.substring("raw", begin + 1, end - begin).alias("text"))
    return cut.groupBy(drawn.columns).agg(F.min("text").alias("text")), marked


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labelled rows that are not held out. docs: doc_id, text; labels: doc_id, quality."""
    drawn, marked = sample(docs, labels)
    rows = sorted(drawn.collect(), key=lambda r: (r["rank"], r.doc_id, r["size"], r.block))  # at most 2 * FIT_BLOCKS blocks
    sides = [[bytes(r.text) for r in rows if r.quality == q] for q in (1, 0)]
    shares = {r.quality: r["count"] for r in marked.groupBy("quality").count().collect()}
    model = fit_model(*sides)
    if shares:
        model.prior = shares.get(1, 0) / sum(shares.values())
        if model.weights:  # the sample has other shares than the labels: shift the curve to theirs
            drawn_odds = len(sides[0]) / len(sides[1])
            true = shares.get(1, 0) / max(shares.get(0, 0), 1)
            model.weights[0] += float(np.log(max(true, 1e-6) / drawn_odds))
    return model


def quality_score(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1, higher where a good label is likelier."""

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        begin("quality")
        data, offsets = A.flat(column)
        raw = memoryview(data)
        return pa.array(scores(model, [raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]))

    return score(text)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns. Without enough labels none is rejected."""
    ship(docs.sparkSession)
    model = fit(docs, labels)
    return docs.where(quality_score(F.col("text"), model) >= 0.5) if model.weights else docs
