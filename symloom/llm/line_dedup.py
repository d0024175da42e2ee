"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; its hash has 128 bits. The index holds each hash
once, in the run of the batch that had it first: every new batch is merge-anti-joined with the runs, which tells the keys never
seen before (they make the batch's run) from those known (they make a run of increments). FAN_OUT runs of a level are compacted
into one of the next, runs of keys by a merge of disjoint keys, runs of increments by a merge that adds. A key's count is what
its run says plus its increments.

Runs are tables bucketed and sorted by the hash, one file a bucket, in the shared folder. Batches are dealt once into the same
buckets; anti-joins, compaction and counting then merge sorted files bucket by bucket, without shuffling or sorting a run.

Empty keys are never counted or dropped. Only DataFrame operations are used: text is split and hashed in place, only hashes
and line numbers move until the verdicts come back.

Cases: null and empty texts are one empty line; a document counts once for a key, however often it has the line; repeated
rows are documents of their own; ties cannot arise; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import BLANKS, ascii_lower, fresh_name, long_hash, materialize, new_path, remove, table, text_of

FAN_OUT, BATCHES, MIN_DOCS, MIN_CHARS, BUCKET_ROWS = 3, 4, 10, 1, 2_000_000
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    return F.struct(long_hash(key, 1).alias("h1"), long_hash(key, 2).alias("h2"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """The levels of sorted runs of one index: keys (each key in one run only) and increments."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, buckets: int | None = None):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys: list[list[str]] = []
        self.more: list[list[str]] = []
        self.stale: list[str] = []  # compacted runs, dropped when the next batch comes
        # A bucket is one sorted file, so its order may be relied on.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _table(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        out = rows.select(*KEY, "n_docs").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("compression", "zstd")
        out.option("path", new_path(self.spark, name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, path)

    def _put(self, levels: list[list[str]], level: int, name: str) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) >= self.fan_out:
            full, levels[level] = levels[level], []
            self._put(levels, level + 1, self._table(self._merged(full, levels is self.more)))
            self.stale += full

    def _merged(self, names: list[str], add: bool = False) -> DataFrame:
        """One sorted merge of runs. Runs of keys have no key in common; those of increments are added up."""
        out = self.spark.table(names[0])
        for x in names[1:]:
            other = self.spark.table(x).select(*KEY, F.col("n_docs").alias("other"))
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("other", F.lit(0)) if add else F.coalesce("n_docs", "other")
            out = out.join(other.hint("merge"), KEY, "full_outer").select(*KEY, n.alias("n_docs"))
        return out

    def runs(self) -> list[str]:
        return [x for level in self.keys for x in level]

    def increments(self) -> list[str]:
        return [x for level in self.more for x in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a dealt batch whose key no run holds: a sorted merge against each run."""
        for x in self.runs():
            batch = batch.join(self.spark.table(x).select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch (h1, h2, n_docs; a key may come in several rows) and returns the keys that no earlier batch had, with
        their counts in this one."""
        self._clean()
        batch = self._table(keys.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs")).repartition(self.buckets, *KEY))
        fresh = self._table(self.unseen(self.spark.table(batch)))
        if self.runs():
            known = self.spark.table(batch).join(self.spark.table(fresh).select(*KEY).hint("merge"), KEY, "left_anti")
            self._put(self.more, 0, self._table(known))
        out = self.spark.table(fresh)
        self._drop(batch)
        self._put(self.keys, 0, fresh)
        return out

    def counts(self) -> DataFrame:
        """h1, h2, n_docs of all keys: every run with the increments of its keys."""
        out = []
        for x in self.runs():
            rows = self.spark.table(x)
            for y in self.increments():
                other = self.spark.table(y).select(*KEY, F.col("n_docs").alias("other"))
                rows = rows.join(other.hint("merge"), KEY, "left").select(*KEY, (F.col("n_docs") + F.coalesce("other", F.lit(0))).alias("n_docs"))
            out.append(rows)
        return reduce(DataFrame.unionByName, out)

    def _clean(self) -> None:
        while self.stale:
            self._drop(self.stale.pop())

    def close(self) -> None:
        """Drops all runs."""
        self.stale += self.runs() + self.increments()
        self.keys, self.more = [], []
        self._clean()


def lines_of(texts: DataFrame, text: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key has min_chars characters: the columns of texts, at (the line's number), h1, h2."""
    keyed = F.transform(split_lines(text), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("at")))
    keyed = F.filter(keyed, lambda x: F.length(x["k"]) >= min_chars)
    hashed = F.transform(keyed, lambda x: F.struct(x["at"].alias("at"), key_hash(x["k"]).alias("h")))
    return texts.select(*texts.columns, F.explode(hashed).alias("_k")).select(*texts.columns, "_k.at", "_k.h.h1", "_k.h.h2")


def index(docs: DataFrame, batches: int = BATCHES) -> tuple[LineRuns, DataFrame]:
    """The runs of all documents, added batch after batch, and the keys of each distinct text: t1, t2, h1, h2, lines (their
    numbers), n (documents that have the text)."""
    spark, t = docs.sparkSession, text_of()
    named = docs.select(long_hash(t, 3).alias("t1"), long_hash(t, 4).alias("t2"), t.alias("text"))
    rows = lines_of(named, F.col("text")).groupBy("t1", "t2", *KEY).agg(F.collect_set("at").alias("lines"), F.count(F.lit(1)).alias("c"))
    # Every copy of a text has the key in the same lines.
    rows = materialize(rows.select("t1", "t2", *KEY, "lines", (F.col("c") / F.size("lines")).cast("long").alias("n")), "line-keys")
    wide = -(-rows.count() // BUCKET_ROWS)
    runs = LineRuns(spark, buckets=max(int(spark.conf.get("spark.sql.shuffle.partitions")), wide))
    for b in range(batches):
        batch = rows.where(F.pmod("t2", F.lit(batches)) == b)
        runs.add(batch.select(*KEY, F.col("n").alias("n_docs")))
    return runs, rows


def flags(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """t1, t2, bad: the numbers of the lines whose keys at least min_docs documents have, for each distinct text with some."""
    runs, rows = index(docs, batches)
    # A written table, so that a very frequent key on the other side can be split among tasks.
    often = materialize(runs.counts().where(F.col("n_docs") >= min_docs).select(*KEY), "line-often")
    runs.close()
    return rows.join(often, KEY).groupBy("t1", "t2").agg(F.flatten(F.collect_list("lines")).alias("bad"))


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with further columns: lines (all), kept (those that stay)."""
    t = text_of(text)
    t1, t2, bad = (fresh_name(docs, x) for x in ("t1", "t2", "bad"))
    # Written, so that the rows of a text with very many copies can be split among tasks.
    found = materialize(flags(docs.select(F.col(text).alias("text")), min_docs, batches), "line-flags").toDF(t1, t2, bad)
    both = docs.withColumns({t1: long_hash(t, 3), t2: long_hash(t, 4)}).join(found, [t1, t2], "left")
    split = split_lines(t)
    # Numbers that stay, by hashing: as many steps as the text has lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(bad))
    kept = F.when(F.col(bad).isNull(), split).otherwise(F.transform(stay, lambda i: F.get(split, i)))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], split.alias(fresh_name(docs, "lines")), kept.alias(fresh_name(docs, "kept")))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.encode(F.array_join("kept", "\n"), "UTF-8"), 256).alias("kept_sha256"),
    )


def without_lines(docs: DataFrame) -> DataFrame:
    """docs whose texts lack the lines that many documents have; null texts stay null."""
    out = drop_lines(docs)
    kept = out.columns[-1]
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM often))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM often)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""
