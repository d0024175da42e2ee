"""Streaming form of the code-length models: a scored row for each event, with state kept for each sequence.

State: the counts of the symbols that a sequence has had; with contexts also the counts after each context, the last-match table
and the last symbols. The alphabet is fixed up front, as a stream has no end to read it from.

Events of a sequence are scored in order of (ts, event_id) within a micro-batch. An event that comes in a later micro-batch than
a later one is scored when it comes, after those, and told by late: what has been given out is not changed. A sequence may come
in several Arrow batches; events without a user are a sequence of their own, symbols beyond the alphabet are refused."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symloom.operators.mixing import Coder
from symloom.session import ship

SCORED = "seq long, event_id long, bits double, late boolean"
ALPHABET = ("click", "error", "purchase", "signup", "view")


class CountCoder(Coder):
    """The same from prior counts alone."""

    class _Nothing:
        number: dict = {}

        def deltas(self) -> dict:
            return {}

        def learn(self, t) -> None:
            pass

    def __init__(self, alphabet: list):
        super().__init__(alphabet)
        self.model = self._Nothing()


def score(events: DataFrame, alphabet: tuple[str, ...] = ALPHABET, contexts: bool = False) -> DataFrame:
    """events (user_id, ts, event_id, event_type), a stream -> SCORED."""
    ship(events.sparkSession)
    known = sorted(alphabet)

    def step(key, batches, state: GroupState):
        coder, last = pickle.loads(state.get[0]) if state.exists else ((Coder if contexts else CountCoder)(known), None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        if not set(rows["event_type"]) <= set(known):
            raise ValueError("a symbol beyond the alphabet")
        out = []
        for ts, event_id, tok in zip(rows["ts"], rows["event_id"], rows["event_type"]):
            late = last is not None and (ts, event_id) < last
            out.append((key[0], event_id, coder.bits(tok), late))
            last = last if late else (ts, event_id)
        state.update((pickle.dumps((coder, last)),))
        yield pd.DataFrame(out, columns=["seq", "event_id", "bits", "late"])

    rows = events.select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, SCORED, "model binary", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, path: str, out: str, checkpoint: str, contexts: bool = False, files: int = 1000) -> DataFrame:
    """Scores what is at path (Parquet files of events, so many in a micro-batch, oldest first) as a stream and reads the result
    back. The sink is Parquet with a checkpoint, so a run that stops goes on where it was."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    query = score(stream, contexts=contexts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SCORED).parquet(out).select("seq", "event_id", F.round("bits", 6).alias("bits"), "late")
