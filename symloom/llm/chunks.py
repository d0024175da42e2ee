"""Chunks: rows of a table dealt into files of a few MB in the shared folder, so that later passes read just the chunks
that they need, by name, without moving texts through a shuffle. And the counting of identifiers over all chunks.

A chunk file is named by its task, its place in it and a digest of its rows. It is written under a temporary name and
renamed; a task that runs again writes the same files. Files are reached through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 22


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class Store:
    """Files of one operator run below a URI of the shared folder."""

    def __init__(self, uri: str):
        self.uri = uri

    def put(self, name: str, writer) -> None:
        """Lets writer(stream) write a file under a temporary name, then renames it."""
        fs, root = _open(self.uri)
        fs.create_dir(root, recursive=True)
        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            writer(out)
        fs.move(temporary, f"{root}/{name}")

    def put_table(self, name: str, rows: pa.Table) -> None:
        def write(out) -> None:
            with pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows)

        self.put(name, write)

    def table(self, name: str) -> pa.Table:
        fs, root = _open(self.uri)
        with fs.open_input_file(f"{root}/{name}") as f:
            return pa.ipc.open_file(f).read_all().combine_chunks()

    def bytes(self, name: str) -> pa.Buffer:
        fs, root = _open(self.uri)
        with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
            return f.read()


def deal(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[str, int, pa.Table]]:
    """(name, number of the first row in the task's rows, rows) of each chunk of a task."""
    from pyspark import TaskContext

    from symloom.llm import arrays as A
    from symloom.llm.common import begin

    begin("chunks")
    task, seq, row = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        data, offsets = A.flat(batch.column(batch.schema.get_field_index(text)))
        for i, j, d, _ in A.pieces(data, offsets, limit):
            digest = hashlib.blake2b(d, digest_size=6).hexdigest()
            yield f"{task:06d}-{seq:06d}-{digest}", row, pa.Table.from_batches([batch.slice(i, j - i)])
            seq, row = seq + 1, row + j - i


PACKED = "chunk string, part int, ids binary, many binary"
FLAGGED = "chunk string, part int, again binary, first binary"


def pack(chunk: str, ids: np.ndarray, parts: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The distinct ids of a chunk dealt by their leading bits into parts, with a bit each for ids that the chunk has more
    than once; and each id's place among the distinct ones."""
    distinct, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    part = part_of(distinct, parts)
    edge = np.searchsorted(part, np.arange(parts + 1))
    used = np.flatnonzero(np.diff(edge))
    rows = [(distinct[edge[p] : edge[p + 1]].tobytes(), np.packbits(count[edge[p] : edge[p + 1]] > 1).tobytes()) for p in used]
    columns = [pa.array([chunk] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "ids", "many"]), place


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _judge(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("chunk")
    lists = [np.frombuffer(x, np.uint64) for x in rows["ids"].to_pylist()]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ids = np.concatenate(lists)
    again = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(rows["many"].to_pylist(), lists)]).astype(bool)
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = np.ones(len(ids), bool)
    first[order[1:][same]] = False
    bits = [[np.packbits(a[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:])] for a in (again, first)]
    return pa.table([rows["chunk"], rows["part"], pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary())], names=["chunk", "part", "again", "first"])


def count_again(packed: DataFrame) -> DataFrame:
    """For each row of pack(): a bit for every id, whether it is found twice or more over all chunks, and whether its
    chunk is the first that has it. An id comes once from a chunk, however often the chunk has it, so no part is hot."""
    return packed.groupBy("part").applyInArrow(_judge, FLAGGED)


def by_chunk(rows: DataFrame, chunks: int):
    """rows grouped by chunk over a set number of tasks: a few bytes name a whole chunk's work, so tasks must not be
    joined by the size of the rows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, chunks // 4), "chunk").groupBy("chunk")


def flags_of(rows: list[tuple[int, bytes, bytes]], ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The flags of count_again() for each id that went into pack(). rows: part, again, first of the chunk."""
    distinct, place = np.unique(ids, return_inverse=True)
    edge = np.searchsorted(part_of(distinct, parts), np.arange(parts + 1))
    out = np.zeros((2, len(distinct)), bool)
    for p, *bits in rows:
        for k, b in enumerate(bits):
            out[k, edge[p] : edge[p + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=edge[p + 1] - edge[p])
    return out[0][place], out[1][place]
