"""Exact substring dedup by bucket-pointer refinement, as suffix arrays are built: positions start in buckets of their
q-gram, buckets are sorted on the bucket identifiers of later offsets, and the identifiers so refined are used again for
the next refinement, until a bucket stands for LENGTH bytes. Positions that are alone in their bucket drop out at each
level.

Refining every position of a corpus would move many times its bytes, so the positions that can have a partner are found
first, in written tables and with shuffles of identifiers only:

1. whole texts, by 128-bit digests: of exact copies one stands for all; the others add nothing and are covered throughout;
2. GRAM-byte buckets at anchors: every LENGTH-byte window holds the gram of least identifier in it, and equal windows hold
   equal ones at the same offset, so a window whose anchor's gram is found once is not repeated;
3. runs of windows that share an anchor are sent with their bytes to a task that holds all runs of that anchor, each
   distinct run of a chunk once. There the buckets are refined (refine()): from 8-byte grams to 16, 32 ... bytes by sorting
   on (bucket, bucket at the later offset), at last on the bytes at the ends. This compares bytes, not hashes;
4. anchors with more than HOT runs would not fit one task. Their buckets are refined by the 128-bit identifiers of what about 16
   classes of windows have in common (all but 16 of their bytes), then, where that is found again, of the windows
   themselves; both are dealt by identifier, so that no group is hot. At 10^14 such windows the odds of any false match are
   about 10^-11.

Chunks hold the texts between the levels. Besides the removed bytes the result tells the words of shared passages: of words in
lower case (A-Z), anchors of PASSAGE_GRAM words are chosen as in 2, of which any PASSAGE words hold one at least, and those that
another document has too are counted. So a document that shares a passage of PASSAGE words has some, however few bytes it has.

Cases: null and empty texts have nothing to remove; texts under LENGTH bytes keep all; repeated rows are copies of one
another and lose everything if they are long enough; a null doc_id is kept as it is; matches never cross documents; very
long texts are worked off in segments; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm import arrays as A
from symloom.llm.chunks import Store, by_chunk, deal
from symloom.llm.common import materialize, new_path, ship, table

LENGTH, GRAM, SEGMENT, HOT, PART_RUNS, CLASSES = 400, 128, 1 << 18, 500, 12000, 16
#: A passage's words, and the words that its anchors stand for: of 19 neighbouring grams of 32 words one is an anchor.
PASSAGE, PASSAGE_GRAM = 50, 32
U = np.uint64
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string, n_shared_words long"
#: What chunks are told: 0 the chunk's file, 1 a text with copies, 2 a repeated byte anchor, 3 a repeated passage anchor, 4 the
#: windows of a run that are repeated, 5 a repeated window of a hot anchor, 6 a repeated core of a class of its windows.
TOLD = "chunk long, kind int, name string, a long, b long, bits binary"
FOUND = "kind int, id long, low long, chunk long, n long"
NAME, COPY, ANCHOR, WORDS, RUN, WINDOW, CORE = range(7)


def _double(ids: np.ndarray, k: int, level: int) -> np.ndarray:
    """Identifiers of 2k symbols from those of k symbols: the pointer at the later offset refines the bucket."""
    later = ids[k:]
    return ids[:-k] * A.ODD[2 * level] + (later ^ (later >> U(29))) * A.ODD[2 * level + 1]


def gram_ids(data: np.ndarray, length: int) -> np.ndarray:
    """The identifier of the length symbols (bytes, or 64-bit identifiers of words) at each position with as many after it."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    n, ids, k, level = len(data) - length + 1, A.BYTE_IDS[data] if data.dtype == np.uint8 else data, 1, 0
    out, at = None, 0
    sizes = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]  # largest first
    held = {}
    while True:
        if k in sizes:
            held[k] = ids
        if 2 * k > length:
            break
        ids = _double(ids, k, level)
        k, level = 2 * k, level + 1
    for j, size in enumerate(sizes):
        part = held[size][at : at + n]
        out = part if out is None else out * A.ODD[40 + j] + (part ^ (part >> U(31))) * A.ODD[50 + j]
        at += size
    return A.mix(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    rest = width - k
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _starts(offsets: np.ndarray, length: int, skip: np.ndarray) -> np.ndarray:
    """Whether a window of length symbols within one text begins at each position; texts in skip have none."""
    edges = np.zeros(offsets[-1] + 1, np.int64)
    size = np.where(skip, 0, np.maximum(np.diff(offsets) - length + 1, 0))
    np.add.at(edges, offsets[:-1], 1 * (size > 0))
    np.add.at(edges, offsets[:-1] + size, -1 * (size > 0))
    return np.cumsum(edges[:-1]) > 0


def anchors(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The runs of windows that share an anchor: first window, last window + 1, the anchor's position and identifier. Windows
    are those of _starts(); the anchor of a window is the position of its least gram identifier, the first of equal ones."""
    valid = _starts(offsets, length, skip)
    width, bits = length - gram + 1, U((1 << 20) - 1)
    froms, tos, where, ids = [], [], [], []
    for a in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[a : a + SEGMENT + length - 1]
        windows = np.flatnonzero(valid[a : a + len(part) - length + 1])
        if not len(windows):
            continue
        grams = gram_ids(part, gram)
        best = _sliding_min((grams & ~bits) | np.arange(len(grams), dtype=np.uint64), width)
        at = (best[windows] & bits).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
        head = np.flatnonzero(new)
        froms.append(windows[head] + a)
        tos.append(windows[np.append(head[1:], len(at)) - 1] + 1 + a)
        where.append(at[head] + a)
        ids.append(grams[at[head]])
    if not froms:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    froms, tos, where, ids = map(np.concatenate, (froms, tos, where, ids))
    join = np.zeros(len(froms), bool)  # one anchor seen from both sides of a segment's end is one member
    join[1:] = where[1:] == where[:-1]
    head = np.flatnonzero(~join)
    # Least identifiers are small ones: mixed once more, they are even over the tasks that count them.
    return froms[head], tos[np.append(head[1:], len(froms)) - 1], where[head], A.mix(ids[head])


def _sorted_again(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Buckets (0, 1 ... in sort order; -1: dropped) refined by sorting on (bucket, bucket at the later offset). Members that
    are alone in the refined bucket, or whose either part was dropped, are dropped."""
    out = np.full(len(first), -1, np.int64)
    at = np.flatnonzero((first >= 0) & (later >= 0))
    key = first[at] << 32 | later[at]
    order = np.argsort(key)
    key = key[order]
    if len(key):
        bucket = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        keep = np.bincount(bucket)[bucket] > 1
        out[at[order[keep]]] = bucket[keep]
    return out


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def refine(runs: list[bytes], phase: np.ndarray, count: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Whether each of the first count[r] windows of length bytes of a run is found again, there or in another run.

    phase[r] is the anchor's offset in the run modulo 8. Grams of 8 bytes are laid out from the anchor on, so equal windows
    hold equal grams at equal places; their buckets are refined by later offsets until they stand for all whole grams that
    every window holds, and then by the bytes left over at both ends of a window."""
    size = np.array([len(r) for r in runs], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(runs) + bytes(32), np.uint8)
    eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))
    grams = np.maximum(size - phase, 0) // 8
    first = np.concatenate([[0], np.cumsum(grams)])
    of = np.repeat(np.arange(len(runs)), grams)
    step = np.arange(first[-1]) - first[of]
    left = grams[of] - step  # grams from here to the end of the run
    bucket = _ranks(eight[start[of] + phase[of] + 8 * step])
    whole, k = (length - 7) // 8, 1

    def later(held: np.ndarray, by: int, width: int) -> np.ndarray:
        moved = np.full(len(held), -1, np.int64)
        moved[: max(len(held) - by, 0)] = held[by:]
        moved[left < by + width] = -1
        return moved

    while 2 * k <= whole:
        bucket = _sorted_again(bucket, later(bucket, k, k))
        k *= 2
    bucket = _sorted_again(bucket, later(bucket, whole - k, k)) if whole > k else bucket

    edge = np.concatenate([[0], np.cumsum(count)])
    run = np.repeat(np.arange(len(runs)), count)
    at = np.arange(edge[-1]) - edge[run]
    ahead = (phase[run] - at) % 8  # bytes before the first whole gram
    place = first[run] + (at + ahead - phase[run]) // 8
    live = np.flatnonzero(bucket[np.minimum(place, max(len(bucket) - 1, 0))] >= 0) if len(bucket) else np.zeros(0, np.int64)
    state, at, ahead = bucket[place[live]], start[run[live]] + at[live], ahead[live].astype(np.uint64)

    def some(values: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The first width bytes (0 to 8) of each value."""
        return np.where(width >= 8, values, values & ((U(1) << (U(8) * np.minimum(width, U(7)))) - U(1)))

    rest = U(length - 8 * whole) - ahead
    ends = [some(eight[at], ahead) | ahead << U(56), some(eight[at + ahead.astype(np.int64) + 8 * whole], np.minimum(rest, U(8)))]
    if length - 8 * whole > 8:
        ends.append(some(eight[np.minimum(at + ahead.astype(np.int64) + 8 * whole + 8, len(eight) - 1)], np.maximum(rest, U(8)) - U(8)))
    for values in ends:
        state = _sorted_again(state, _ranks(values))
    again = np.zeros(edge[-1], bool)
    again[live[state >= 0]] = True
    return np.split(again, edge[1:-1])


def window_ids(data: np.ndarray, froms: np.ndarray, tos: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and 128-bit identifiers (high, low) of the windows in the ranges froms..tos (in order, they may overlap),
    computed on their bytes only."""
    at, high, low = [], [], []
    if len(froms):
        tos = np.maximum.accumulate(tos)
        gap = np.flatnonzero(froms[1:] > tos[:-1]) + 1  # ranges that touch are one
        for i, j in zip(froms[np.append(0, gap)].tolist(), tos[np.append(gap - 1, len(tos) - 1)].tolist()):
            for a in range(i, j, SEGMENT):
                b = min(j, a + SEGMENT)
                part = data[a : b + length - 1]
                at.append(np.arange(a, b))
                high.append(gram_ids(part, length))
                low.append(gram_ids(A.mix(A.BYTE_IDS[part] ^ U(0x632BE59BD9B4E019)), length))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(at), np.concatenate(high), np.concatenate(low)) if at else (np.zeros(0, np.int64), none, none)


def equal_runs(data: np.ndarray, froms: np.ndarray, tos: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run the first one of the chunk with the same bytes and anchor, and whether it has others like it."""
    seen: dict = {}
    lead = np.zeros(len(froms), np.int64)
    for i, (a, b, p) in enumerate(zip(froms.tolist(), tos.tolist(), at.tolist())):
        lead[i] = seen.setdefault((p - a, data[a : b + length - 1].tobytes()), i)
    return lead, np.bincount(lead, minlength=len(lead))[lead] > 1


def _step(length: int) -> int:
    return max(1, (length - min(GRAM, length // 3) + 1) // CLASSES)


def core_ids(data: np.ndarray, froms: np.ndarray, tos: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For each class of windows of each run: run, class, and the 128-bit identifier of anchor, class and core. The windows of
    class c hold their anchor at an offset from c * step on, below (c + 1) * step; their core is what all of them hold."""
    step = _step(length)
    low_class, high_class = (at - tos + 1) // step, (at - froms) // step
    count = high_class - low_class + 1
    run = np.repeat(np.arange(len(froms)), count)
    kind = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + low_class[run]
    place, high, low = window_ids(data, at - step * high_class, at - step * low_class + 1, length - step + 1)
    found = np.searchsorted(place, at[run] - step * kind)
    return run, kind, high[found] ^ A.mix(ids[run] + kind.astype(np.uint64)), low[found]


def passage_anchors(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and text, first word (within the text) and identifier of the passage anchors. A-Z are lower-cased."""
    data = A.LOWER[data]
    starts, ends, first = A.words(data, offsets)
    _, _, at, ids = anchors(A.span_ids(data, starts, ends), first, skip, PASSAGE, PASSAGE_GRAM)
    text = np.searchsorted(first, at, "right") - 1
    return np.diff(first), text, at - first[text], ids


def _counted(kind: int, chunk: int, high: np.ndarray, low: np.ndarray | None = None, member: np.ndarray | None = None) -> pa.Table:
    """A row of FOUND for each distinct identifier of a chunk; n counts it, or its distinct members."""
    low = np.zeros(len(high), np.uint64) if low is None else low
    member = np.arange(len(high)) if member is None else member
    order = np.lexsort((member, low, high))
    high, low, member = high[order], low[order], member[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    head = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= member[1:] != member[:-1]
    n = np.add.reduceat(other, head, dtype=np.int64) if len(head) else np.zeros(0, np.int64)
    columns = [np.full(len(head), kind, np.int32), high[head].view(np.int64), low[head].view(np.int64), np.full(len(head), chunk, np.int64), n]
    return pa.table([pa.array(c) for c in columns], names=["kind", "id", "low", "chunk", "n"])


def _among(high: np.ndarray, low: np.ndarray, told: pa.Table) -> np.ndarray:
    """Which identifiers are told of (a: high, b: low)."""
    known = set(zip(told["a"].to_pylist(), told["b"].to_pylist()))
    return np.fromiter((x in known for x in zip(high.view(np.int64).tolist(), low.view(np.int64).tolist())), bool, len(high))


def _digest(raw) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the removed runs of bytes), kept_sha256 of the bytes that stay, and
    n_shared_words: words in the passage anchors that another document has too."""
    if length < 15:
        raise ValueError("length must be 15 bytes at least")
    spark = docs.sparkSession
    ship(spark)
    gram = min(GRAM, max(1, length // 3))
    uri = new_path(spark, "suffix-chunks")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def scan(batches):
        from pyspark import TaskContext

        for seq, (name, _, rows) in enumerate(deal(batches, "text")):
            data, offsets = A.flat(rows["text"])
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])
            Store(uri).put_table(name, pa.table([rows["doc_id"], kept], names=["doc_id", "text"]))
            raw = memoryview(np.ascontiguousarray(data))
            ids = [_digest(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [[TaskContext.get().partitionId() << 32 | seq] * len(rows), [name] * len(rows), range(len(rows)), np.diff(offsets), [x for x, _ in ids], [x for _, x in ids]]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "name", "row", "n", "d1", "d2"])

    texts = materialize(slim.mapInArrow(scan, "chunk long, name string, row long, n long, d1 long, d2 long"), "suffix-texts")
    nothing = {"long": F.lit(None).cast("long"), "binary": F.lit(None).cast("binary"), "string": F.lit(None).cast("string")}

    def told(rows: DataFrame, kind: int, **columns) -> DataFrame:
        have = {"name": nothing["string"], "a": nothing["long"], "b": nothing["long"], "bits": nothing["binary"]} | columns
        return rows.select("chunk", F.lit(kind).alias("kind"), *[c.alias(k) for k, c in have.items()])

    chunks = materialize(told(texts.select("chunk", "name").distinct(), NAME, name=F.col("name")), "suffix-names")
    n = chunks.count()
    lead = F.min(F.struct("chunk", "row")).alias("lead")
    groups = texts.where("n > 0").groupBy("d1", "d2").agg(lead, F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = materialize(groups.select("d1", "d2", "lead"), "suffix-copies")  # a written table: a hot text's rows can be split
    is_lead = ((F.col("chunk") == F.col("lead.chunk")) & (F.col("row") == F.col("lead.row"))).cast("long")
    copies = materialize(told(texts.join(groups, ["d1", "d2"]), COPY, a=F.col("row"), b=is_lead), "suffix-told1")

    def load(rows: pa.Table):
        """The chunk's number, name and rows, and what else it is told, by kind."""
        kinds, names = rows["kind"].to_numpy(), rows["name"].to_pylist()
        name = names[int(np.flatnonzero(kinds == NAME)[0])]
        by = {k: rows.filter(pa.array(kinds == k)) for k in range(1, 7)}
        return rows["chunk"][0].as_py(), name, Store(uri).table(name), by

    def of(rows: pa.Table, *columns: str) -> list[np.ndarray]:
        return [rows[c].to_numpy() for c in columns]

    def copied(by: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts that have copies, and those that another one stands for."""
        have, skip = np.zeros(size, bool), np.zeros(size, bool)
        row, first = of(by[COPY], "a", "b")
        have[row], skip[row] = True, first == 0
        return have, skip

    def grams(rows: pa.Table) -> pa.Table:
        chunk, name, held, by = load(rows)
        data, offsets = A.flat(held["text"])
        _, skip = copied(by, len(held))
        froms, tos, where, ids = anchors(data, offsets, skip, length, gram)
        Store(uri).put_table(f"{name}.runs", pa.table([pa.array(x) for x in (froms, tos, where, ids)], names=["from", "to", "at", "id"]))
        parts = []
        for i, j, d, o in A.pieces(data, offsets):
            words, of_text, word, passage = passage_anchors(d, o, skip[i:j])
            parts.append((words, of_text + i, word, passage))
        words, of_text, word, passage = map(np.concatenate, zip(*parts))
        Store(uri).put_table(f"{name}.words", pa.table([pa.array(x) for x in (of_text, word, passage)], names=["row", "word", "id"]))
        Store(uri).put_table(f"{name}.counts", pa.table([pa.array(words)], names=["words"]))
        return pa.concat_tables([_counted(ANCHOR, chunk, ids), _counted(WORDS, chunk, passage, member=of_text)])

    def again(found: DataFrame) -> DataFrame:
        """The rows of found whose identifier is counted twice or more over all chunks, with the count. An identifier comes
        once from a chunk, and those counted are a written table, so that the rows of a hot one can be split."""
        keys = ["kind", "id", "low"]
        counts = materialize(found.groupBy(keys).agg(F.sum("n").alias("total")).where("total > 1"), "suffix-counts")
        return found.join(counts, keys)

    found = materialize(by_chunk(chunks.unionByName(copies), n).applyInArrow(grams, FOUND), "suffix-grams")
    alive = materialize(again(found), "suffix-alive")
    anchored = told(alive.where(F.col("kind") == ANCHOR), ANCHOR, a=F.col("id"), b=(F.col("total") > hot).cast("long"))
    shared = told(alive.where(F.col("kind") == WORDS), WORDS, a=F.col("id"))
    members = alive.where((F.col("kind") == ANCHOR) & (F.col("total") <= hot)).agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-members // PART_RUNS))

    def runs_of(name: str, by: dict):
        """Cold and hot runs that are alive: from, to, at, id of either."""
        runs = Store(uri).table(f"{name}.runs")
        ids = runs["id"].to_numpy()
        known, is_hot = of(by[ANCHOR], "a", "b")
        order = np.argsort(known.view(np.uint64))
        known, is_hot = known.view(np.uint64)[order], is_hot[order]
        place = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
        live = known[place] == ids if len(known) else np.zeros(len(ids), bool)
        very = live & (is_hot[place] == 1) if len(known) else live
        columns = of(runs, "from", "to", "at", "id")
        return [c[live & ~very] for c in columns], [c[very] for c in columns]

    def contexts(rows: pa.Table) -> pa.Table:
        """The cold runs with their bytes, equal ones of the chunk once, dealt by their anchor."""
        chunk, name, held, by = load(rows)
        data, _ = A.flat(held["text"])
        (froms, tos, at, ids), _ = runs_of(name, by)
        lead, many = equal_runs(data, froms, tos, at, length)
        first = np.flatnonzero(lead == np.arange(len(lead)))
        raw = [data[a : b + length - 1].tobytes() for a, b in zip(froms[first].tolist(), tos[first].tolist())]
        part = (A.mix(ids[first]) % U(parts)).astype(np.int32)
        columns = [part, np.full(len(first), chunk, np.int64), first, (at - froms)[first] % 8, (tos - froms)[first]]
        return pa.table([*map(pa.array, columns), pa.array(raw, pa.binary()), pa.array(many[first])], names=["part", "chunk", "run", "phase", "windows", "raw", "many"])

    def judge(rows: pa.Table) -> pa.Table:
        """The refinement of all runs of a part; a run that its chunk has twice is found again throughout."""
        rows = rows.sort_by([("chunk", "ascending"), ("run", "ascending")])
        phase, count, many = of(rows, "phase", "windows", "many")
        bits = refine(rows["raw"].to_pylist(), phase, count, length)
        packed = [np.packbits(b | m).tobytes() for b, m in zip(bits, many.tolist())]
        return pa.table([rows["chunk"], rows["run"], pa.array(packed, pa.binary())], names=["chunk", "run", "bits"])

    def hot_cores(rows: pa.Table) -> pa.Table:
        """Identifiers of the classes' cores of the hot runs, equal ones of the chunk once (but counted as two)."""
        chunk, name, held, by = load(rows)
        data, _ = A.flat(held["text"])
        _, runs = runs_of(name, by)
        lead, many = equal_runs(data, *runs[:3], length)
        first = np.flatnonzero(lead == np.arange(len(lead)))
        run, kind, high, low = core_ids(data, *(x[first] for x in runs), length)
        Store(uri).put_table(f"{name}.cores", pa.table([pa.array(x) for x in (first[run], kind, high, low)], names=["run", "kind", "high", "low"]))
        Store(uri).put_table(f"{name}.leads", pa.table([pa.array(lead), pa.array(many)], names=["lead", "many"]))
        twice = 1 + many[first[run]]
        return _counted(CORE, chunk, np.repeat(high, twice), np.repeat(low, twice))

    def hot_windows(rows: pa.Table) -> pa.Table:
        """The same of the windows of classes whose core is found again."""
        chunk, name, held, by = load(rows)
        data, _ = A.flat(held["text"])
        _, (froms, tos, at, _) = runs_of(name, by)
        run, kind, high, low = of(Store(uri).table(f"{name}.cores"), "run", "kind", "high", "low")
        live = _among(high, low, by[CORE])
        run, kind, step = run[live], kind[live], _step(length)
        begin, end = np.maximum(froms[run], at[run] - step * (kind + 1) + 1), np.minimum(tos[run], at[run] - step * kind + 1)
        order = np.argsort(begin)
        place, high, low = window_ids(data, begin[order], end[order], length)
        many = Store(uri).table(f"{name}.leads")["many"].to_numpy(zero_copy_only=False)
        owner = np.searchsorted(froms, place, "right") - 1
        Store(uri).put_table(f"{name}.windows", pa.table([pa.array(x) for x in (owner, place, high, low)], names=["run", "at", "high", "low"]))
        twice = 1 + many[owner]
        return _counted(WINDOW, chunk, np.repeat(high, twice), np.repeat(low, twice))

    names = chunks.unionByName(anchored)
    sent = by_chunk(names, n).applyInArrow(contexts, "part int, chunk long, run long, phase long, windows long, raw binary, many boolean")
    judged = sent.repartition(parts, "part").groupBy("part").applyInArrow(judge, "chunk long, run long, bits binary")
    judged = told(materialize(judged, "suffix-judged"), RUN, a=F.col("run"), bits=F.col("bits"))
    hottest = anchored.where("b = 1")
    hottest = materialize(chunks.join(hottest.select("chunk").distinct(), "chunk", "left_semi").unionByName(hottest), "suffix-hottest")

    def repeated(rows: DataFrame, kind: int, label: str) -> DataFrame:
        return materialize(told(again(materialize(rows, label)), kind, a=F.col("id"), b=F.col("low")), label)

    cores = repeated(by_chunk(hottest, n).applyInArrow(hot_cores, FOUND), CORE, "suffix-cores")
    windows = repeated(by_chunk(hottest.unionByName(cores), n).applyInArrow(hot_windows, FOUND), WINDOW, "suffix-windows")

    def result(rows: pa.Table) -> pa.Table:
        chunk, name, held, by = load(rows)
        data, offsets = A.flat(held["text"])
        have, _ = copied(by, len(held))
        edges = np.zeros(len(data) + 1, np.int64)

        def cover(windows: np.ndarray) -> None:
            np.add.at(edges, windows, 1)
            np.add.at(edges, windows + length, -1)

        def spread(froms: np.ndarray, lead: np.ndarray, again: dict[int, np.ndarray]) -> None:
            """Covers the windows found again of each run: those of the run that stands for it."""
            for a, i in zip(froms.tolist(), lead.tolist()):
                if len(again.get(i, ())):
                    cover(a + again[i])

        (froms, tos, at, _), hot_runs = runs_of(name, by)
        told_bits = zip(*(by[RUN][c].to_pylist() for c in ("a", "bits")))
        again = {i: np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(tos[i] - froms[i]))) for i, bits in told_bits}
        spread(froms, equal_runs(data, froms, tos, at, length)[0], again)
        if len(hot_runs[0]):
            froms, tos, at, _ = hot_runs
            lead, many = (Store(uri).table(f"{name}.leads")[c].to_numpy(zero_copy_only=False) for c in ("lead", "many"))
            run, place, high, low = of(Store(uri).table(f"{name}.windows"), "run", "at", "high", "low")
            live = _among(high, low, by[WINDOW])
            run, place = run[live], place[live]
            edge = np.searchsorted(run, np.arange(len(froms) + 1))
            again = {i: place[edge[i] : edge[i + 1]] - froms[i] for i in np.unique(run).tolist()}
            again |= {i: np.arange(tos[i] - froms[i]) for i in np.flatnonzero(many).tolist()}
            spread(froms, lead, again)
        gone = np.cumsum(edges[:-1]) > 0
        for i in np.flatnonzero(have & (np.diff(offsets) >= length)):
            gone[offsets[i] : offsets[i + 1]] = True
        spans, digests = [], []
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            g = gone[i:j]
            if g.any():
                cut = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in cut.reshape(-1, 2).tolist()])
                digests.append(hashlib.sha256(data[i:j][~g]).hexdigest())
            else:
                spans.append([])
                digests.append(hashlib.sha256(np.ascontiguousarray(data[i:j])).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [held["doc_id"], pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(digests, pa.string()), pa.array(_shared(name, by, have))]
        return pa.table(columns, names=["doc_id", "n_bytes", "spans", "kept_sha256", "n_shared_words"])

    def _shared(name: str, by: dict, have: np.ndarray) -> np.ndarray:
        words = Store(uri).table(f"{name}.counts")["words"].to_numpy()
        row, word, ids = of(Store(uri).table(f"{name}.words"), "row", "word", "id")
        live = np.isin(ids.view(np.int64), by[WORDS]["a"].to_numpy())
        begin = np.concatenate([[0], np.cumsum(words)])
        edges = np.zeros(begin[-1] + 1, np.int64)
        at = begin[row[live]] + word[live]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + PASSAGE_GRAM, -1)
        out = A.per_text(np.cumsum(edges[:-1]) > 0, begin)
        return np.where(have & (words >= PASSAGE), words, out)

    everything = chunks.unionByName(copies).unionByName(anchored).unionByName(shared).unionByName(judged).unionByName(cores).unionByName(windows)
    return by_chunk(everything, n).applyInArrow(result, RESULT)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_shared_words")
