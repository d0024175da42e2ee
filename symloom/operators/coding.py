"""Lossless archives of byte sequences, coded by the mixed context model.

A sequence is cut into blocks of at most BLOCK bytes, and blocks are coded side by side, one lane each, so that numpy works on
one symbol of all lanes at a time and a long sequence splits. For each symbol the model mixes, as the code-length operators do, the
counts of the symbols so far with those that followed the last one and the last two: the logits add up, so their exponentials
multiply. The products become integer ranges with a sum of 2^16, which a 32-bit range coder narrows.

Encoder and decoder use the same integer tables and integer arithmetic, so an archive is read back on any machine. An archive
holds everything that decoding needs: magic, sizes, preprocessing and its metadata, vocabularies, payloads.

Preprocessing of a block: none; reverse; bwt (the last column of the sorted rotations, and the row of the block itself); extbpe
(the most frequent adjacent pair becomes a new symbol, as long as it is found MERGE_LEAST times, at most MERGES times)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.session import ship

#: The header of an archive (magic, bytes, blocks, preprocessing) and of a block (symbols, kinds, bytes of the
#: vocabulary, bytes of the payload, first row of the transform, merges).
HEADER, BLOCK_HEADER = struct.Struct("<4sQIB"), struct.Struct("<IHHIIH")
MAGIC = b"SYM2"
MODES = ("none", "reverse", "bwt", "extbpe")
#: Bytes of a block, lanes coded side by side at least and at most, slots of the two-symbol contexts of a lane, and how many
#: places for them all lanes may have.
BLOCK, LANES, MOST_LANES, SLOTS, PLACES = 4096, 256, 1024, 1024, 1 << 26
#: Bytes whose archives are made at once where only their sizes are kept.
SLICE = 2 * MOST_LANES * BLOCK
#: The least count of a pair that is merged, and the most merges of a block.
MERGE_LEAST, MERGES = 50, 100
#: Exponents and smoothing of the mix: a symbol's own count, then contexts of one and of two symbols. A count stops at CAP.
PRIOR_WEIGHT, WEIGHTS, CAP = 0.75, ((0.75, 0.3), (0.8, 0.15)), 255
TOTAL, MASK, LOW, HIGH = 1 << 16, (1 << 32) - 1, 1 << 16, 1 << 24
#: Stands for the symbols before a block; a lane's model must not depend on the lanes beside it.
START = 4095


class Bits:
    """A writer of bits, most significant first."""

    def __init__(self) -> None:
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, bit: int) -> None:
        self.held, self.n = self.held << 1 | bit, self.n + 1
        if self.n == 8:
            self.out.append(self.held)
            self.held = self.n = 0

    def done(self) -> bytes:
        while self.n:
            self.put(0)
        return bytes(self.out)


class Reader:
    """A reader of bits, zeros after the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self) -> int:
        byte = self.at >> 3
        bit = self.data[byte] >> (7 - (self.at & 7)) & 1 if byte < len(self.data) else 0
        self.at += 1
        return bit


def rice_parameter(ids: list[int]) -> int:
    gap, k = int(ids[-1] / max(len(ids) - 1, 1) + 0.5), 0
    while k < 15 and 1 << (k + 1) < gap:
        k += 1
    return k


def rice_pack(ids: list[int]) -> bytes:
    """Sorted ids as Rice-coded differences after a byte with the parameter."""
    if not ids:
        return b"\0"
    k, bits, before = rice_parameter(ids), Bits(), 0
    for x in ids:
        n, before = x - before, x
        for _ in range(n >> k):
            bits.put(0)
        bits.put(1)
        for i in range(k - 1, -1, -1):
            bits.put(n >> i & 1)
    return bytes([k]) + bits.done()


def rice_unpack(data: bytes, count: int) -> list[int]:
    k, bits, out, before = data[0], Reader(data[1:]), [], 0
    for _ in range(count):
        n = 0
        while not bits.get():
            n += 1
        for _ in range(k):
            n = n << 1 | bits.get()
        before += n
        out.append(before)
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a count of 0..CAP contributes in each of the three places, as integers of at most 14 bits."""
    n = np.arange(CAP + 1)
    parts = [(n + 0.4) ** PRIOR_WEIGHT] + [(1 + n / alpha) ** weight for weight, alpha in WEIGHTS]
    return tuple(np.maximum(np.rint(p * (16383 / p[-1])), 1).astype(np.int64) for p in parts)


class Lanes:
    """The models of some lanes: how often each symbol came, and came after each context, held as what that contributes."""

    def __init__(self, lanes: int, kinds: int, own: np.ndarray):
        self.kinds, self.tables = kinds, _tables()
        self.after = [np.zeros(1 << 14, np.uint16) for _ in self.tables]  # what one more contributes
        for after, t in zip(self.after, self.tables):
            after[t] = np.append(t[1:], t[-1])
        counts, one, two = (int(t[0]) for t in self.tables)
        self.known = np.arange(kinds) < own[:, None]
        self.counts = np.full((lanes, kinds), counts, np.uint16)
        self.share = self.known * (counts / 1024)  # nothing for unknown symbols
        self.one = np.full((lanes * (kinds + 1), kinds), one, np.uint16)
        self.two = np.full((lanes * SLOTS, kinds), two, np.uint16)
        self.most = (TOTAL - self.known.sum(1)).astype(float)  # every known symbol has a unit besides
        self.each = np.arange(lanes)
        self.a = np.full(lanes, START, np.int64)
        self.row = [np.zeros(lanes, np.int64) for _ in range(2)]
        self.ones, self.below = np.ones(kinds), np.tri(kinds, k=-1)
        self.held, self.taken = np.empty((lanes, kinds)), np.empty((lanes, kinds), np.uint16)
        self._turn(lanes, self.a)

    def _turn(self, m: int, b: np.ndarray) -> None:
        """Where the contexts of the last symbol and of the last two, b before a, are held."""
        each, a = self.each[:m], self.a[:m]
        self.row[0][:m] = each * (self.kinds + 1) + np.minimum(a, self.kinds)
        self.row[1][:m] = each * SLOTS + (b * 7919 + a * 104729 + 1000003 >> 3) % SLOTS

    def _parts(self, m: int) -> np.ndarray:
        """The parts of the range that all symbols have besides their units. Floats hold whole numbers here: products stay below
        2^48, and with divisors below 2^38 a quotient below 2^16 is not rounded up to a whole number (blocks have at most
        BLOCK symbols, so few counts are large)."""
        f, taken = self.held[:m], self.taken[:m]
        np.take(self.one, self.row[0][:m], 0, out=taken, mode="clip")
        np.multiply(self.share[:m], taken, out=f)
        np.take(self.two, self.row[1][:m], 0, out=taken, mode="clip")
        np.multiply(f, taken, out=f)
        np.floor(f, out=f)
        total = np.maximum(f @ self.ones, 1)
        f *= self.most[:m, None]
        f /= total[:, None]
        return np.floor(f, out=f)

    def ranges(self, m: int) -> np.ndarray:
        """The ends of the integer ranges of all symbols, of the first m lanes; the last one is TOTAL."""
        ends = np.cumsum(self._parts(m) + self.known[:m], 1).astype(np.int64)
        ends[:, -1] = TOTAL  # the last place takes what rounding left over
        return ends

    def range_of(self, m: int, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the ranges of known symbols before the last place, of the first m lanes."""
        f = self._parts(m)
        begin = np.einsum("ij,ij->i", f, self.below[symbols])
        return begin.astype(np.int64) + symbols, f[self.each[:m], symbols].astype(np.int64) + 1

    def learn(self, m: int, symbols: np.ndarray) -> None:
        own = self.each[:m] * self.kinds + symbols
        for table, at, after in zip((self.counts, self.one, self.two), (own, self.row[0][:m] * self.kinds + symbols, self.row[1][:m] * self.kinds + symbols), self.after):
            flat = table.reshape(-1)
            flat[at] = after[flat[at]]
        self.share.reshape(-1)[own] = self.counts.reshape(-1)[own] / 1024
        before = self.a[:m].copy()
        self.a[:m] = symbols
        self._turn(m, before)


def _narrowing(low: np.ndarray, width: np.ndarray) -> Iterator[np.ndarray]:
    """The lanes that shift a byte out, until none does; low and width are changed in place."""
    while True:
        settled = ((low ^ (low + width & MASK)) & MASK) < HIGH
        small = ~settled & (width < LOW)
        width[small] = -low[small] & (LOW - 1)
        at = np.flatnonzero(settled | small)
        if not len(at):
            return
        yield at
        low[at] = low[at] << 8 & MASK
        width[at] = width[at] << 8 & MASK


def encode_lanes(blocks: list[np.ndarray], kinds: np.ndarray) -> list[bytes]:
    """The payloads of blocks of symbols 0..kinds-1, longest first."""
    size = np.array([len(x) for x in blocks])
    n, lanes = int(size[0]), len(blocks)
    symbols = np.zeros((n, lanes), np.int64)
    for i, x in enumerate(blocks):
        symbols[: len(x), i] = x
    model, cap = Lanes(lanes, int(kinds.max()) + 1, kinds), 2 * n + 64
    out, used = np.zeros((lanes, cap), np.uint8), np.zeros(lanes, np.int64)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, MASK, np.int64)
    active = np.searchsorted(-size, -np.arange(1, n + 1), "right")
    for t in range(n):
        m = int(active[t])
        s = symbols[t, :m]
        begin, part = model.range_of(m, s)
        unit = width[:m] // TOTAL
        low[:m] = low[:m] + unit * begin & MASK
        width[:m] = unit * part
        for at in _narrowing(low[:m], width[:m]):
            out[at, used[at]] = low[at] >> 24
            used[at] += 1
        model.learn(m, s)
    for k in (24, 16, 8, 0):
        out[model.each, used] = low >> k & 255
        used += 1
    return [out[i, : used[i]].tobytes() for i in range(lanes)]


def decode_lanes(payloads: list[bytes], size: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
    """The blocks' symbols, longest first."""
    n, lanes = int(size[0]), len(payloads)
    data = np.zeros((lanes, max(map(len, payloads)) + 8), np.int64)
    for i, x in enumerate(payloads):
        data[i, : len(x)] = np.frombuffer(x, np.uint8)
    model, symbols = Lanes(lanes, int(kinds.max()) + 1, kinds), np.zeros((n, lanes), np.int64)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, MASK, np.int64)
    code, read = data[:, 0] << 24 | data[:, 1] << 16 | data[:, 2] << 8 | data[:, 3], np.full(lanes, 4)
    active = np.searchsorted(-size, -np.arange(1, n + 1), "right")
    for t in range(n):
        m = int(active[t])
        ends, each = model.ranges(m), model.each[:m]
        unit = width[:m] // TOTAL
        value = np.minimum((code[:m] - low[:m] & MASK) // unit, TOTAL - 1)
        s = (ends <= value[:, None]).sum(1)
        begin = np.where(s > 0, ends[each, s - 1], 0)
        low[:m] = low[:m] + unit * begin & MASK
        width[:m] = unit * (ends[each, s] - begin)
        for at in _narrowing(low[:m], width[:m]):
            code[at] = (code[at] << 8 & MASK) | data[at, read[at]]
            read[at] += 1
        symbols[t, :m] = s
        model.learn(m, s)
    return [symbols[: size[i], i] for i in range(lanes)]


def rotations(x: np.ndarray) -> np.ndarray:
    """The sorted rotations' first positions, by doubling; equal rotations in order of position."""
    n, h = len(x), 1
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while h < n and rank.max() < n - 1:
        key = rank * (n + 1) + np.roll(rank, -h)
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        h *= 2
    return order


def unrotated(last: np.ndarray, first: int) -> np.ndarray:
    """The block from the last column of its sorted rotations and the block's own row."""
    lf = np.empty(len(last), np.int64)
    lf[np.argsort(last, kind="stable")] = np.arange(len(last))
    back, at, out = lf.tolist(), first, []
    for _ in range(len(last)):
        out.append(at)
        at = back[at]
    return last[np.array(out[::-1], np.int64)]


def merged(x: np.ndarray, least: int = MERGE_LEAST, most: int = MERGES) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """x with the most frequent adjacent pair made a new symbol (256, 257 ...), again and again, and the pairs. Of equally
    frequent pairs that whose count was complete first is taken; overlapping ones are replaced from the left."""
    pairs: list[tuple[int, int]] = []
    while len(x) > 1 and len(pairs) < most:
        key = x[:-1] * 65536 + x[1:]
        kinds, place, count = np.unique(key, return_inverse=True, return_counts=True)
        if count.max() < least:
            break
        last = np.zeros(len(kinds), np.int64)
        last[place] = np.arange(len(key))  # of equal places the last one is kept
        best = np.flatnonzero(count == count.max())
        best = best[last[best].argmin()]
        a, b = divmod(int(kinds[best]), 65536)
        at = np.flatnonzero(place == best)
        if a == b:  # every second one of a run
            run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
        x = x.copy()
        x[at] = 256 + len(pairs)
        x = np.delete(x, at + 1)
        pairs.append((a, b))
    return x, pairs


def unmerged(x: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    for k in range(len(pairs) - 1, -1, -1):
        at = np.flatnonzero(x == 256 + k)
        x = np.insert(x, at + 1, pairs[k][1])
        x[at + np.arange(len(at))] = pairs[k][0]
    return x


def _prepared(block: bytes, mode: str) -> tuple[np.ndarray, int, list[tuple[int, int]]]:
    """Symbols, first row, merges of a block."""
    x = np.frombuffer(block, np.uint8).astype(np.int64)
    if mode == "reverse":
        return x[::-1], 0, []
    if mode == "bwt":
        order = rotations(x)
        return x[order - 1], int(np.flatnonzero(order == 0)[0]), []
    if mode == "extbpe":
        x, pairs = merged(x)
        return x, 0, pairs
    return x, 0, []


def _lanes(order: list[int], kinds: list[int]) -> Iterator[list[int]]:
    """Blocks in runs that are coded side by side: more of them, where blocks have few kinds of symbols."""
    i = 0
    while i < len(order):
        widest = max(kinds[k] for k in order[i : i + MOST_LANES]) + 1
        j = i + min(MOST_LANES, max(LANES, PLACES // (SLOTS * widest)))
        yield order[i:j]
        i = j


def compress_many(rows: list[bytes], mode: str | list[str] = "none") -> list[bytes]:
    """The archive of each row. mode: one for all, or one for each."""
    modes = [mode] * len(rows) if isinstance(mode, str) else mode
    blocks, owner = [], []
    for r, data in enumerate(rows):
        for i in range(0, len(data), BLOCK):
            x, first, pairs = _prepared(data[i : i + BLOCK], modes[r])
            blocks.append((*np.unique(x, return_inverse=True), first, pairs))
            owner.append(r)
    parts: list[list[bytes]] = [[] for _ in rows]
    held: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: (-len(blocks[k][1]), len(blocks[k][0])))  # lanes of one width, as far as it goes
    for lane in _lanes(order, [len(x[0]) for x in blocks]):
        payloads = encode_lanes([blocks[k][1] for k in lane], np.array([len(blocks[k][0]) for k in lane]))
        for k, payload in zip(lane, payloads):
            ids, places, first, pairs = blocks[k]
            vocabulary = rice_pack(ids.tolist())
            head = BLOCK_HEADER.pack(len(places), len(ids), len(vocabulary), len(payload), first, len(pairs))
            held[k] = head + b"".join(struct.pack("<HH", *p) for p in pairs) + vocabulary + payload
    for r, block in zip(owner, held):
        parts[r].append(block)
    return [HEADER.pack(MAGIC, len(data), len(p), MODES.index(m)) + b"".join(p) for data, p, m in zip(rows, parts, modes)]


def decompress_many(archives: list[bytes]) -> list[bytes]:
    """The bytes of each archive."""
    blocks, owner, heads = [], [], []
    for r, archive in enumerate(archives):
        magic, size, count, mode = HEADER.unpack_from(archive)
        if magic != MAGIC:
            raise ValueError("not an archive")
        heads.append((size, MODES[mode]))
        at = HEADER.size
        for _ in range(count):
            n, kinds, vocabulary, payload, first, pairs = BLOCK_HEADER.unpack_from(archive, at)
            at += BLOCK_HEADER.size
            merges = [struct.unpack_from("<HH", archive, at + 4 * i) for i in range(pairs)]
            at += 4 * pairs
            ids = np.array(rice_unpack(archive[at : at + vocabulary], kinds), np.int64)
            at += vocabulary
            blocks.append((n, ids, first, merges, archive[at : at + payload]))
            owner.append(r)
            at += payload
        if at != len(archive):
            raise ValueError("damaged archive")
    out: list[list[bytes]] = [[] for _ in archives]
    held: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -blocks[k][0])
    for lane in _lanes(order, [len(x[1]) for x in blocks]):
        found = decode_lanes([blocks[k][4] for k in lane], np.array([blocks[k][0] for k in lane]), np.array([len(blocks[k][1]) for k in lane]))
        for k, places in zip(lane, found):
            if places.max() >= len(blocks[k][1]):
                raise ValueError("damaged archive")
            x, mode = blocks[k][1][places], heads[owner[k]][1]
            if mode == "reverse":
                x = x[::-1]
            elif mode == "bwt":
                x = unrotated(x, blocks[k][2])
            elif mode == "extbpe":
                x = unmerged(x, blocks[k][3])
            held[k] = x.astype(np.uint8).tobytes()
    for r, block in zip(owner, held):
        out[r].append(block)
    rows = [b"".join(x) for x in out]
    if any(len(x) != size for x, (size, _) in zip(rows, heads)):
        raise ValueError("damaged archive")
    return rows


def first_difference(a: Column, b: Column) -> Column:
    """The first offset, from 0, at which two binary values differ (the length of the shorter one, if it begins the longer);
    null where they are equal or one is null. Looked for by halving."""
    size = F.least(F.length(a), F.length(b))

    def halve(state: Column, _) -> Column:
        middle = ((state["lo"] + state["hi"] + 1) / 2).cast("int")
        equal = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.when(state["lo"] >= state["hi"], state).when(equal, F.struct(middle.alias("lo"), state["hi"].alias("hi"))).otherwise(F.struct(state["lo"].alias("lo"), (middle - 1).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda s: s["lo"])
    return F.when(a != b, found).cast("long")


def compress(data: bytes, mode: str = "none") -> bytes:
    return compress_many([data], mode)[0]


def decompress(archive: bytes) -> bytes:
    return decompress_many([archive])[0]


def compress_rows(docs: DataFrame, mode: str | None = "none") -> DataFrame:
    """seq, archive of each row's data (binary; null: empty). mode None: the column mode names it for each row."""
    ship(docs.sparkSession)

    def work(batches):
        for rows in batches:
            modes = list(rows["mode"]) if mode is None else mode
            yield pd.DataFrame({"seq": rows["seq"], "archive": compress_many([bytes(x) if x is not None else b"" for x in rows["data"]], modes)})

    return docs.select("seq", "data", *(["mode"] if mode is None else [])).mapInPandas(work, "seq long, archive binary")


def archive_sizes(docs: DataFrame) -> DataFrame:
    """seq, mode, bytes, coded: the sizes of each row's data (binary; null: empty) and of its archive in the row's mode."""
    ship(docs.sparkSession)

    def work(batches):
        for rows in batches:
            data = [bytes(x) if x is not None else b"" for x in rows["data"]]
            size = np.array([len(x) for x in data])
            part = (np.cumsum(size) - size) // SLICE  # rows whose blocks are held at once
            for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
                archives = compress_many([data[i] for i in at], [rows["mode"].iloc[i] for i in at])
                yield pd.DataFrame({"seq": rows["seq"].iloc[at], "mode": rows["mode"].iloc[at], "bytes": size[at], "coded": [len(x) for x in archives]})

    return docs.select("seq", "data", "mode").mapInPandas(work, "seq long, mode string, bytes long, coded long")


def decompress_rows(archives: DataFrame) -> DataFrame:
    """seq, data of each archive."""
    ship(archives.sparkSession)

    def work(batches):
        for rows in batches:
            yield pd.DataFrame({"seq": rows["seq"], "data": decompress_many([bytes(x) for x in rows["archive"]])})

    return archives.select("seq", "archive").mapInPandas(work, "seq long, data binary")
