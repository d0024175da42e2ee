"""BPE encoding and decoding by speculation: greedy longest matches propose tokens, vectorised compatibility checks test
every adjacent pair, and only words with an incompatible pair undergo exact merging.

A proposal is the encoding exactly when each token encodes to itself and each adjacent pair of tokens, put together,
encodes to just these two. Pairs that were never seen are settled once by exact merging of the two tokens' symbols and
kept in a table. Words are proposed and tested together in numpy; the tokens of a word are kept per task.

The vocabulary file (its path is a parameter) is BPE with word ends: NFC, white space to one space, lower case, words by
a fixed pattern, bytes as printable characters. The file's special tokens are cut out of the text before this.

Cases: null and empty texts and texts of only white space have no tokens and decode to the empty string; very long texts
are worked off in parts between words, very long words by linear matching and a heap; repeated rows each get a row; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from symloom.llm.common import begin, hold, ship, table

CACHE_WORDS, CACHE_PAIRS, LONG_WORD = 120_000, 250_000, 200
NO_RANK, BLOCK_CELLS = 1 << 40, 1 << 16
_spaces = regex.compile(r"\s+")
_loaded: dict[str, "WordBpe"] = {}


def _byte_characters() -> list[str]:
    """The printable character of each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


def _unassigned() -> str:
    """A class of the code points that this Python's Unicode tables don't know."""
    new = [i for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn"]
    starts = [i for i, j in zip(new, [-2, *new]) if i != j + 1]
    ends = [i for i, j in zip(new, [*new[1:], -2]) if j != i + 1]
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends)) + "]"


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.path, self.file = path, None
        self.unassigned = regex.compile(_unassigned())
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        shown = _byte_characters()
        # Symbols: 0..255 bytes within a word, 256..511 bytes at its end.
        self.first = np.array([vocab[c] for c in shown] + [vocab[c + self.end] for c in shown], np.int64)
        byte = {c: b for b, c in enumerate(shown)}
        self.rank, parts = {}, {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (n, vocab[a + b]))
        for t, i in vocab.items():
            ended = t.endswith(self.end) and t != self.end
            body = t[: -len(self.end)] if ended else t
            s = [byte[c] for c in body]
            if ended:
                s[-1] += 256
            parts[i] = s
        self.parts = parts
        table = sorted((a << 17 | b, n, t) for (a, b), (n, t) in self.rank.items())
        self.merge_keys, self.merge_rank = np.array([k for k, _, _ in table] or [-2], np.int64), np.array([n for _, n, _ in table] or [NO_RANK], np.int64)
        self.merge_to = np.zeros(len(model["merges"]), np.int64)
        for _, n, t in table:
            self.merge_to[n] = t
        # Only tokens that encode to themselves may be proposed.
        found = self.merge_all(list(parts.values()))
        self._trie({i: s for (i, s), f in zip(parts.items(), found) if len(s) == 1 or f == i.to_bytes(4, "little")})
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _trie(self, own: dict[int, list[int]]) -> None:
        """Edges node * 512 + symbol -> node, sorted for searchsorted, and the token at each node (-1: none)."""
        edges: dict[int, int] = {}
        token = [-1]
        for i, s in own.items():
            node = 0
            for x in s:
                key = node * 512 + x
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        self.edges = edges
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.token = np.array(token, np.int64)

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: the adjacent pair of the lowest rank first, the leftmost of equal ones."""
        ids = self.first[symbols].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := self.rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := self.rank.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, NO_RANK where there is no such merge or a side is -1."""
        keys = left << 17 | right
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == keys, self.merge_rank[at], NO_RANK)

    def _merge_block(self, symbols: list[list[int]]) -> list[bytes]:
        """merge() of words of similar lengths: a row each, padded with -1, and one merge in each row a round."""
        n, width = len(symbols), max(map(len, symbols)) + 1
        ids = np.full((n, width), -1, np.int64)
        lengths = np.array([len(s) for s in symbols])
        ids[np.arange(width) < lengths[:, None]] = self.first[list(chain.from_iterable(symbols))]
        rank, row, out = self._ranks(ids[:, :-1], ids[:, 1:]), np.arange(n), [b""] * n
        while len(row):
            at = rank.argmin(1)
            low = rank[np.arange(len(row)), at]
            done = np.flatnonzero(low == NO_RANK)
            if len(done):
                ended, counts = ids[done], (ids[done] >= 0).sum(1)
                packed, edge = ended[ended >= 0].astype("<u4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
                for r, i, j in zip(row[done].tolist(), edge, edge[1:]):
                    out[r] = packed[i:j]
                go = low != NO_RANK
                ids, rank, row, at, low = ids[go], rank[go], row[go], at[go], low[go]
                if not len(row):
                    break
            each, cols = np.arange(len(row)), np.arange(width)
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), width - 1), 1)
            rank = np.take_along_axis(rank, np.minimum(cols[:-1] + (cols[:-1] > at[:, None]), width - 2), 1)
            ids[each, at] = new = self.merge_to[low]
            rank[each, at] = self._ranks(new, ids[each, at + 1])
            h = np.flatnonzero(at)
            rank[h, at[h] - 1] = self._ranks(ids[h, at[h] - 1], new[h])
        return out

    def merge_all(self, symbols: list[list[int]]) -> list[bytes]:
        """merge() of many words as packed ids. Words go in blocks of similar lengths and bounded size."""
        out, order, i = [b""] * len(symbols), sorted(range(len(symbols)), key=lambda k: -len(symbols[k])), 0
        while i < len(order):
            block = order[i : i + max(1, BLOCK_CELLS // (len(symbols[order[i]]) + 1))]
            for k, ids in zip(block, self._merge_block([symbols[k] for k in block])):
                out[k] = ids
            i += len(block)
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether the symbols of the two tokens encode to just these two. A token that ends a word fits nothing after it."""
        key = a << 17 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.parts[a] + self.parts[b]) == [a, b]
        return known

    def _test(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """fits() of many pairs: a look-up in a sorted table, which first gets the pairs that it lacks."""
        keys, where = np.unique(left << 17 | right, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(len(self.pair_keys) - 1, 0))
        lacking = keys[self.pair_keys[at] != keys] if len(self.pair_keys) else keys
        if len(self.pair_keys) > CACHE_PAIRS:
            self.pair_keys, self.pair_fits, lacking = np.zeros(0, np.int64), np.zeros(0, bool), keys
        if len(lacking):
            pairs = [(k >> 17, k & 0x1FFFF) for k in lacking.tolist()]
            merged = self.merge_all([self.parts[a] + self.parts[b] for a, b in pairs])
            found = np.array([m == a.to_bytes(4, "little") + b.to_bytes(4, "little") for m, (a, b) in zip(merged, pairs)], bool)
            all_keys = np.concatenate([self.pair_keys, lacking])
            order = np.argsort(all_keys)
            self.pair_keys, self.pair_fits = all_keys[order], np.concatenate([self.pair_fits, found])[order]
        return self.pair_fits[np.searchsorted(self.pair_keys, keys)][where]

    def _propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: (word, token) in order."""
        at, word = starts.copy(), np.arange(len(starts))
        out_word, out_token = [], []
        while len(word):
            node, best, reach = np.zeros(len(word), np.int64), np.full(len(word), -1), at.copy()
            live, pos = np.arange(len(word)), at.copy()
            while len(live):
                keys = node[live] * 512 + symbols[pos[live]]
                e = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
                hit = self.edge_keys[e] == keys
                live, e = live[hit], e[hit]
                node[live] = self.edge_to[e]
                pos[live] += 1
                t = self.token[node[live]]
                ok = t >= 0
                best[live[ok]], reach[live[ok]] = t[ok], pos[live[ok]]
                live = live[pos[live] < ends[word[live]]]
            out_word.append(word)
            out_token.append(best)
            go = reach < ends[word]
            at, word = reach[go], word[go]
        word, token = np.concatenate(out_word), np.concatenate(out_token)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _long(self, symbols: list[int]) -> list[int]:
        """A very long word: the same proposal and test, one token after the other."""
        ids, i = [], 0
        while i < len(symbols):
            node, best, j = 0, -1, i
            for k in range(i, len(symbols)):
                node = self.edges.get(node * 512 + symbols[k], -1)
                if node < 0:
                    break
                if self.token[node] >= 0:
                    best, j = int(self.token[node]), k + 1
            if ids and not self.fits(ids[-1], best):
                return self.merge(symbols)
            ids.append(best)
            i = j
        return ids

    def learn(self, new: list[str]) -> None:
        """Encodes words that are not known yet."""
        raw = [w.encode() for w in new]
        for w, b in zip(new, raw):
            if len(b) > LONG_WORD:
                self.known[w] = np.array(self._long([*b[:-1], b[-1] + 256]), "<u4").tobytes()
        short = [(w, b) for w, b in zip(new, raw) if len(b) <= LONG_WORD]
        if not short:
            return
        symbols = np.frombuffer(b"".join(b for _, b in short), np.uint8).astype(np.int64)
        ends = np.cumsum([len(b) for _, b in short])
        starts = np.concatenate([[0], ends[:-1]])
        symbols[ends - 1] += 256
        word, token = self._propose(symbols, starts, ends)
        joint = word[1:] == word[:-1]
        bad = np.zeros(len(word), bool)
        bad[1:][joint] = ~self._test(token[:-1][joint], token[1:][joint])
        packed, edge = token.astype("<u4").tobytes(), (4 * np.searchsorted(word, np.arange(len(short) + 1))).tolist()
        self.known.update((w, packed[i:j]) for (w, _), i, j in zip(short, edge, edge[1:]))
        failing = np.unique(word[bad]).tolist()
        again = self.merge_all([symbols[starts[i] : ends[i]].tolist() for i in failing])
        self.known.update((short[i][0], ids) for i, ids in zip(failing, again))

    def _spoken(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii():
            return self.words.findall(text.lower())
        try:
            text.encode("latin-1")  # composed already
        except UnicodeEncodeError:
            if self.unassigned.search(text):
                return self._by_file(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case knows no final sigma here
        return self.words.findall(_spaces.sub(" ", text.lower()))

    def _by_file(self, text: str) -> list[str]:
        """The same for a text with characters newer than this Python's tables: the library's own tables decide."""
        if self.file is None:
            from tokenizers import Tokenizer

            self.file = Tokenizer.from_file(self.path)
        text = self.file.normalizer.normalize_str(text)
        return [text[i:j] for _, (i, j) in self.file.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            if "<|" in t and self.special:
                parts, at = [], 0
                for m in self.cut.finditer(t):
                    parts += [*self._spoken(t[at : m.start()]), m[0]]
                    at = m.end()
                split.append(parts + self._spoken(t[at:]))
            else:
                split.append(self._spoken(t))
        special = {w: np.array([i], "<u4").tobytes() for w, i in self.special.items()}
        needed = set(chain.from_iterable(split)).difference(special)
        if len(self.known) + len(needed) > CACHE_WORDS:  # bounded memory: words that come again outlive those that don't
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for w in needed:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        self.learn(new)
        known.update(special)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between them, as the file has no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _loaded:
        begin("bpe")
        hold("bpe", _loaded.clear)
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def batches(texts: list[str], limit: int = 1 << 21):
    """Slices of texts of about limit characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < limit):
            size += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def bpe_ids(text: Column, path: str) -> Column:
    """The token ids of each text as binary (little-endian unsigned 32-bit)."""

    @arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        texts = column.fill_null("").to_pylist()
        return pa.array([x for part in batches(texts) for x in bpe.encode(part)], pa.binary())

    return encode(text)


def bpe_text(ids: Column, path: str) -> Column:
    """The decoded text of ids as bpe_ids() gives them."""

    @arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        return pa.array([bpe.decode(x or b"") for x in column.to_pylist()], pa.string())

    return decode(ids)


def encode_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (binary) and decoded, the text of the ids, for each document. Rows leave in slices of
    a few MB, so that a batch's ids and texts are never held together."""
    ship(docs.sparkSession)

    def work(rows):
        bpe = tokenizer(path)
        for batch in rows:
            at = 0
            for part in batches(batch.column(2).fill_null("").to_pylist()):
                ids = bpe.encode(part)
                said = pa.array([bpe.decode(x) for x in ids], pa.string())
                head = batch.slice(at, len(part))
                columns = [head.column(0), head.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), said]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "n_tokens", "ids", "decoded"])
                at += len(part)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id long, source string, n_tokens long, ids binary, decoded string")


def bpe_digest(text: Column, path: str) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, then decoded from the ids."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    @arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digest(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        counts, ids, said = [], [], []
        for part in batches(column.fill_null("").to_pylist()):
            for x in bpe.encode(part):
                counts.append(len(x) // 4)
                ids.append(hashlib.sha256(x).hexdigest())
                said.append(hashlib.sha256(bpe.decode(x).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], fields=fields)

    return digest(text)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe_digest(F.col("text"), path or vocabulary()).alias("t")).select("doc_id", "t.*")
