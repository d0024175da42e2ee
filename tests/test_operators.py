"""Operators that SQL does not express, and edge cases, against plain sequential versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symloom.operators import coding, contexts, dictionary, folds, merging, mixing, neural, transforms
from symloom.plans.queries import QUERIES
from symloom.plans.storage import cut, write_bytes
from symloom.sources import model_file
from symloom.sources import sequences as S
from symloom.streaming import scoring

SF = "/root/testdata/sf0.001"
SEQUENCES = {1: "", 2: "a", 3: "aaaa", 4: "abab", 5: "aaaaa", 6: "banana", 7: "mississippi", 8: "abcabcabcx", 9: "aab" * 11, 10: "ab" * 33}


@pytest.fixture
def tokens(spark):
    rows = [(s, i, c) for s, text in SEQUENCES.items() for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "seq long, pos long, tok string")


def lists(df, column="tok"):
    out = {}
    for r in df.orderBy("seq", "pos").collect():
        out.setdefault(r.seq, []).append(r[column])
    return out


def test_rotations_and_transform(tokens):
    got = lists(transforms.bwt(tokens, cut))
    for s, text in SEQUENCES.items():
        if text:
            order = sorted(range(len(text)), key=lambda i: (text[i:] + text[:i], i))
            assert got[s] == [text[i - 1] for i in order]


def test_transform_round_trip(tokens):
    assert lists(transforms.bwt_inverse(transforms.bwt(tokens, cut))) == {s: list(t) for s, t in SEQUENCES.items() if t}


def test_merge_is_leftmost_and_not_overlapping(tokens):
    merged = dictionary.merge_once(tokens, dictionary.top_pair(tokens))
    got = lists(merged)
    assert got[3] == ["a\x01a", "a\x01a"]
    assert got[5] == ["a\x01a", "a\x01a", "a"]
    assert got[4] == ["a\x01b", "a\x01b"]
    assert lists(dictionary.expand_merges(merged)) == lists(tokens)


def test_top_pair_tie_goes_to_the_first_complete(spark):
    rows = [(1, i, c) for i, c in enumerate("abxcdxabycd")]
    df = spark.createDataFrame(rows, "seq long, pos long, tok string")
    r = dictionary.top_pair(df).collect()[0]
    assert (r.l, r.r, r.n) == ("a", "b", 2)


def test_last_match_alternates(spark):
    text = [1, 2, 3, 1, 2, 4, 1, 2, 3, 1, 2, 3]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "seq long, pos long, id long")
    slot = (1 * 7919 + 2 * 104729 + 1000003) & 0xFFFFFF
    r = folds.last_match(df).where(f"slot = {slot}").collect()[0]
    assert (r.id, r.cnt) == (3, 2)  # 3:1, 4 takes over, 3 takes over, 3 again


def dense_bits(toks):
    """Count, context, match and recency models by a full distribution at each position."""
    kinds, out = sorted(set(toks)), []
    for i, (t, delta) in enumerate(zip(toks, mixing.context_deltas(toks))):
        logit = {j: 0.1 * math.log(toks[:i].count(j) + 1) + delta.get(j, 0.0) for j in kinds}
        z = sum(math.exp(x) for x in logit.values())
        out.append(math.log2(z) - logit[t] / math.log(2))
    return out


@pytest.mark.parametrize("text", ["abracadabra" * 4, "aaaaaa", "abcdefgh", "x", "ab" * 40])
def test_sparse_denominator(text):
    assert np.allclose(mixing.context_bits(list(text)), dense_bits(list(text)))


def test_context_deltas_by_hand():
    deltas = list(mixing.context_deltas(list("abab")))
    assert not deltas[0] and set(deltas[3]) == {"a", "b"}
    want = 0.15 * math.log(1 + 1 / 0.1) + 0.05 * math.exp(-3 / 64)  # order 1 saw a -> b; b is one symbol old
    assert deltas[3]["b"] == pytest.approx(want)


def test_modes_rank_as_expected(spark):
    count = QUERIES["code_length_count_only"](spark, SF).agg({"total_bits": "sum"}).first()[0]
    ngram = QUERIES["code_length_ngram"](spark, SF).agg({"total_bits": "sum"}).first()[0]
    assert ngram < count


def test_hits_fall_with_longer_contexts(spark):
    rows = [QUERIES[f"ngram_hits_k{k}"](spark, SF).first() for k in (1, 2, 3, 7)]
    rates = [r.context_hits / r.positions for r in rows]
    assert rates == sorted(rates, reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(coding.MODES))
def test_archive_round_trip(data, mode):
    assert coding.decompress(coding.compress(data, mode)) == data


@pytest.mark.parametrize("mode", coding.MODES)
@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 3, b"\0" * 5000, "aé漢".encode() * 50, b"ab" * 4096 + b"c", bytes(4097)])
def test_archive_edges(data, mode):
    packed = coding.compress(data, mode)
    assert coding.decompress(packed) == data
    if len(data) > 4000:
        assert len(packed) < len(data) / 8


def test_archives_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, k, n).astype(np.uint8).tobytes() for k, n in [(2, 9000), (250, 700), (5, 4096), (100, 4097), (3, 1), (256, 6000)]] + [b""]
    modes = [coding.MODES[i % 4] for i in range(len(rows))]
    together = coding.compress_many(rows, modes)
    assert together == [coding.compress(r, m) for r, m in zip(rows, modes)]
    assert coding.decompress_many(together[::-1]) == rows[::-1]
    with pytest.raises(ValueError):
        coding.decompress(b"none" + together[0][4:])


def test_archives_code_what_the_model_says():
    """The payload is as long as the ranges of the model say, to a few bytes."""
    text = ("the cat sat on the mat and the dog sat on the cat " * 30).encode()
    x, places = np.unique(np.frombuffer(text, np.uint8), return_inverse=True)
    model, bits = coding.Lanes(1, len(x) + 1, np.array([len(x)])), 0.0
    for s in places:
        ends = model.ranges(1)[0]
        bits -= np.log2((ends[s] - (ends[s - 1] if s else 0)) / coding.TOTAL)
        model.learn(1, np.array([s]))
    assert abs(len(coding.encode_lanes([places], np.array([len(x)]))[0]) - bits / 8) < 8
    assert bits < 0.4 * 8 * len(text)


def test_block_transforms_by_hand():
    x = np.frombuffer(b"banana", np.uint8).astype(np.int64)
    order = coding.rotations(x)
    assert order.tolist() == sorted(range(6), key=lambda i: (b"banana"[i:] + b"banana"[:i], i))
    assert coding.unrotated(x[order - 1], order.tolist().index(0)).tolist() == x.tolist()
    y, pairs = coding.merged(np.array([97] * 7), 3)
    assert pairs == [(97, 97)] and y.tolist() == [256, 256, 256, 97]
    y, pairs = coding.merged(np.array([97, 98, 97, 98, 97, 98]), 2)
    assert pairs == [(97, 98), (256, 256)] and y.tolist() == [257, 256] and coding.unmerged(y, pairs).tolist() == [97, 98] * 3


def test_first_difference(spark):
    rows = [(b"abc", b"abc"), (b"abc", b"abd"), (b"abc", b"ab"), (b"", b"x"), (b"x" * 999 + b"y", b"x" * 1000), (b"a", None)]
    df = spark.createDataFrame([tuple(None if x is None else bytearray(x) for x in r) for r in rows], "a binary, b binary")
    assert [r[0] for r in df.select(coding.first_difference(F.col("a"), F.col("b"))).collect()] == [None, 2, 2, 0, 999, None]


def test_tokenizer_file():
    symbols = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b"zz"]
    of_byte = [i if i != 7 else -1 for i in range(256)]
    data = model_file.pack(of_byte, symbols, [(97, 98, 256), (256, 99, 257), (97, 98, 258), (97, 999, 258), (122, 122, 258)])
    bytes_, known, merges = model_file.unpack(data)
    assert known == symbols and bytes_ == [max(x, 0) for x in of_byte]
    assert merges == {(97, 98): (0, 256), (256, 99): (1, 257), (122, 122): (4, 258)}  # the first counts, unknown ids keep their rank
    big = model_file.unpack(model_file.pack(of_byte, [b"x" * 255] * 3000, []))[1]
    assert len(b"".join(big)) <= model_file.POOL and big[-1] == b"" and big[0] == b"x" * 255
    with pytest.raises(ValueError):
        model_file.unpack(b"nope" + data[4:])


def test_gaussians_continue_a_stream():
    x, state = neural.gaussians(1000, neural.SEED)
    a, s = neural.gaussians(400, neural.SEED)
    b, t = neural.gaussians(600, s)
    assert (np.concatenate([a, b]) == x).all() and t == state
    assert abs(x.mean()) < 0.15 and abs(x.std() - 1) < 0.1


@given(st.sets(st.integers(0, 50000), min_size=1, max_size=200))
@settings(max_examples=50, deadline=None)
def test_rice_round_trip(ids):
    ids = sorted(ids)
    assert coding.rice_unpack(coding.rice_pack(ids), len(ids)) == ids


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    p = {k: x.astype(np.float64) for k, x in neural.initial(5).items()}
    for k in p:
        p[k] = p[k] + rng.normal(0, 0.1, p[k].shape)
    toks = np.array([0])  # one position: nothing flows through time
    state = [(np.zeros((3, 64)), rng.normal(0, 0.1, (64, 16))) for _ in range(2)]

    def loss():
        logits, _, keep = neural.forward(p, state, toks)
        return float(np.log(np.exp(logits).sum()) - logits[0, 2]), logits, keep

    _, logits, keep = loss()
    d = neural._probabilities(logits)
    d[0, 2] -= 1
    g = neural.gradient(p, keep, toks, d)
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        if k == "emb":
            i = (0, i[1])
        old, h = p[k][i], 1e-5
        p[k][i] = old + h
        up = loss()[0]
        p[k][i] = old - h
        down = loss()[0]
        p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * h), abs=2e-4), k


def test_model_learns_a_pattern():
    bits = neural.model_bits(list("abcd" * 60), False)
    assert sum(bits[-40:]) < 0.5 * sum(bits[:40])
    assert bits[0] == pytest.approx(2.0)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "one"), (4, "a b")], "doc_id long, text string")

    packed = S.packed_words(docs)
    assert contexts.with_context(packed, 1).count() == 1
    assert contexts.with_context(packed, 31).count() == 0
    assert {r.seq: r.n for r in mixing.context_code_length(packed).collect()} == {1: 0, 2: 0, 3: 1, 4: 2}


def test_chunk_boundaries(spark):
    rows = [(n, i, "x") for n in (31, 32, 33, 64, 65) for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, pos long, tok string")
    got = {(r.seq, r.chunk): r.n for r in folds.chunks(df).collect()}
    assert got == {(31, 0): 31, (32, 0): 32, (33, 0): 32, (33, 1): 1, (64, 0): 32, (64, 1): 32, (65, 0): 32, (65, 1): 32, (65, 2): 1}


def test_random_sequences_round_trip(spark):
    random.seed(5)
    rows = [(s, i, random.choice("ab")) for s in range(20) for i in range(random.randint(1, 40))]
    df = spark.createDataFrame(rows, "seq long, pos long, tok string")
    assert lists(transforms.bwt_inverse(transforms.bwt(df, cut))) == lists(df)


def plain_merges(data, ranks):
    ids = list(data)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        if not found:
            return ids
        _, i = min(found)
        ids[i : i + 2] = [ranks[ids[i], ids[i + 1]][1]]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_merging_order(data):
    ranks = {(97, 97): (0, 256), (97, 98): (1, 257), (256, 256): (2, 258), (257, 99): (3, 259), (98, 258): (4, 260)}
    ids = merging.encode_bytes(data, ranks)
    assert ids == plain_merges(data, ranks)
    assert b"".join(map(merging.expansions(ranks).__getitem__, ids)) == data


def test_stream_over_several_batches(spark, tmp_path):
    """Three micro-batches: the state goes on, and an event that comes too late is scored after what came before it."""
    import datetime as dt
    import os

    day = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [
        [(1, day(1), 7, "view"), (2, day(2), 7, "click"), (3, day(3), 8, "view")],
        [(4, day(5), 7, "view"), (6, day(4), 7, "error"), (5, day(6), None, "view")],
        [(7, day(3), 7, "click"), (8, day(7), 7, "view"), (9, day(2), 8, "view")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next(x for x in (tmp_path / f"w{i}").iterdir() if x.name.startswith("part"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    order = {7: [1, 2, 6, 4, 7, 8], 8: [3, 9], None: [5]}
    kind = {r[0]: r[3] for rows in batches for r in rows}
    for contexts_too in (False, True):
        base = f"file://{tmp_path}/s{contexts_too}"
        got = scoring.run_available(spark, f"file://{tmp_path}/in/*.parquet", f"{base}/out", f"{base}/state", contexts_too, files=1).collect()
        coder = {s: (mixing.Coder if contexts_too else scoring.CountCoder)(sorted(scoring.ALPHABET)) for s in order}
        want = {i: (s, round(coder[s].bits(kind[i]), 6), i in (7, 9)) for s, ids in order.items() for i in ids}
        assert {r.event_id: (r.seq, r.bits, r.late) for r in got} == want


def test_periodic_decay_by_hand(spark):
    rows = [(1, p, t, "c") for p, t in enumerate("aaaaaabaaaab")]
    got = contexts.periodically_decayed(spark.createDataFrame(rows, "seq long, pos int, tok string, ctx string"), 5).collect()
    plain: dict = {}
    for _, p, t, _ in rows:
        if p and p % 5 == 0:
            plain = {k: v >> 1 for k, v in plain.items()}
        plain[t] = plain.get(t, 0) + 1
    assert {r.tok: r.n for r in got} == {k: v for k, v in plain.items() if v}


def test_tokens_are_the_text(spark):
    texts = ["", None, "a", " ", "Héllo, wörld!\n\n", "漢字 x 漢字", "..a..b..", "no_under-score  ", "\x01\t\x0b", "e\u0301 ß × ÷ 9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.packed_words(docs).collect():
        assert "".join(r.toks) == (texts[r.seq] or "") and all(r.toks)


def test_model_code_length_is_the_plain_one():
    """The chunked online model against one that goes symbol by symbol through the same pieces."""
    toks = list("abacabadabacaba" * 5)
    for with_contexts in (False, True):
        got = neural.model_bits(toks, with_contexts)
        names = sorted(set(toks))
        ids, p = [names.index(t) for t in toks], neural.initial(len(names))
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        state = [(np.zeros((neural.TAPS - 1, neural.INNER), np.float32), np.zeros((neural.INNER, neural.STATE), np.float32)) for _ in range(neural.LAYERS)]
        saved, chunk, logits, step, counts, plain = state, [], None, 0, np.zeros(len(names)), []
        for i, s in enumerate(ids):
            base, scale = np.zeros(len(names)), 1.0
            if logits is not None:
                base = logits.astype(float)
                q = np.exp(base - base.max()) / np.exp(base - base.max()).sum()
                scale = float(np.clip(0.4 + 0.6 * -(q * np.log(q)).sum() / 5.5, 0.2, 2.5))
            base = base + 0.1 * np.log(counts + 1)
            if with_contexts:
                for j, d in list(mixing.context_deltas(toks[: i + 1]))[-1].items() if i else []:
                    base[names.index(j)] += scale * d
            plain.append(float(-np.log2(np.exp(base[s] - base.max()) / np.exp(base - base.max()).sum())))
            counts[s] += 1
            out, state, _ = neural.forward(p, state, np.array([s]))
            logits, chunk = out[0], chunk + [s]
            if len(chunk) == neural.CHUNK or i == len(ids) - 1:
                part = np.array(chunk)
                for _ in range(neural.passes(i // neural.CHUNK) if len(part) > 1 else 0):
                    guess, _, keep = neural.forward(p, saved, part[:-1])
                    e = np.exp(guess - guess.max(1, keepdims=True))
                    target = np.full(guess.shape, neural.SMOOTH / len(names), np.float32)
                    target[np.arange(len(part) - 1), part[1:]] += 1 - neural.SMOOTH
                    step += 1
                    neural._step(p, neural.gradient(p, keep, part[:-1], (e / e.sum(1, keepdims=True) - target).astype(np.float32)), m, v, len(part) - 1, step)
                out, state, _ = neural.forward(p, saved, part)
                saved, chunk, logits = state, [], out[-1]
        assert np.allclose(got, plain, atol=2e-3)


def test_listed_code_length_is_the_stepwise_one(monkeypatch):
    rng = np.random.default_rng(3)
    seqs = [list("aaaaaaaaaa" * 9), list("abcabcabcx" * 12), ["x"], [], [str(v) for v in rng.integers(0, 9, 700)], [str(v) for v in rng.integers(0, 400, 300)], list("abracadabra" * 20)]
    plain = [mixing.context_bits(t) for t in seqs]
    got = mixing.batch_bits(seqs)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got, plain))
    monkeypatch.setattr(mixing, "MOST_PAIRS", 50)
    assert mixing.batch_bits(seqs) is None
    assert np.allclose(mixing._totals(seqs), [sum(b) for b in plain])


def test_tokenizer_file_as_tables(spark, tmp_path):
    of_byte = [-1 if i == 65 else 255 - i for i in range(256)]
    write_bytes(spark, f"file://{tmp_path}/t.bin", model_file.pack(of_byte, [bytes([255 - i]) for i in range(256)] + [b"ab"], [(158, 157, 256)]))
    symbols, merges, bytes_ = model_file.read(spark, f"file://{tmp_path}/t.bin")
    assert symbols.count() == 257 and [tuple(r) for r in merges.collect()] == [(158, 157, 256, 0)]
    rows = spark.createDataFrame([(1, p, b) for p, b in enumerate(b"aA\xff\x00")], "seq long, pos int, byte long")
    got = sorted(model_file.base_symbols(rows, bytes_).collect())
    assert [r.tok for r in got] == [158, 0, 0, 255]  # a byte without a symbol reads as symbol 0


@pytest.fixture
def repeated(spark, tmp_path):
    """A folder whose documents have rows of one id, of none, and without text."""
    rows = [(7, "ab ab ab, ab ab."), (7, "b a b a"), (7, "ab ab ab, ab ab."), (None, "x y x y x"), (3, None), (4, ""), (5, "é b\x01a " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def exchanges(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


@pytest.mark.parametrize("k", [2, 15, 31])
def test_counts_move_texts_only(spark, repeated, k):
    """contexts are counted where the texts are, rows of one id together."""
    d, rows = repeated
    out = QUERIES[f"ngram_counts_k{k}"](spark, d)
    assert [("doc_id" in x, "ctx" in x) for x in exchanges(out)] == [(True, False)]
    want = Counter()
    for seq, text in rows:
        w = re.findall(S.WORD.replace(r"\x{C0}-\x{24F}", "\xc0-ɏ"), text or "")
        want.update((seq, hashlib.md5("\x01".join(w[i - k : i]).encode()).hexdigest(), w[i]) for i in range(k, len(w)))
    assert Counter({(r.seq, r.ctx, r.tok): r.n for r in out.collect()}) == want
    assert (sum(want.values()) > 0) and len(out.collect()) == len(want)


@pytest.mark.parametrize("k", [1, 15])
def test_counts_hold_no_table_of_pairs(spark, tmp_path, k):
    """only texts are aggregated, so what is held or spilled does not grow with positions in a partition."""
    rows = [(1, "a" + " a" * 70000), (1, "a b" * 20), (2, "a\x01 a " * 9), (3, "a" + " a" * k)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES[f"ngram_counts_k{k}"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert {x.split("keys=")[1].split("#")[0] for x in plan if "Aggregate" in x} == {"[doc_id"}
    assert not any("Exchange" in x and "doc_id" not in x or "Sort" in x or "Window" in x for x in plan)
    want = Counter()
    for seq, text in rows:
        w = re.findall(S.WORD.replace(r"\x{C0}-\x{24F}", "\xc0-ɏ"), text)
        want.update((seq, hashlib.md5("\x01".join(w[i - k : i]).encode()).hexdigest(), w[i]) for i in range(k, len(w)))
    got = [tuple(r) for r in out.select("seq", "ctx", "tok", "n").collect()]
    assert sorted(got) == sorted((*x, min(n, 65535)) for x, n in want.items()) and 65535 in {x[3] for x in got}


def test_packed_transform(spark):
    """rows of arrays are transformed as sequences of positions are."""
    packed = spark.createDataFrame([(s, list(t)) for s, t in SEQUENCES.items()], "seq long, toks array<string>")
    last = {r.seq: r for r in transforms.bwt_packed(packed).collect()}
    for s, text in SEQUENCES.items():
        order = sorted(range(len(text)), key=lambda i: (text[i:] + text[:i], i))
        assert last[s].toks == [text[i - 1] for i in order] and last[s].primary == (order.index(0) if text else 0)
    back = transforms.bwt_packed_inverse(transforms.bwt_packed(packed))
    assert {r.seq: r.toks for r in back.collect()} == {s: list(t) for s, t in SEQUENCES.items()}


def test_round_trip_of_repeated_ids(spark, repeated):
    """each row is a sequence of its own, as the SQL has it."""
    d, rows = repeated
    got = Counter(map(tuple, QUERIES["bwt_roundtrip"](spark, d).select("seq", "pos", "tok").collect()))
    want = Counter()
    for seq, text in rows:
        want.update((seq, i, t) for i, t in enumerate(re.findall(S.WORD.replace(r"\x{C0}-\x{24F}", "\xc0-ɏ"), text or "")))
    assert got == want


def test_archive_sizes_of_repeated_ids(spark, repeated):
    """texts move once for all modes, and a row has one size in each mode."""
    d, rows = repeated
    out = QUERIES["archive_sizes"](spark, d)
    assert len(exchanges(out)) == 1
    data = [(seq, (text or "").encode()) for seq, text in rows]
    want = Counter((seq, m, len(x), len(coding.compress(x, m))) for seq, x in data for m in coding.MODES)
    assert Counter(tuple(r) for r in out.select("seq", "mode", "bytes", "coded").collect()) == want
