"""Documents with what a corpus can hold, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, row long, t1 string, chunk string, idx int, uid long, kept string, lines string, `bad.name` int"


def texts() -> list[tuple[int | None, str | None]]:
    random.seed(11)
    say = lambda n: " ".join("".join(random.choices("abcdeéß", k=random.randint(1, 7))) for _ in range(n))
    base, passage = say(300), say(120)
    out: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Two Words"), (6, "two words"), (7, base), (8, base), (9, base.upper())]
    for i in range(10, 22):  # near copies
        w = base.split(" ")
        for _ in range(i - 8):
            w[random.randrange(len(w))] = "x" + str(random.random())
        out.append((i, " ".join(w)))
    out += [(i, f"{say(60)}\n{passage}\n{say(60)}") for i in range(30, 36)]
    out += [(i, f" Common Line \n{say(8)}\ncommon line\t\n{say(5)}") for i in range(40, 52)]
    out += [(60, "la la " * 3000), (61, "y" * 9000), (62, say(9000)), (63, "a b c\nd e f\na b c\na b c"), (64, "漢字 \x0b" * 30 + "İΣς <|endoftext|> é")]
    out += [(70, say(90)), (70, say(90)), (None, say(80)), (None, base)]
    out += out[6:7]  # a row twice
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, [None, "b", "a"][k % 3], "en", None, k, "t", "c", 1, 2, "k", "l", 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows: list, k: int, percent: int = 80) -> list[int]:
    """The number of the group of each row."""
    sets, top = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def removed(rows: list, length: int) -> list[tuple]:
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def line_drops(rows: list, most: int) -> list[tuple]:
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    lines = [(t or "").split("\n") for _, t in rows]
    docs = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for (i, _), ls in zip(rows, lines):
        kept = [x for x in ls if docs[key(x)] < most]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def base_rules(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    held = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(held), len(w) < 50 or 100 * len(held) > 50 * len(w)


def coverage(text: str | None, grams=(4, 6, 10)) -> dict[str, float]:
    """Shares of word characters inside n-grams found twice or more, and inside lines found earlier."""
    text = text or ""
    w = WORD.findall(text)
    chars = max(sum(map(len, w)), 1)
    out = {}
    for n in grams:
        at = defaultdict(list)
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append(i)
        held = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(n)}
        out[f"gram{n}_share"] = sum(len(w[i]) for i in held) / chars
    seen, later = set(), 0
    for line in text.split("\n"):
        if line in seen:
            later += sum(map(len, WORD.findall(line)))
        seen.add(line)
    return out | {"line_share": later / chars}
