"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths measure the characters inside
duplicated n-grams and lines.

A text fails the base rules with fewer than 50 words, or with over half of its words in 3-word windows that the text
has twice or more. Beyond these the verdict is the coverage's alone: a text is kept unless the share of its word characters
inside n-grams found twice or more, or inside lines that it has earlier, exceeds the shares in RULES, which are lower for
longer repeats. Symbols and capitals are counted and reported, and decide nothing.

Cases: null and empty texts have no words, shares of 0, and fail the base rules; rows repeat, tie and carry further columns
freely, as each row is judged alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from symloom.llm import arrays as A
from symloom.llm.common import begin, ship

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: n-gram lengths in words, with the greatest share of word characters inside n-grams found twice or more; the greatest
#: share inside lines found earlier.
RULES = {"grams": {4: 0.3, 6: 0.25, 10: 0.2}, "lines": 0.15}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


def _repeated(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each id is found twice or more in its text, and whether it is found earlier there."""
    order = np.lexsort((ids, text))  # stable: of equal ones the first comes first
    a, t = ids[order], text[order]
    same = (a[1:] == a[:-1]) & (t[1:] == t[:-1])
    twice, later = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    twice[order[1:][same]] = True
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def _covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items lie in one of the windows of k items that begin at at."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, rules: dict = RULES) -> dict[str, np.ndarray]:
    """Counts, shares and verdicts of the texts of a piece."""
    n = len(offsets) - 1
    starts, ends, first = A.words(data, offsets)
    text = A.owner(first)
    out = {"n_words": np.diff(first)}
    begins = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(begins & ~A.BLANK[data])])
    length = points[ends] - points[starts]
    out["word_chars"] = points[offsets[1:]] - points[offsets[:-1]]
    out["n_symbols"] = A.per_text(_IS_SYMBOL[data], offsets)
    ids = A.span_ids(data, starts, ends)

    at, gram = A.windows(ids, first, 3)
    twice, _ = _repeated(gram, text[at])
    out["n_repeat_words"] = np.bincount(text[_covered(at[twice], 3, len(ids))], minlength=n)

    begin, end, line_first = A.lines(data, offsets)
    of = A.owner(line_first)
    real = points[end] > points[begin]
    begin, end, of = begin[real], end[real], of[real]
    _, later = _repeated(A.span_ids(data, begin, end), of)
    out["n_dup_lines"] = np.bincount(of[later], minlength=n)
    chars = np.maximum(out["word_chars"], 1)
    out["line_share"] = np.bincount(of[later], (points[end] - points[begin])[later], minlength=n) / chars

    worst = np.zeros(n, bool)
    for k, most in rules["grams"].items():
        at, gram = A.windows(ids, first, k)
        twice, _ = _repeated(gram, text[at])
        held = _covered(at[twice], k, len(ids))
        out[f"gram{k}_share"] = share = np.bincount(text[held], length[held], minlength=n) / chars
        worst |= share > most
    worst |= out["line_share"] > rules["lines"]
    out["n_capitals"] = A.per_text((data >= 65) & (data <= 90), offsets)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~worst
    return out


def quality_rules(text: Column, rules: dict = RULES) -> Column:
    """A struct of counts, shares and verdicts (base_failed, kept) for each text."""
    names = [*_COUNTS, "line_share", *(f"gram{k}_share" for k in rules["grams"]), "base_failed", "kept"]
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_()}
    fields = [pa.field(x, kinds.get(x, pa.float64() if "share" in x else pa.int64())) for x in names]
    ddl = ", ".join(f"{x}: {'boolean' if x in kinds else 'double' if 'share' in x else 'bigint'}" for x in names)

    @arrow_udf(f"struct<{ddl}>")
    def judge(column: pa.Array) -> pa.Array:
        begin("rules")
        parts = [measure(d, o, rules) for _, _, d, o in A.pieces(*A.flat(column))]
        cols = [pa.array(np.concatenate([p[x] for p in parts]) if parts else [], f.type) for x, f in zip(names, fields)]
        return pa.StructArray.from_arrays(cols, fields=fields)

    return judge(text)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", quality_rules(F.col("text")).alias("q")).select("doc_id", "q.*")
