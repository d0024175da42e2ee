"""Context statistics over sequences, causal: position i sees only positions before i.

The context of order k at a position is its last k symbols. All windows are keyed by (seq, context[, symbol]), so work is
spread over contexts, not sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weight and smoothing of each context order.
ORDERS = {1: (0.15, 0.1), 2: (0.10, 0.05), 3: (0.08, 0.03), 4: (0.06, 0.02), 5: (0.05, 0.015), 6: (0.04, 0.01), 7: (0.03, 0.008), 15: (0.50, 0.001), 31: (1.00, 0.001)}
PRIOR = 0.1
#: The last symbols that count as recent, and what the newest of them adds.
RING, RECENCY = 64, 0.05


def _with_runs(rows: DataFrame, n: int) -> DataFrame:
    """rows with the column rN: the n symbols from each position on, joined by U+0001. A run is joined from two shorter ones, so
    a position takes a few steps and not n."""
    if f"r{n}" in rows.columns:
        return rows
    a, b = (1, n - 1) if n % 2 else (n // 2, n // 2)
    rows, size = _with_runs(_with_runs(rows, a), b), F.greatest(F.size("toks") - (n - 1), F.lit(0))
    both = F.zip_with(F.slice(f"r{a}", F.lit(1), size), F.slice(f"r{b}", F.lit(a + 1), size), lambda x, y: F.concat(x, F.lit("\x01"), y))
    return rows.withColumn(f"r{n}", both)


def with_context(packed: DataFrame, k: int) -> DataFrame:
    """seq, pos, tok, ctx for all positions with k symbols before them, from seq, toks. ctx joins the symbols by U+0001."""
    # No filter on the size: it would be pushed below toks, and take the texts apart twice.
    long = _with_runs(packed.select("seq", "toks", F.col("toks").alias("r1")), k)
    size = F.greatest(F.size("toks") - k, F.lit(0))
    both = F.arrays_zip(F.slice("toks", F.lit(k + 1), size).alias("tok"), F.slice(f"r{k}", F.lit(1), size).alias("ctx"))
    rows = long.select("seq", F.posexplode(both).alias("i", "x"))
    return rows.select("seq", (F.col("i") + k).alias("pos"), "x.tok", "x.ctx")


def final_counts(ctx: DataFrame) -> DataFrame:
    """seq, ctx, tok, n after the whole sequence, held at 65535."""
    return ctx.groupBy("seq", "ctx", "tok").agg(F.least(F.count(F.lit(1)), F.lit(65535)).alias("n"))


def _run_of(rows: DataFrame, k: int) -> DataFrame:
    """rows with the column run: the k symbols from each position of toks on, joined by U+0001, null where one of them is missing.
    Long runs are joined from shorter ones, so a position takes a few steps and not k."""
    a = max((x for x in range(1, k + 1) if x * x <= k), default=1) if k > 7 else 1
    joined = lambda parts: F.concat(*[x for p in parts for x in (F.lit("\x01"), p)][1:])
    rows = rows.withColumn("part", F.transform("toks", lambda t, i: joined([t, *(F.get("toks", i + j) for j in range(1, a))]))) if a > 1 else rows.withColumn("part", F.col("toks"))
    whole = k // a * a
    ends = lambda i: [*(F.get("part", i + j) for j in range(a, whole, a)), *(F.get("toks", i + j) for j in range(whole, k))]
    return rows.withColumn("run", F.transform("part", lambda t, i: joined([t, *ends(i)])))


def counts_within(packed: DataFrame, k: int) -> DataFrame:
    """seq, ctx, tok, n as final_counts has them, from a row per sequence: seq, toks. A null in toks parts what shall not be joined.
    ctx is the MD5 of the context's symbols joined by U+0001. Each row sorts its own pairs and counts equal neighbours, so that no
    table of pairs is held or spilled, whatever the number of partitions is."""
    pairs = F.transform("run", lambda x, i: F.concat(F.md5(x), F.get("toks", i + k)))
    rows = _run_of(packed, k).select("seq", F.sort_array(F.filter(pairs, F.isnotnull)).alias("pairs"))
    starts = F.array_compact(F.transform("pairs", lambda x, i: F.when((i == 0) | (x != F.get("pairs", i - 1)), i)))
    # Not posexplode: its filter on the size would be pushed below the arrays, and make them for each position again.
    rows = rows.withColumn("starts", starts).select("seq", "pairs", "starts", F.posexplode_outer("starts").alias("i", "start")).where("start IS NOT NULL")
    n = F.coalesce(F.get("starts", F.col("i") + 1), F.size("pairs")) - F.col("start")
    pair = F.get("pairs", F.col("start"))
    return rows.select("seq", F.substring(pair, 1, 32).alias("ctx"), F.substring(pair, 33, 2**31 - 1).alias("tok"), F.least(n, F.lit(65535)).cast("long").alias("n"))


def decayed(counts: DataFrame) -> DataFrame:
    """Counts halved, empty ones dropped."""
    return counts.withColumn("n", F.shiftright("n", 1)).where("n > 0")


def periodically_decayed(ctx: DataFrame, every: int) -> DataFrame:
    """seq, ctx, tok, n at the end of the sequence, all counts being halved each time that a position is a multiple of every;
    empty ones dropped. Counts within an epoch are sums, so only epochs are folded."""
    epoch = F.floor(F.col("pos") / every)
    rows = ctx.groupBy("seq", "ctx", "tok", epoch.alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    last = ctx.groupBy("seq").agg(F.max(epoch).alias("last"))
    halved = lambda n, times: F.floor(n / F.pow(F.lit(2.0), times)).cast("long")
    none = F.struct(F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate("rows", none, lambda a, b: F.struct(b["epoch"].alias("epoch"), (halved(a["n"], b["epoch"] - a["epoch"]) + b["n"]).alias("n")))
    state = rows.groupBy("seq", "ctx", "tok").agg(F.array_sort(F.collect_list(F.struct("epoch", "n"))).alias("rows")).select("seq", "ctx", "tok", fold.alias("s"))
    out = state.join(last, "seq").select("seq", "ctx", "tok", halved(F.col("s.n"), F.col("last") - F.col("s.epoch")).alias("n"))
    return out.where("n > 0")


def causal(ctx: DataFrame) -> DataFrame:
    """ctx with c (how often the symbol has followed the context before), total (how often the context came before) and
    fanout (distinct symbols that have followed it)."""
    by_pair = W.partitionBy("seq", "ctx", "tok").orderBy("pos")
    by_ctx = W.partitionBy("seq", "ctx").orderBy("pos")
    rows = ctx.withColumn("c", (F.row_number().over(by_pair) - 1).cast("long"))
    rows = rows.withColumn("total", (F.row_number().over(by_ctx) - 1).cast("long"))
    new = F.when(F.col("c") == 0, 1).otherwise(0)
    return rows.withColumn("fanout", F.coalesce(F.sum(new).over(by_ctx.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def bias(c: Column, k: int) -> Column:
    """What order k adds to the logit of a symbol that followed the context c times."""
    weight, smooth = ORDERS[k]
    return weight * F.ln(1 + c / smooth)


def order_summary(packed: DataFrame, k: int) -> DataFrame:
    """One row for order k: positions, hits (context known), symbol hits, mean fan-out of known contexts, summed bias."""
    # What moves is a 128-bit hash of the context, not its words.
    short = F.struct(F.xxhash64("ctx").alias("h1"), F.xxhash64(F.lit(1), "ctx").alias("h2"))
    rows = causal(with_context(packed, k).withColumn("ctx", short))
    known = F.when(F.col("total") > 0, 1)
    return rows.agg(
        F.lit(k).alias("k"),
        F.count(F.lit(1)).alias("positions"),
        F.count(known).alias("context_hits"),
        F.count(F.when(F.col("c") > 0, 1)).alias("symbol_hits"),
        F.sum("fanout").alias("fanout_sum"),
        F.round(F.sum(bias(F.col("c"), k)), 2).alias("bias_sum"),
    )


def prior_counts(tokens: DataFrame) -> DataFrame:
    """tokens with n, how often the symbol came before in its sequence."""
    return tokens.withColumn("n", (F.row_number().over(W.partitionBy("seq", "tok").orderBy("pos")) - 1).cast("long"))


def recency(tokens: DataFrame, size: int = RING) -> DataFrame:
    """seq, pos, tok, seen (how often the symbol is among the last size symbols) and bonus: 0.05 * exp(-3 * age) for each,
    the newest at age 0, an age of 1 being size symbols."""
    back = F.collect_list("tok").over(W.partitionBy("seq").orderBy("pos").rowsBetween(-size, -1))
    rows = tokens.withColumn("ring", back)
    bonus = F.aggregate(
        F.transform("ring", lambda t, i: F.when(t == F.col("tok"), F.exp(-3.0 * (F.size("ring") - 1 - i) / size)).otherwise(0.0)),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    seen = F.size(F.filter("ring", lambda t: t == F.col("tok")))
    return rows.select("seq", "pos", "tok", seen.alias("seen"), (RECENCY * bonus).alias("bonus"))
