"""Named queries over the test tables, each with the same query in DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import numeric as N
from symloom.operators import coding, contexts, dictionary, folds, merging, mixing, neural, transforms
from symloom.plans.storage import cut, new_path, write_bytes
from symloom.sources import model_file
from symloom.sources import sequences as S
from symloom.streaming import scoring

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


T = f"WITH t AS ({S.WORDS_SQL})"
E = f"WITH t AS ({S.EVENTS_SQL})"
#: Positions with prior counts n and the running denominator z of the count model.
COUNTED = """, n AS (SELECT *, row_number() OVER (PARTITION BY seq, tok ORDER BY pos) - 1 AS n FROM t),
z AS (SELECT *, count(*) FILTER (n = 0) OVER (PARTITION BY seq) + coalesce(sum(pow(n + 2, 0.1) - pow(n + 1, 0.1))
  OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM n),
b AS (SELECT seq, pos, tok, log2(z) - 0.1 * log2(n + 1) AS bits FROM z)"""


def _dealt(spark, d) -> DataFrame:
    """The texts dealt by doc_id: they move once, what is made of them stays where it is, and many parts let it fit in memory."""
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return S.table(spark, d, "documents").select("doc_id", "text").repartition(parts, "doc_id")


# ---- sources and dictionaries -------------------------------------------------------------------------------------


@query(f"WITH t AS ({S.BYTES_SQL}) SELECT tok, count(*) AS n FROM t GROUP BY tok")
def byte_hist(spark, d) -> DataFrame:
    return S.text_bytes(spark, d).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@query(T + """, s AS (SELECT seq, tok, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY seq, tok)
SELECT *, row_number() OVER (PARTITION BY seq ORDER BY first_pos) - 1 AS cid FROM s""")
def vocab_first_seen(spark, d) -> DataFrame:
    return dictionary.first_seen(S.words(spark, d))


VOCAB = """, v AS (SELECT seq, tok, count(*) AS n FROM t GROUP BY seq, tok),
c AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY tok) - 1 AS cid FROM v)"""


@query(T + VOCAB + " SELECT seq, tok, n, cid FROM c")
def vocab_compact(spark, d) -> DataFrame:
    return dictionary.compact(S.words(spark, d))


@query(T + VOCAB + " SELECT seq, pos, cid FROM t JOIN c USING (seq, tok)")
def remap_tokens(spark, d) -> DataFrame:
    tokens = S.words(spark, d)
    return dictionary.remap(tokens, dictionary.compact(tokens))


@query("SELECT doc_id AS seq, text FROM documents WHERE text <> ''")
def detokenize(spark, d) -> DataFrame:
    """The texts again, from compact ids and vocabularies."""
    tokens = S.words(spark, d)
    vocabulary = dictionary.compact(tokens)
    return dictionary.joined(dictionary.restore(dictionary.remap(tokens, vocabulary), vocabulary), "")


CODES = f"WITH v AS (SELECT DISTINCT seq, ('0x' || tok)::BIGINT AS id FROM ({S.BYTES_SQL})), g AS (SELECT seq, count(*) AS ve, max(id) AS last FROM v GROUP BY seq)"
KS = "list_max(list_filter(range(0, 16), lambda k: k = 0 OR pow(2, k) < floor(CASE WHEN ve > 1 THEN last / (ve - 1) ELSE last END + 0.5)))"


def _byte_ids(spark, d) -> DataFrame:
    return S.text_bytes(spark, d).select("seq", F.conv("tok", 16, 10).cast("long").alias("id")).distinct()


@query(CODES + " SELECT seq, id, id - lag(id, 1, 0) OVER (PARTITION BY seq ORDER BY id) AS delta FROM v")
def vocab_deltas(spark, d) -> DataFrame:
    return dictionary.vocabulary_deltas(_byte_ids(spark, d))


@query(CODES + f""", k AS (SELECT seq, ve, {KS} AS k FROM g), e AS (SELECT seq, id - lag(id, 1, 0) OVER (PARTITION BY seq ORDER BY id) AS delta FROM v)
SELECT seq, ve, k, sum(floor(delta / pow(2, k)) + 1 + k)::BIGINT AS bits FROM e JOIN k USING (seq) GROUP BY ALL""")
def vocab_rice_bits(spark, d) -> DataFrame:
    return dictionary.vocabulary_rice(_byte_ids(spark, d))


@query("""WITH r AS (SELECT n, k FROM (SELECT unnest(range(0, 300)) AS n), (SELECT unnest(range(0, 6)) AS k), nation WHERE n_nationkey = 0)
SELECT n, k, (n // pow(2, k)::BIGINT + 1 + k)::BIGINT AS bits,
  repeat('0', (n // pow(2, k)::BIGINT)::INT) || '1' || CASE WHEN k > 0 THEN lpad(bin(n % pow(2, k)::BIGINT), k::INT, '0') ELSE '' END AS code FROM r""")
def rice_codes(spark, d) -> DataFrame:
    n = spark.range(300).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return n.select("n", F.col("k").cast("long").alias("k"), N.rice_length(F.col("n"), F.col("k")).cast("long").alias("bits"), N.rice_bits(F.col("n"), F.col("k")).alias("code"))


@query(T + """, c AS (SELECT seq, pos // 32 AS chunk, count(*) AS n FROM t GROUP BY ALL)
SELECT *, CASE WHEN chunk < 10 THEN 8 WHEN chunk < 30 THEN 4 ELSE 2 END AS iterations, 0.002::DOUBLE AS rate FROM c""")
def chunk_sizes(spark, d) -> DataFrame:
    return folds.chunks(S.words(spark, d))


@query(E + " SELECT seq, pos, tok, " + ", ".join(f"lag(tok, {i}) OVER w AS p{i}" for i in range(1, 8)) + " FROM t WINDOW w AS (PARTITION BY seq ORDER BY pos)")
def context_registers(spark, d) -> DataFrame:
    return folds.registers(S.events(spark, d))


# ---- pairs and merges ---------------------------------------------------------------------------------------------

PAIRS = """, p AS (SELECT seq, pos, tok AS l, lead(tok) OVER (PARTITION BY seq ORDER BY pos) AS r FROM t),
c AS (SELECT seq, l, r, count(*) AS n, max(pos) AS last_pos FROM p WHERE r IS NOT NULL GROUP BY ALL)"""
TOP = PAIRS + ", q AS (SELECT seq, l, r, n FROM c QUALIFY row_number() OVER (PARTITION BY seq ORDER BY n DESC, last_pos) = 1)"


@query(T + PAIRS + " SELECT * FROM c")
def pair_counts(spark, d) -> DataFrame:
    return dictionary.pair_counts(S.words(spark, d))


@query(T + TOP + " SELECT * FROM q")
def top_pair(spark, d) -> DataFrame:
    return dictionary.top_pair(S.words(spark, d))


@query(E + TOP + """, h AS (SELECT t.seq, t.pos, t.tok, q.l, q.r, coalesce(t.tok = q.l AND lead(t.tok) OVER w = q.r, false) AS hit FROM t LEFT JOIN q USING (seq) WINDOW w AS (PARTITION BY t.seq ORDER BY t.pos)),
u AS (SELECT *, CASE WHEN hit AND coalesce(lag(hit) OVER w, false) AND l = r THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY seq ORDER BY pos)),
v AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY pos) AS run FROM u),
s AS (SELECT *, hit AND (row_number() OVER (PARTITION BY seq, run ORDER BY pos) - 1) % 2 = 0 AS start FROM v),
k AS (SELECT *, coalesce(lag(start) OVER (PARTITION BY seq ORDER BY pos), false) AS gone FROM s)
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS pos, CASE WHEN start THEN l || '+' || r ELSE tok END AS tok FROM k WHERE NOT gone""")
def merge_once(spark, d) -> DataFrame:
    tokens = S.events(spark, d)
    return dictionary.merge_once(tokens, dictionary.top_pair(tokens)).withColumn("tok", F.translate("tok", "\x01", "+"))


@query(E + " SELECT seq, pos, tok FROM t")
def merges_roundtrip(spark, d) -> DataFrame:
    return dictionary.expand_merges(dictionary.learn_merges(S.events(spark, d), 3, 2, cut))


def _merge_rounds(rounds: int, least: int) -> str:
    """SQL of rounds of merging: t0 to t<rounds>."""
    out = [E.replace("WITH t AS", "WITH t0 AS", 1)]
    for i in range(rounds):
        over = "WINDOW w AS (PARTITION BY seq ORDER BY pos)"
        out.append(f"""p{i} AS (SELECT seq, pos, tok AS l, lead(tok) OVER w AS r FROM t{i} {over}),
c{i} AS (SELECT seq, l, r, count(*) AS n, max(pos) AS last_pos FROM p{i} WHERE r IS NOT NULL GROUP BY ALL),
q{i} AS (SELECT seq, l, r FROM (FROM c{i} QUALIFY row_number() OVER (PARTITION BY seq ORDER BY n DESC, last_pos) = 1) WHERE n >= {least}),
h{i} AS (SELECT a.seq, a.pos, a.tok, q.l, q.r, coalesce(a.tok = q.l AND lead(a.tok) OVER (PARTITION BY a.seq ORDER BY a.pos) = q.r, false) AS hit FROM t{i} a LEFT JOIN q{i} q USING (seq)),
u{i} AS (SELECT *, CASE WHEN hit AND coalesce(lag(hit) OVER w, false) AND l = r THEN 0 ELSE 1 END AS new FROM h{i} {over}),
v{i} AS (SELECT *, sum(new) OVER w AS run FROM u{i} {over}),
s{i} AS (SELECT *, hit AND (row_number() OVER (PARTITION BY seq, run ORDER BY pos) - 1) % 2 = 0 AS start FROM v{i}),
k{i} AS (SELECT *, coalesce(lag(start) OVER w, false) AS gone FROM s{i} {over}),
t{i + 1} AS (SELECT seq, row_number() OVER w - 1 AS pos, CASE WHEN start THEN l || '+' || r ELSE tok END AS tok FROM k{i} WHERE NOT gone {over})""")
    return ", ".join(out)


@query(_merge_rounds(3, 2) + " SELECT seq, pos, tok FROM t3")
def learned_merges(spark, d) -> DataFrame:
    """The sequences after three rounds of merging, merges of merged symbols among them."""
    return dictionary.learn_merges(S.events(spark, d), 3, 2, cut).withColumn("tok", F.translate("tok", "\x01", "+"))


MERGES = f"""WITH t AS (SELECT seq, pos, ('0x' || tok)::BIGINT AS b FROM ({S.BYTES_SQL})),
p AS (SELECT b AS l, lead(b) OVER (PARTITION BY seq ORDER BY pos) AS r FROM t), c AS (SELECT l, r, count(*) AS n FROM p WHERE r IS NOT NULL GROUP BY ALL),
m AS (SELECT l, r, row_number() OVER (ORDER BY n DESC, l, r) - 1 AS rank FROM c ORDER BY n DESC, l, r LIMIT 64)"""


def _byte_pairs(spark, d) -> DataFrame:
    ids = S.text_bytes(spark, d).select("seq", "pos", F.conv("tok", 16, 10).cast("long").alias("tok"))
    return dictionary.pairs(ids).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))


@query(MERGES + " SELECT l, r, rank + 256 AS m, rank FROM m")
def merge_table(spark, d) -> DataFrame:
    return merging.merge_table(merging.frequent_pairs(_byte_pairs(spark, d), 64))


@query(MERGES + " SELECT coalesce(rank, -1) AS rank, sum(n)::BIGINT AS found FROM c LEFT JOIN m USING (l, r) GROUP BY 1")
def merge_lookup(spark, d) -> DataFrame:
    counts = cut(_byte_pairs(spark, d), "pairs")
    found = merging.look_up(counts, merging.frequent_pairs(counts, 64))
    return found.groupBy(F.coalesce("rank", F.lit(-1)).alias("rank")).agg(F.sum("n").alias("found"))


@query(MERGES + """, s AS (SELECT range AS tok, lpad(hex(range), 2, '0') AS bytes FROM range(256) UNION ALL SELECT rank + 256, lpad(hex(l), 2, '0') || lpad(hex(r), 2, '0') FROM m)
SELECT tok, bytes, l, r, rank FROM s LEFT JOIN m ON rank + 256 = tok""")
def tokenizer_file(spark, d) -> DataFrame:
    """The merges packed into a tokenizer file, written, and read back as tables."""
    rows = merging.frequent_pairs(_byte_pairs(spark, d), 64).orderBy("rank").collect()  # 64 rows
    symbols = [bytes([i]) for i in range(256)]
    symbols += [symbols[r.l] + symbols[r.r] for r in rows]
    data = model_file.pack(list(range(256)), symbols, [(r.l, r.r, r.m) for r in rows])
    path = f"{new_path(spark, 'tokenizer')}.bin"
    write_bytes(spark, path, data)
    known, merges, _ = model_file.read(spark, path)
    both = known.join(merges.select(F.col("m").alias("tok"), "l", "r", "rank"), "tok", "left")
    return both.select("tok", F.hex("bytes").alias("bytes"), "l", "r", "rank")


@query("SELECT doc_id AS seq, octet_length(encode(text)) AS bytes, true AS same FROM documents")
def merge_encode_roundtrip(spark, d) -> DataFrame:
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = merging.encode(_data(spark, d).repartition(parts, "seq"), merging.frequent_pairs(_byte_pairs(spark, d), 64))
    back = cut(coded, "merged").withColumnRenamed("data", "again")
    both = _data(spark, d).join(back, "seq", "full_outer")
    return both.select("seq", F.octet_length("data").cast("long").alias("bytes"), F.col("data").eqNullSafe(F.col("again")).alias("same"))


# ---- contexts -----------------------------------------------------------------------------------------------------


def _context_sql(k: int) -> str:
    return f"""WITH w AS (SELECT doc_id AS seq, regexp_extract_all(coalesce(text, ''), '{S.WORD}') AS w FROM documents),
i AS (SELECT seq, w, unnest(range({k} + 1, len(w) + 1)) AS i FROM w WHERE len(w) > {k}),
x AS (SELECT seq, i - 1 AS pos, w[i] AS tok, array_to_string(w[i - {k}:i - 1], chr(1)) AS ctx FROM i)"""


CAUSAL = """, c AS (SELECT *, row_number() OVER (PARTITION BY seq, ctx, tok ORDER BY pos) - 1 AS c,
  row_number() OVER (PARTITION BY seq, ctx ORDER BY pos) - 1 AS total FROM x),
f AS (SELECT *, coalesce(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seq, ctx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fanout FROM c)"""


def _context_queries(k: int) -> None:
    weight, smooth = contexts.ORDERS[k]

    @query(_context_sql(k) + " SELECT seq, md5(ctx) AS ctx, tok, least(count(*), 65535) AS n FROM x GROUP BY seq, x.ctx, tok", f"ngram_counts_k{k}")
    def counts(spark, d) -> DataFrame:
        return contexts.counts_within(S.packed_words_of_ids(_dealt(spark, d)), k)

    @query(
        _context_sql(k) + CAUSAL + f""" SELECT {k} AS k, count(*) AS positions, count(*) FILTER (total > 0) AS context_hits,
  count(*) FILTER (c > 0) AS symbol_hits, sum(fanout)::BIGINT AS fanout_sum, round(sum({weight} * ln(1 + c / {smooth})), 2) AS bias_sum FROM f""",
        f"ngram_hits_k{k}",
    )
    def hits(spark, d) -> DataFrame:
        return contexts.order_summary(S.packed_words(S.table(spark, d, "documents")), k)


for _k in contexts.ORDERS:
    _context_queries(_k)


@query(_context_sql(1) + ", g AS (SELECT seq, ctx, tok, least(count(*), 65535) AS n FROM x GROUP BY ALL) SELECT seq, ctx, tok, n >> 1 AS n FROM g WHERE n >> 1 > 0")
def ngram_decayed_counts(spark, d) -> DataFrame:
    return contexts.decayed(contexts.final_counts(contexts.with_context(S.packed_words(S.table(spark, d, "documents")), 1)))


@query(_context_sql(1) + """, e AS (SELECT seq, ctx, tok, pos // 100 AS epoch, count(*) AS n FROM x GROUP BY ALL),
l AS (SELECT seq, max(pos) // 100 AS last FROM x GROUP BY seq), f AS (SELECT seq, ctx, tok, list({'epoch': epoch, 'n': n} ORDER BY epoch) AS rows FROM e GROUP BY ALL),
s AS (SELECT *, list_reduce(rows, lambda a, b: {'epoch': b.epoch, 'n': (a.n >> (b.epoch - a.epoch)) + b.n}) AS s FROM f)
SELECT seq, ctx, tok, s.n >> (last - s.epoch) AS n FROM s JOIN l USING (seq) WHERE s.n >> (last - s.epoch) > 0""")
def ngram_periodic_decay(spark, d) -> DataFrame:
    return contexts.periodically_decayed(contexts.with_context(S.packed_words(S.table(spark, d, "documents")), 1), 100)


@query(T + ", n AS (SELECT seq, tok, row_number() OVER (PARTITION BY seq, tok ORDER BY pos) - 1 AS n FROM t) SELECT seq, round(sum(0.1 * ln(n + 1)), 4) AS prior_sum FROM n GROUP BY seq")
def unigram_prior(spark, d) -> DataFrame:
    rows = contexts.prior_counts(S.words(spark, d))
    return rows.groupBy("seq").agg(F.round(F.sum(contexts.PRIOR * F.ln(F.col("n") + 1)), 4).alias("prior_sum"))


@query(E + """, p AS (SELECT t.seq, t.pos, t.tok, q.pos AS q, least(t.pos, 64) AS held FROM t JOIN t q ON q.seq = t.seq AND q.tok = t.tok AND q.pos BETWEEN t.pos - 64 AND t.pos - 1),
s AS (SELECT seq, pos, count(*) AS seen, sum(0.05 * exp(-3.0 * (pos - 1 - q) / 64)) AS bonus FROM p GROUP BY ALL)
SELECT t.seq, t.pos, t.tok, coalesce(s.seen, 0) AS seen, round(coalesce(s.bonus, 0), 6) AS bonus FROM t LEFT JOIN s USING (seq, pos)""")
def recency_bonus(spark, d) -> DataFrame:
    return contexts.recency(S.events(spark, d)).withColumn("bonus", F.round("bonus", 6))


# ---- folds --------------------------------------------------------------------------------------------------------

LZ = T + VOCAB + """, i AS (SELECT seq, pos, cid::BIGINT AS id FROM t JOIN c USING (seq, tok)),
l AS (SELECT seq, pos, id, lag(id, 2) OVER w AS p2, lag(id, 1) OVER w AS p1 FROM i WINDOW w AS (PARTITION BY seq ORDER BY pos)),
k AS (SELECT seq, pos, id, (p2 * 7919 + p1 * 104729 + 1000003) & 16777215 AS slot, p2 * 4294967296 + p1 AS key FROM l WHERE p2 IS NOT NULL),
g AS (SELECT seq, slot, list_reduce(list({'key': key, 'id': id, 'cnt': 1::BIGINT} ORDER BY pos), lambda s, r:
  CASE WHEN s.key = r.key AND s.id = r.id THEN {'key': s.key, 'id': s.id, 'cnt': least(s.cnt + 1, 30000)}
    WHEN s.cnt <= 1 THEN {'key': r.key, 'id': r.id, 'cnt': 1::BIGINT} ELSE {'key': s.key, 'id': s.id, 'cnt': s.cnt - 1} END) AS s FROM k GROUP BY seq, slot)"""


def _compact_ids(spark, d) -> DataFrame:
    tokens = S.words(spark, d)
    return dictionary.remap(tokens, dictionary.compact(tokens)).withColumnRenamed("cid", "id")


@query(LZ + " SELECT seq, slot, s.key AS key, s.id AS id, s.cnt AS cnt FROM g")
def lz_final_state(spark, d) -> DataFrame:
    return folds.last_match(_compact_ids(spark, d))


@query(LZ + " SELECT seq, count(*) AS slots, round(sum(1.5 * (1 - 1 / (1 + 0.3 * s.cnt))), 4) AS boost FROM g GROUP BY seq")
def lz_boost(spark, d) -> DataFrame:
    state = folds.last_match(_compact_ids(spark, d))
    return state.groupBy("seq").agg(F.count(F.lit(1)).alias("slots"), F.round(F.sum(folds.boost(F.col("cnt"))), 4).alias("boost"))


LZ_AS_OF = LZ.replace("g AS (SELECT seq, slot, list_reduce(", "h AS (SELECT seq, slot, list(pos ORDER BY pos) AS ats, list({'key': key, 'id': id, 'cnt': 1::BIGINT} ORDER BY pos) AS rows FROM k GROUP BY seq, slot), g AS (SELECT *, list_reduce(").replace(
    "list({'key': key, 'id': id, 'cnt': 1::BIGINT} ORDER BY pos), lambda", "rows[1:n], lambda").replace("AS s FROM k GROUP BY seq, slot)", "AS s FROM (SELECT *, unnest(range(1, len(rows))) AS n FROM h))")


@query(LZ_AS_OF + """ SELECT seq, ats[n + 1] AS pos, s.id AS id, s.cnt AS cnt, rows[n + 1].id = s.id AS right, round(1.5 * (1 - 1 / (1 + 0.3 * s.cnt)), 6) AS bonus
FROM g WHERE s.key = rows[n + 1].key""")
def lz_bonus_as_of(spark, d) -> DataFrame:
    """What the last-match table foretells at each position, from the positions before it only."""
    rows = folds.match_as_of(_compact_ids(spark, d))
    return rows.select("seq", "pos", "id", "cnt", F.col("right"), F.round(folds.boost(F.col("cnt")), 6).alias("bonus"))


# ---- mixing -------------------------------------------------------------------------------------------------------


@query(T + COUNTED + " SELECT seq, count(*) AS n, round(sum(bits), 3) AS total_bits, round(sum(bits) / count(*), 4) AS bits_per_token FROM b GROUP BY seq")
def code_length_count_only(spark, d) -> DataFrame:
    return mixing.report(mixing.count_bits(S.words(spark, d)))


@query(T + COUNTED + ", r AS (SELECT seq, pos, sum(bits) OVER (PARTITION BY seq ORDER BY pos) / (pos + 1) AS x FROM b) SELECT seq, pos, round(x, 4) AS bits_per_token FROM r WHERE (pos + 1) % 200 = 0")
def bpt_progress(spark, d) -> DataFrame:
    return mixing.progress(mixing.count_bits(S.words(spark, d)))


@query(T + COUNTED + """, s AS (SELECT seq, count(*) AS toks, sum(bits) / 8 AS size FROM b GROUP BY seq),
r AS (SELECT coalesce(toks, 0) AS toks, coalesce(size, 0) AS size, octet_length(encode(coalesce(text, ''))) AS raw FROM documents LEFT JOIN s ON doc_id = seq)
SELECT count(*) AS files, sum(toks)::BIGINT AS toks, sum(raw)::BIGINT AS bytes, round(sum(size), 1) AS coded,
  round(sum(size) / sum(raw), 4) AS ratio, round(8 * sum(size) / sum(raw), 4) AS bpb, round(8 * sum(size) / sum(toks), 4) AS bpt FROM r""")
def compression_report(spark, d) -> DataFrame:
    """Of the same bytes: how long the texts are, and the code of their tokens (without the vocabularies)."""
    s = mixing.count_bits(S.words(spark, d)).groupBy("seq").agg(F.count(F.lit(1)).alias("toks"), (F.sum("bits") / 8).alias("size"))
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.octet_length(F.coalesce("text", F.lit(""))).alias("raw"))
    size, raw, toks = F.sum(F.coalesce("size", F.lit(0.0))), F.sum("raw"), F.sum(F.coalesce("toks", F.lit(0)))
    return docs.join(s, "seq", "left").agg(
        F.count(F.lit(1)).alias("files"), toks.alias("toks"), raw.alias("bytes"), F.round(size, 1).alias("coded"),
        F.round(size / raw, 4).alias("ratio"), F.round(8 * size / raw, 4).alias("bpb"), F.round(8 * size / toks, 4).alias("bpt"),
    )


#: Which earlier positions had the same context: all orders at once, as pairs of positions; then the other two sources.
NGRAM = T + VOCAB + """, i AS (SELECT t.seq, t.pos, c.cid AS id FROM t JOIN c USING (seq, tok)),
p AS (SELECT seq, list(id ORDER BY pos) AS s FROM i GROUP BY seq),
x AS (SELECT seq, k, pos, s[pos + 1] AS id, s[pos - k + 1:pos] AS ctx FROM (SELECT seq, s, unnest(range(1, len(s))) AS pos FROM p), (VALUES """ + ", ".join(f"({k})" for k in contexts.ORDERS) + """) o(k) WHERE pos >= k),
g AS (SELECT a.seq, a.pos, a.k, b.id, count(*) AS c FROM x a JOIN x b ON a.seq = b.seq AND a.k = b.k AND a.ctx = b.ctx AND b.pos < a.pos GROUP BY ALL),
l AS (SELECT seq, pos, id, s[pos - 1] * 4294967296 + s[pos] AS key, (s[pos - 1] * 7919 + s[pos] * 104729 + 1000003) & 16777215 AS slot
  FROM (SELECT seq, s, unnest(range(2, len(s))) AS pos FROM p) JOIN i USING (seq, pos)),
h AS (SELECT seq, slot, list({'key': key, 'id': id::BIGINT, 'cnt': 1::BIGINT} ORDER BY pos) AS rows, list(pos ORDER BY pos) AS ats, list(key ORDER BY pos) AS keys FROM l GROUP BY seq, slot HAVING count(*) > 1),
m AS (SELECT seq, ats[n + 1] AS pos, keys[n + 1] AS key, list_reduce(rows[1:n], lambda s, r: CASE WHEN s.key = r.key AND s.id = r.id THEN {'key': s.key, 'id': s.id, 'cnt': least(s.cnt + 1, 30000)}
    WHEN s.cnt <= 1 THEN {'key': r.key, 'id': r.id, 'cnt': 1::BIGINT} ELSE {'key': s.key, 'id': s.id, 'cnt': s.cnt - 1} END) AS s
  FROM (SELECT *, unnest(range(1, len(rows))) AS n FROM h)),
d AS (SELECT seq, pos, id, CASE k """ + " ".join(f"WHEN {k} THEN {w} * ln(1 + c / {a})" for k, (w, a) in contexts.ORDERS.items()) + """ END AS d FROM g
  UNION ALL SELECT seq, pos, s.id, 1.5 * (1 - 1 / (1 + 0.3 * s.cnt)) FROM m WHERE s.key = m.key
  UNION ALL SELECT a.seq, a.pos, b.id, 0.05 * exp(-3.0 * (a.pos - 1 - b.pos) / 64) FROM i a JOIN i b ON a.seq = b.seq AND b.pos BETWEEN a.pos - 64 AND a.pos - 1),
e AS (SELECT seq, pos, id, sum(d) AS d FROM d GROUP BY ALL),
o AS (SELECT seq, pos, id, row_number() OVER (PARTITION BY seq, id ORDER BY pos) AS n FROM i),
q AS (SELECT e.seq, e.pos, e.id, e.d, o.n FROM e ASOF JOIN o ON e.seq = o.seq AND e.id = o.id AND e.pos > o.pos),
r AS (SELECT seq, pos, sum(pow(n + 1, 0.1) * (exp(d) - 1)) AS more FROM q GROUP BY ALL),
y AS (SELECT *, n - 1 AS before, count(*) FILTER (n = 1) OVER (PARTITION BY seq) + coalesce(sum(pow(n + 1, 0.1) - pow(n, 0.1)) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM o)"""


@query(NGRAM + """ SELECT y.seq, count(*) AS n, round(sum(log2(z + coalesce(more, 0)) - 0.1 * log2(before + 1) - coalesce(q.d, 0) / ln(2)), 3) AS total_bits
FROM y LEFT JOIN r ON r.seq = y.seq AND r.pos = y.pos LEFT JOIN q ON q.seq = y.seq AND q.pos = y.pos AND q.id = y.id GROUP BY y.seq""")
def code_length_ngram(spark, d) -> DataFrame:
    packed = S.packed_words(S.table(spark, d, "documents"))
    return mixing.context_code_length(packed.where(F.size("toks") > 0))


H = T + """, v AS (SELECT seq, tok, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT seq, n / sum(n) OVER (PARTITION BY seq) AS p FROM v),
h AS (SELECT seq, -sum(CASE WHEN p > 1e-10 THEN p * ln(p) ELSE 0 END) AS h FROM p GROUP BY seq)"""


@query(H + " SELECT seq, round(h, 6) AS entropy, round(least(greatest(0.4 + 0.6 * h / 5.5, 0.2), 2.5), 6) AS scale FROM h")
def unigram_entropy(spark, d) -> DataFrame:
    h = mixing.entropy(S.words(spark, d).groupBy("seq", "tok").agg(F.count(F.lit(1)).alias("n")))
    return h.select("seq", F.round("entropy", 6).alias("entropy"), F.round(mixing.entropy_scale(F.col("entropy")), 6).alias("scale"))


SOFT = E + """, l AS (SELECT seq, tok, 0.1 * ln(count(*) + 1) AS logit FROM t GROUP BY ALL),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq)) AS e FROM l), p AS (SELECT seq, tok, logit, e / sum(e) OVER (PARTITION BY seq) AS p FROM e)"""


def _event_probabilities(spark, d) -> DataFrame:
    counts = S.events(spark, d).groupBy("seq", "tok").agg(F.count(F.lit(1)).alias("n"))
    return mixing.softmax(counts.select("seq", "tok", (contexts.PRIOR * F.ln(F.col("n") + 1)).alias("logit")))


@query(SOFT + " SELECT seq, tok, round(logit, 6) AS logit, round(p, 8) AS p FROM p")
def softmax_events(spark, d) -> DataFrame:
    return _event_probabilities(spark, d).select("seq", "tok", F.round("logit", 6).alias("logit"), F.round("p", 8).alias("p"))


CDF = SOFT + ", f AS (SELECT seq, tok, greatest(1, floor(p * 65536 + 0.5))::BIGINT AS freq FROM p), g AS (SELECT seq, tok, freq, (sum(freq) OVER (PARTITION BY seq ORDER BY tok))::BIGINT AS hi FROM f)"


@query(CDF + " SELECT seq, tok, freq, hi - freq AS lo, hi FROM g")
def cdf_events(spark, d) -> DataFrame:
    return mixing.cdf(_event_probabilities(spark, d))


@query(CDF + ", q AS (SELECT user_id AS seq, event_id, (event_id * 7919) % 60000 AS v FROM events) SELECT event_id, q.seq, v, tok FROM q JOIN g ON q.seq = g.seq AND v >= hi - freq AND v < hi")
def cdf_search(spark, d) -> DataFrame:
    """The symbol whose range holds a value, for a value drawn from each event: a range join within each sequence."""
    asked = S.table(spark, d, "events").select(F.col("user_id").alias("seq"), "event_id", (F.col("event_id") * 7919 % 60000).alias("v"))
    ranges = mixing.cdf(_event_probabilities(spark, d))
    return asked.join(ranges, "seq").where("v >= lo AND v < hi").select("event_id", "seq", "v", "tok")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(exp(least(greatest((l_quantity - 25) / 5, -87), 87)), 6) AS e,
  round(CASE WHEN l_quantity - 25 > 0 THEN ln(l_quantity - 25) ELSE -87 END, 8) AS l, round(1 / (1 + exp(-(l_quantity - 25))), 10) AS s,
  round(CASE WHEN l_quantity - 25 > 20 THEN l_quantity - 25 ELSE ln(1 + exp(least(l_quantity - 25, 20))) END, 8) AS sp,
  round(-log2(greatest(l_discount, 1e-30)), 8) AS bits, (l_orderkey * 7919 + l_partkey * 104729 + 1000003) & 16777215 AS slot,
  l_orderkey >> 3 AS sr, l_partkey << 2 AS sl, xor(l_orderkey, l_partkey) AS x FROM lineitem""")
def math_functions(spark, d) -> DataFrame:
    q = F.col("l_quantity") - 25
    return S.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(N.safe_exp(q / 5), 6).alias("e"), F.round(N.safe_ln(q), 8).alias("l"),
        F.round(N.sigmoid(q), 10).alias("s"), F.round(N.softplus(q), 8).alias("sp"), F.round(N.code_bits(F.col("l_discount")), 8).alias("bits"),
        N.slot(F.col("l_orderkey"), F.col("l_partkey")).alias("slot"), F.shiftright("l_orderkey", 3).alias("sr"),
        F.shiftleft("l_partkey", 2).alias("sl"), F.col("l_orderkey").bitwiseXOR(F.col("l_partkey")).alias("x"),
    )


# ---- transforms ---------------------------------------------------------------------------------------------------


@query(T + " SELECT seq, count(*) OVER (PARTITION BY seq) - 1 - pos AS pos, tok FROM t")
def reverse_seq(spark, d) -> DataFrame:
    return transforms.reverse(S.words(spark, d))


ROTATED = """, p AS (SELECT seq, list(tok ORDER BY pos) AS s FROM t GROUP BY seq),
r AS (SELECT seq, s, i, list_concat(s[i + 1:], s[:i]) AS rot FROM (SELECT seq, s, unnest(range(0, len(s))) AS i FROM p)),
k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY rot, i) - 1 AS rank FROM r)"""
TURNS = f"WITH t AS ({S.TURNS_SQL})"


@query(E + ROTATED + " SELECT seq, i AS pos, rank FROM k")
def suffix_array(spark, d) -> DataFrame:
    return transforms.rotation_ranks(S.events(spark, d), cut).select("seq", "pos", "rank")


BWT = ROTATED + ", l AS (SELECT seq, rank AS pos, rot[-1] AS tok, max(CASE WHEN i = 0 THEN rank END) OVER (PARTITION BY seq) AS primary_row FROM k)"


@query(E + BWT + " SELECT * FROM l")
def bwt_forward(spark, d) -> DataFrame:
    return transforms.bwt(S.events(spark, d), cut).withColumnRenamed("primary", "primary_row")


@query(TURNS + BWT + " SELECT seq, pos, tok, row_number() OVER (PARTITION BY seq ORDER BY tok, pos) - 1 AS lf FROM l")
def bwt_lf_map(spark, d) -> DataFrame:
    return transforms.lf_map(transforms.bwt(S.turns(spark, d), cut)).select("seq", "pos", "tok", "lf")


@query(T + " SELECT seq, pos, tok FROM t")
def bwt_roundtrip(spark, d) -> DataFrame:
    """Each document's tokens transformed, written, read and put back: a row is a sequence of its own, so only texts move."""
    held = cut(transforms.bwt_packed(S.packed_words(_dealt(spark, d))), "bwt")
    rows = transforms.bwt_packed_inverse(held).select("seq", F.posexplode("toks").alias("pos", "tok"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


# ---- archives -----------------------------------------------------------------------------------------------------


def _data(spark, d) -> DataFrame:
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _archives(spark, d, mode: Column) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return coding.compress_rows(_data(spark, d).withColumn("mode", mode).repartition(4 * parts, "seq"), None)


@query(f"""WITH r AS (SELECT doc_id AS seq, octet_length(encode(coalesce(text, ''))) AS n_orig, hex(encode(coalesce(text, ''))) AS raw FROM documents)
SELECT seq, n_orig, ceil(n_orig / {coding.BLOCK})::BIGINT AS blocks, 0::BIGINT AS mode, least(n_orig, {coding.BLOCK})::BIGINT AS first_symbols,
  len(list_distinct(regexp_extract_all(substr(raw, 1, 2 * {coding.BLOCK}), '..')))::BIGINT AS first_kinds,
  CASE WHEN n_orig BETWEEN 1 AND {coding.BLOCK} THEN true END AS adds_up FROM r""")
def archive_header(spark, d) -> DataFrame:
    """What the headers of the archives and of their first blocks state; adds_up: the parts of an archive of one block have the length
    that its headers say."""
    held = cut(_archives(spark, d, F.lit("none")), "archives")
    little = lambda a, n: F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.substring("archive", a, n)), F.lit("(..)"), 1)), ""), 16, 10).cast("long")
    block = coding.HEADER.size + 1
    first = lambda at, n: F.when(F.length("archive") >= block, little(block + at, n)).otherwise(0)
    held = held.select("*", little(5, 8).alias("n_orig"), little(13, 4).alias("blocks"), little(17, 1).alias("mode"), first(0, 4).alias("first_symbols"), first(4, 2).alias("first_kinds"))
    parts = coding.HEADER.size + coding.BLOCK_HEADER.size + little(block + 6, 2) + little(block + 8, 4) + 4 * little(block + 16, 2)
    return held.select("seq", "n_orig", "blocks", "mode", "first_symbols", "first_kinds", F.when(F.col("blocks") == 1, F.length("archive") == parts).alias("adds_up"))


def _mode(seq) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in coding.MODES]), (F.pmod(seq, F.lit(len(coding.MODES))) + 1).cast("int"))


@query(f"""SELECT doc_id AS seq, {list(coding.MODES)}[doc_id % {len(coding.MODES)} + 1] AS mode, octet_length(encode(coalesce(text, ''))) AS bytes, true AS same,
  NULL::BIGINT AS first_difference FROM documents""")
def roundtrip_verify(spark, d) -> DataFrame:
    """Each document compressed, written, read, decompressed and compared; the modes of preprocessing take turns."""
    held = cut(_archives(spark, d, _mode(F.col("seq"))), "archives")
    back = coding.decompress_rows(held).withColumnRenamed("data", "again")
    both = _data(spark, d).join(back, "seq", "full_outer")
    return both.select(
        "seq", _mode(F.col("seq")).alias("mode"), F.octet_length("data").cast("long").alias("bytes"),
        F.col("data").eqNullSafe(F.col("again")).alias("same"), coding.first_difference(F.col("data"), F.col("again")).alias("first_difference"),
    )


@query()
def archive_sizes(spark, d) -> DataFrame:
    """seq, mode, bytes, coded: each document's size and that of its archive in each mode of preprocessing."""
    docs = _data(spark, d).repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")
    return coding.archive_sizes(docs.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in coding.MODES]))))


@query()
def code_length_model(spark, d) -> DataFrame:
    return neural.model_code_length(_packed_events(spark, d), False)


@query()
def code_length_full(spark, d) -> DataFrame:
    return neural.model_code_length(_packed_events(spark, d), True)


def _packed_events(spark, d) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return S.table(spark, d, "events").groupBy(F.col("user_id").alias("seq")).agg(F.transform(rows, lambda r: r["event_type"]).alias("toks"))


# ---- streaming ----------------------------------------------------------------------------------------------------


@query(E.replace("SELECT user_id AS seq,", "SELECT event_id, user_id AS seq,") + """, n AS (SELECT *, row_number() OVER (PARTITION BY seq, tok ORDER BY pos) - 1 AS n FROM t),
z AS (SELECT *, 5 + coalesce(sum(pow(n + 2, 0.1) - pow(n + 1, 0.1)) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM n)
SELECT seq, event_id, round(log2(z) - 0.1 * log2(n + 1), 6) AS bits, false AS late FROM z""")
def stream_scored_events(spark, d) -> DataFrame:
    base = new_path(spark, "stream")
    return scoring.run_available(spark, f"{d}/events.parquet", f"{base}/out", f"{base}/state")


STREAMED = NGRAM.replace(T, E, 1).replace("count(*) FILTER (n = 1) OVER (PARTITION BY seq)", "5")


@query(STREAMED + """ SELECT y.seq, event_id, round(log2(z + coalesce(more, 0)) - 0.1 * log2(before + 1) - coalesce(q.d, 0) / ln(2), 6) AS bits, false AS late
FROM y LEFT JOIN r ON r.seq = y.seq AND r.pos = y.pos LEFT JOIN q ON q.seq = y.seq AND q.pos = y.pos AND q.id = y.id
  JOIN (SELECT user_id AS seq, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) x ON x.seq = y.seq AND x.pos = y.pos""")
def stream_scored_contexts(spark, d) -> DataFrame:
    """The stream with all context orders, the last-match table and recency in its state."""
    base = new_path(spark, "stream")
    return scoring.run_available(spark, f"{d}/events.parquet", f"{base}/out", f"{base}/state", contexts=True)
