"""Symbol sequences (seq, pos, tok) read from tables; pos counts from 0 in the order that the table defines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Letters and digits: ASCII, and Latin from U+00C0 to U+024F.
LETTERS = r"A-Za-z0-9\x{C0}-\x{24F}"
#: A token is a word with all that stands between it and the word before; what follows the last word is a token too. So the
#: tokens of a text, put together, are the text.
WORD = f"([^{LETTERS}]*[{LETTERS}]+|[^{LETTERS}]+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_words(docs: DataFrame) -> DataFrame:
    """seq, toks: each document's tokens as an array. Null and empty texts have none."""
    return docs.select(F.col("doc_id").alias("seq"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 1).alias("toks"))


def packed_words_of_ids(docs: DataFrame) -> DataFrame:
    """packed_words with one row for all rows of an id, a null after each text's tokens."""
    texts = docs.groupBy(F.col("doc_id").alias("seq")).agg(F.collect_list("text").alias("texts"))
    toks = F.transform("texts", lambda t: F.concat(F.regexp_extract_all(t, F.lit(WORD), 1), F.array(F.lit(None).cast("string"))))
    return texts.select("seq", F.flatten(toks).alias("toks"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = packed_words(table(spark, sf_dir, "documents"))
    return docs.select("seq", F.posexplode("toks").alias("pos", "tok"))


def byte_symbols(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of hexadecimal pairs."""
    return F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit("(..)"), 1)


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq"), F.posexplode(byte_symbols(F.col("text"))).alias("pos", "tok"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by user in order of time and event_id."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(w) - 1).alias("pos"), F.col("event_type").alias("tok"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by conversation in order of turns."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), (F.row_number().over(w) - 1).alias("pos"), F.col("role").alias("tok"))


# The same relations in SQL.
WORDS_SQL = f"SELECT doc_id AS seq, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)"
BYTES_SQL = "SELECT doc_id AS seq, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS w FROM documents)"
EVENTS_SQL = "SELECT user_id AS seq, event_type AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events"
TURNS_SQL = "SELECT conv_id AS seq, role AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations"
