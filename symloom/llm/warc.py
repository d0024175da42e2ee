"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by (page_id, payload digest, url). The ranges, shards, end at rows that a hash of these picks with odds in
proportion to their bytes, so that shards hold about SHARD_BYTES, or 1/SHARDS of all bytes where that is more: the cuts depend on the
pages alone, not on settings, and pages of one id (or none) split by their payloads. A shard's task regenerates headers and digests,
compresses each record by itself and rolls files by compressed size. Files are written under temporary names and renamed; a task that
runs again puts the same files. The manifest, written after all shards, lists the files with records, bytes and digests, and the
reader opens what the manifest lists.

Of records with equal payloads of at least MIN_REVISIT bytes, that of the least page_id is a response, the others are
revisits that refer to it; smaller ones are all responses.

Cases: a null html is an empty payload, a null url a urn of the page's id; line breaks in urls are percent-encoded; pages
without an id stand at the end and are written with an empty id, which is read as null; of rows with equal page_id and
payload the first (by url, nulls last) is the response; equal rows stay in one shard, the first is the response; a page_id with
different payloads has a record for each; an empty table gives an empty manifest and an empty result; other columns are left alone;
very long payloads are a record each.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from symloom.llm.chunks import Store
from symloom.llm.common import begin, materialize, new_path, ship, table

#: A shard's bytes before compression, the most shards, candidates for cuts in a shard, bytes of a file after compression (at most; a
#: file also holds no more than 1/FILES of a shard's bytes, so that shards of any size have a few).
SHARD_BYTES, SHARDS, CANDIDATES, ROLL_BYTES, FILES = 1 << 23, 1 << 15, 4, 1 << 26, 16
MIN_REVISIT, LEVEL = 100, 4
DATE, PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or f"urn:page:{'' if page is None else page}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Page-ID: {'' if page is None else page}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: {_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {'' if refers_to is None else refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of its own, without a time."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def parse(raw: bytes) -> tuple:
    """A row of RECORD from one uncompressed record; its digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest() or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return number(fields["WARC-Page-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To-Page-ID")), None if revisit else payload


def members(data):
    """The records of a file."""
    data, at = memoryview(data), 0
    while at < len(data):
        d = zlib.decompressobj(31)
        raw = d.decompress(data[at:])
        at = len(data) - len(d.unused_data)
        yield raw


def _key(page: Column, digest: Column, url: Column) -> Column:
    """Text whose order is that of (page_id, nulls last; digest; a hash of the url)."""
    number = F.coalesce(F.lpad(F.hex(page.bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("G" * 16))
    return F.concat(number, F.substring(digest, 1, 24), F.lpad(F.hex(F.xxhash64(url)), 16, "0"))


def _cuts(meta: DataFrame, shard_bytes: int) -> list[str]:
    """The least key of each shard but the first, from key and bytes of the records: every CANDIDATES-th of the rows that a
    hash picks. At most about SHARDS * CANDIDATES rows come to the driver."""
    total = meta.agg(F.sum("bytes")).first()[0] or 0
    step = max(shard_bytes, total // SHARDS) / CANDIDATES
    odds = (F.conv(F.substring(F.md5("key"), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    picked = sorted(r[0] for r in meta.where(odds * step < F.col("bytes")).select("key").distinct().collect())
    return picked[CANDIDATES::CANDIDATES]


def write_warc(pages: DataFrame, uri: str, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) into archives below uri and returns the manifest, which is at uri/manifest too."""
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce("html", F.lit(""))
    digest = F.sha2(F.encode(html, "UTF-8"), 256)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), digest.alias("digest"))
    slim = slim.withColumn("key", _key(F.col("page_id"), F.col("digest"), F.col("url")))
    size = F.octet_length("html").cast("long") + 500  # a record's headers
    meta = materialize(slim.select("page_id", "url", F.octet_length("html").alias("payload"), size.alias("bytes"), "digest", "key"), "warc-meta")
    order = [F.col("page_id").isNull().alias("no_page"), "page_id", F.col("url").isNull().alias("no_url"), "url"]
    lead = F.min(F.struct(*order)).alias("m")
    groups = meta.where(F.col("payload") >= MIN_REVISIT).groupBy("digest").agg(lead, F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = materialize(groups.select("digest", "m"), "warc-groups")  # a written table, so that a hot payload's rows can be split
    cuts = np.array(_cuts(meta, shard_bytes), "U56")
    roll = max(1, min(roll, max(shard_bytes, (meta.agg(F.sum("bytes")).first()[0] or 0) // SHARDS) // FILES))

    @arrow_udf("int")
    def shard_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, np.array(key.to_pylist(), "U56"), "right"), pa.int32())

    same = F.col("page_id").eqNullSafe(F.col("m.page_id")) & F.col("url").eqNullSafe(F.col("m.url"))
    notes = meta.join(groups, "digest").select("key", "page_id", "url", F.col("m.page_id").alias("lead"), same.alias("first")).distinct()
    none = {"lead": F.lit(None).cast("long"), "first": F.lit(None).cast("boolean"), "html": F.lit(None).cast("string")}
    columns = ["key", "page_id", "url", "html", "lead", "first"]
    bodies = slim.withColumns({k: none[k] for k in ("lead", "first")}).select(F.lit(1).alias("kind"), *columns)
    rows = materialize(notes.withColumn("html", none["html"]).select(F.lit(0).alias("kind"), *columns), "warc-notes").unionByName(bodies)
    rows = rows.withColumn("shard", shard_of("key")).repartitionById(len(cuts) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("key", F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "kind")

    def write(batches):
        begin("warc")
        store, out, seq, size = Store(uri), [], 0, 0
        files, note, told = [], None, False

        def close() -> None:
            nonlocal out, seq, size
            if out:
                name, held = f"shard-{shard:06d}-{seq:05d}.warc.gz", hashlib.sha256()
                for raw in out:
                    held.update(raw)
                store.put(name, lambda stream: [stream.write(raw) for raw in out])
                files.append((shard, name, len(out), size, held.hexdigest()))
                out, seq, size = [], seq + 1, 0

        shard = 0
        for batch in batches:
            for shard, kind, key, page, url, html, lead, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", *columns))):
                if kind == 0:  # stands before the records of its page, payload and url
                    note, told = (key, page, url, lead, first), False
                    continue
                again = note is not None and note[:3] == (key, page, url)
                raw = member(record(page, url, html.encode(), note[3] if again else None, again and (told or not note[4])))
                told = again
                if size and size + len(raw) > roll:
                    close()
                out.append(raw)
                size += len(raw)
        close()
        named = list(zip(*files)) or [[]] * 5
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(named, kinds)], names=["shard", "file", "records", "bytes", "sha256"])

    rows.select("shard", "kind", *columns).mapInArrow(write, MANIFEST).write.json(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).json(f"{uri}/manifest")


def read_warc(spark: SparkSession, uri: str) -> DataFrame:
    """RECORD for each record of the archives that the manifest below uri lists; files and records are checked."""
    ship(spark)
    manifest = spark.read.schema(MANIFEST).json(f"{uri}/manifest")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def read(batches):
        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = Store(uri).bytes(name)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"damaged archive {name}")
                rows, size = [], 0
                for raw in members(data):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)

    files = manifest.select("file", "sha256").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(read, RECORD)


NAMES = [x.split()[0] for x in RECORD.split(", ")]


def op4_warc(spark, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN lead END AS refers_to
FROM g
"""
