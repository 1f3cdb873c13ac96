"""WARC archives with revisit records (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, sliced, table

#: Payloads below this many bytes are always stored.
LEAST = 1000
# Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One gzip member: fresh WARC headers, the HTTP head, and the payload unless it revisits another record.

    A record is named by page_id and digest, so pages that share an id differ in name unless they are the same page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    name, line = (lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"), (lambda url: "".join(url.splitlines()))
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", line(url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Refers-To-Date", DATE), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers_to)]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", line(refers_url)))
    if page_id is not None:
        head.append(("X-Page", page_id))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(1, wbits=31)
    return z.compress(text.encode() + body + b"\r\n\r\n") + z.flush()


def records(file):
    """(headers, block) of every record of a stream of gzip members, reading a piece at a time."""
    z, plain = zlib.decompressobj(wbits=31), bytearray()
    while chunk := file.read(1 << 20):
        while chunk:
            plain += z.decompress(chunk)
            chunk = b""
            if z.eof:
                head, _, rest = bytes(plain).partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                yield fields, rest[: int(fields["Content-Length"])]
                chunk, z, plain = z.unused_data, zlib.decompressobj(wbits=31), bytearray()


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with digest, size, refers_to and refers_url, that page's address.

    Headers alone are shuffled by payload digest to find the largest page_id of each digest that several pages of at
    least `least` bytes share (summed before the shuffle, so a hot digest is a row per task); the pages then join that
    table of repeated digests, html along with them, whose skewed keys Spark splits. Null html is empty. Rows that repeat the largest page_id
    are all responses; null page_ids never are an original and revisit like others.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    shared = p.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count("*").alias("n"))
    shared = shared.where((F.col("n") > 1) & F.col("original").isNotNull()).select(F.col("digest").alias("d"), "original", "original_url")
    out = p.join(shared, F.col("digest") == F.col("d"), "left")
    again = ~F.col("page_id").eqNullSafe(F.col("original"))
    return out.select("page_id", "url", "html", "digest", "size", F.when(again, F.col("original")).alias("refers_to"), F.when(again, F.col("original_url")).alias("refers_url"))


def write_warc(resolved: DataFrame, folder: str) -> DataFrame:
    """Writes an archive per partition; the manifest (path, n) names the files that count, also after retries."""

    def write(batches):
        out, n = None, 0
        for b in sliced(batches):
            for page_id, url, html, digest, size, refers, refers_url in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    fs, path = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
                out.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, size, refers, refers_url))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "n": [n]})

    return checkpointed(resolved.mapInArrow(write, "path string, n long"))


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, record_id, record_type, digest, payload_bytes, refers_to) of every record; payload figures come from the
    stored payload of a response (checked against its digest) and are null for revisits."""

    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["page_id", "record_id", "record_type", "digest", "payload_bytes", "refers_to", "refers_to_record"]

    def one(uri, head, block):
        digest, size = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(), None
        if head["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{uri}: a payload does not match its digest")
        page, ref = head.get("X-Page"), head.get("X-Refers-To-Page")
        return page and int(page), head["WARC-Record-ID"], head["WARC-Type"], digest, size, ref and int(ref), head.get("WARC-Refers-To")

    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    found = (one(uri, head, block) for head, block in records(f))
                    while got := list(islice(found, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate(types)], names)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks).mapInArrow(read, "page_id long, record_id string, record_type string, digest string, payload_bytes long, refers_to long, refers_to_record string")


def resolved_records(read: DataFrame) -> DataFrame:
    """Records with each revisit's payload size taken from the response it refers to, by record id.

    Only responses that some revisit names are wanted: one row per record id on that side, and Spark splits the other."""
    hits = read.where(F.col("record_type") == "revisit").groupBy(F.col("refers_to_record").alias("wanted")).agg(F.count("*").alias("revisits"))
    originals = read.where(F.col("record_type") == "response").join(hits, F.col("record_id") == F.col("wanted"), "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("o")).agg(F.max("payload_bytes").alias("size"))
    out = read.join(originals, F.col("refers_to_record") == F.col("o"), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from the archives."""
    manifest = write_warc(resolve(table(spark, sf_dir, "pages")), shared_dir(spark, "warc"))
    return resolved_records(checkpointed(read_warc(manifest)))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN m END AS refers_to
FROM r
"""
