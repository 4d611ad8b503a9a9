"""WARC archives with a two-level capture index.

*Writing.*  Every page becomes one gzip member: a ``response`` record, or a
``revisit`` record that refers to the response with the same payload.  Spark's
own text writer puts the members into files, so task retries and any file
system work as usual: a member of under 16 MiB of record ends in a zero byte
(the top byte of its size field), which serves as the line separator; larger
records end in an empty member, whose last byte is zero as well.  The files
are plain concatenated gzip members, one record each, readable by any tool.

*Reading.*  Files are read whole by the binary-file source (they hold at most
``RECORDS_PER_FILE`` records) and cut into members inside one map.

*Index.*  Captures are range-sorted by reversed-host key and cut into
compressed blocks of ``BLOCK_LINES`` lines; a sparse directory keeps the first
and last key of each block.  A lookup searches the directory by bisection,
reads only the blocks found, bisects within them, and then reads single byte
ranges of the archives.

Defined cases: a null html is an empty payload; a null url has the key "" and
no target; a null page_id is never the response of others while any page of
the same payload has an id, and all pages without one are responses of their
own if none has; rows repeated under the largest page_id are all responses; no
rows give no records; further columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import map_batches, materialise, open_table
from larkspur.session import shared_dir

RECORDS_PER_FILE = 5_000
BLOCK_LINES = 1_000
DATE = "1970-01-01T00:00:00Z"
#: Directory entries held in one worker or driver; beyond it lookups join.
MAX_DIRECTORY = 2_000_000
#: Byte ranges fetched by one call of ``fetch``.
MAX_FETCH = 10_000
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def sort_key(url: str | None) -> str:
    """Reversed-host key: http://m.site.org/a?b -> org,site,m)/a?b."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url
    path = parts.path or "/"
    return ",".join(reversed(host.lower().split("."))) + port + ")" + path + (f"?{parts.query}" if parts.query else "")


def base32_digest(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def _member(record: bytes) -> bytes:
    """A record as gzip that ends in a zero byte."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _record(kind: str, page_id, url, digest: str, size: int, refers_to, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
             f"WARC-Record-ID: <urn:larkspur:page:{'none' if page_id is None else page_id}>",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:larkspur:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """One record per page, in gzip files under ``path``.

    The payload digest decides the responses by a grouped maximum; pages then
    meet it in a join whose page side is already compressed."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")) \
        .withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = materialise(rows.groupBy("sha").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select("sha", "leader"), "payloads")

    def respond(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, urls, htmls, shas = (batch.column(k).to_pylist() for k in range(4))
        members, sizes = [], []
        for i, url, html, sha in zip(ids, urls, htmls, shas):
            payload = html.encode()
            sizes.append(len(payload))
            members.append(_member(_record("response", i, url, base32_digest(sha), len(payload), None,
                                           _HTTP + payload)))
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()),
                                pa.array(members, pa.binary())],
                               names=["page_id", "url", "sha", "size", "member"])
    ready = map_batches(rows, respond, "page_id long, url string, sha string, size long, member binary")
    decided = ready.join(shared.hint("merge"), "sha", "left").withColumn(
        "revisit", F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")))

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            member = r["member"] if not r["revisit"] else _member(
                _record("revisit", r["page_id"], r["url"], base32_digest(r["sha"]), r["size"], r["leader"], _HTTP))
            out.append(member[:-1])                       # the writer adds the last byte
        return pa.record_batch([pa.array(out, pa.binary())], names=["member"])
    final = map_batches(decided.select("page_id", "url", "sha", "size", "member", "leader", "revisit"),
                        settle, "member binary")
    (final.select(F.col("member").cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every record of an archive file."""
    view, at, n = memoryview(content), 0, len(content)
    held: tuple[int, int, bytes] | None = None
    while at < n:
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof and end < n:
            piece = view[end:end + 65536]
            parts.append(z.decompress(piece))
            end += len(piece) - len(z.unused_data)
        record = b"".join(parts)
        if record:
            if held:
                yield held
            held = (at, end - at, record)
        elif held:                                        # the empty member belongs to the record before
            held = (held[0], end - held[0], held[2])
        at = end
    if held:
        yield held


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, payload) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">") if urn else "none"
    return None if number == "none" else int(number)


CAPTURES = ("key string, page_id long, record_type string, refers_to long, payload_digest string, "
            "payload_bytes long, file string, start long, length long")
_NAMES = [c.split()[0] for c in CAPTURES.split(", ")]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives; payloads of responses are checked
    against their digest and length."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for start, length, record in members(content.as_buffer()):
                    fields, payload = parse_record(record)
                    digest, size = fields["warc-payload-digest"][5:], int(fields["x-payload-length"])
                    if fields["warc-type"] == "response":

                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"damaged record in {file} at {start}")
                    rows.append((sort_key(fields.get("warc-target-uri")), _page(fields["warc-record-id"]),
                                 fields["warc-type"], _page(fields.get("warc-refers-to")), digest, size,
                                 file, start, length))
                yield _batch(rows)
    return files.mapInArrow(scan, CAPTURES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if " string" in c else pa.int64() for c in CAPTURES.split(", ")]
    columns = zip(*rows) if rows else ([] for _ in kinds)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_NAMES)


INDEX = "first_key string, last_key string, lines int, block binary"


def write_index(captures: DataFrame, path: str) -> None:
    """Sorted, compressed blocks under ``path``/blocks and their directory."""
    ordered = captures.select(*_NAMES).repartitionByRange("key", "page_id", "file", "start") \
        .sortWithinPartitions("key", "page_id", "file", "start")

    def cut(batches):
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            yield block(held)

    def block(rows: list[dict]) -> pa.RecordBatch:
        lines = "\n".join(json.dumps([r[c] for c in _NAMES]) for r in rows)
        return pa.record_batch([pa.array([rows[0]["key"]]), pa.array([rows[-1]["key"]]),
                                pa.array([len(rows)], pa.int32()),
                                pa.array([zlib.compress(lines.encode())], pa.binary())],
                               names=["first_key", "last_key", "lines", "block"])
    ordered.mapInArrow(cut, INDEX).write.mode("overwrite").parquet(f"{path}/blocks")
    spark = captures.sparkSession
    blocks = spark.read.schema(INDEX).parquet(f"{path}/blocks")
    blocks.select("first_key", "last_key", "lines").write.mode("overwrite").parquet(f"{path}/directory")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """The captures of index blocks."""
    def lines(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _batch([tuple(json.loads(x)) for x in zlib.decompress(data).decode().split("\n")])
    return blocks.select("block").mapInArrow(lines, CAPTURES)


def all_captures(spark: SparkSession, path: str) -> DataFrame:
    return decode_blocks(spark.read.schema(INDEX).parquet(f"{path}/blocks"))


class Directory:
    """The sparse directory: first and last keys of all blocks, in order."""

    def __init__(self, spark: SparkSession, path: str):
        table = spark.read.parquet(f"{path}/directory")
        n = table.count()
        if n > MAX_DIRECTORY:
            raise ValueError(f"{n} blocks: use lookup_join for an index of this size")
        rows = sorted(map(tuple, table.select("first_key", "last_key").collect()))
        self.first = [r[0] for r in rows]
        self.last = [r[1] for r in rows]

    def blocks(self, key: str) -> range:
        """Places of the blocks that may hold ``key``."""
        return range(bisect.bisect_left(self.last, key), bisect.bisect_right(self.first, key))


def lookup(spark: SparkSession, path: str, urls: list[str]) -> list[dict]:
    """Captures of a few urls: directory search, only the blocks found, search
    within them."""
    directory = Directory(spark, path)
    keys = sorted({sort_key(u) for u in urls})
    wanted = sorted({directory.first[b] for k in keys for b in directory.blocks(k)})
    if not wanted:
        return []
    blocks = spark.read.schema(INDEX).parquet(f"{path}/blocks").where(F.col("first_key").isin(wanted))
    shared = spark.sparkContext.broadcast(keys)

    def search(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                own = [r[0] for r in rows]
                yield _batch([tuple(r) for k in shared.value
                              for r in rows[bisect.bisect_left(own, k):bisect.bisect_right(own, k)]])
    found = blocks.select("block").mapInArrow(search, CAPTURES)
    return sorted((r.asDict() for r in found.collect()), key=lambda r: (r["key"], r["page_id"] or 0, r["start"]))


def lookup_join(spark: SparkSession, path: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of any number of urls, by a join with the decoded index."""
    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([sort_key(u) for u in batch.column(0).to_pylist()])], names=["key"])
    wanted = map_batches(urls.select(F.col(url_col).cast("string").alias("url")), keys, "key string").distinct()
    return all_captures(spark, path).join(wanted, "key", "left_semi")


def fetch(spark: SparkSession, captures: list[dict]) -> list[bytes]:
    """Payloads of captures, read as byte ranges through Spark's file systems;
    a revisit needs its response's capture instead."""
    if len(captures) > MAX_FETCH:
        raise ValueError("too many ranges for one call; scan the archives with read_captures")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for c in captures:
        place = jvm.org.apache.hadoop.fs.Path(c["file"])
        stream = place.getFileSystem(conf).open(place)
        try:
            stream.seek(c["start"])
            raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, c["length"]))
        finally:
            stream.close()
        out.append(parse_record(zlib.decompressobj(31).decompress(raw))[1])
    return out


def archive(pages: DataFrame, path: str) -> None:
    """Archives under ``path``/archive and their index under ``path``/index."""
    spark = pages.sparkSession
    write_archives(pages, f"{path}/archive")
    write_index(read_captures(spark, f"{path}/archive"), f"{path}/index")


QUERY_NAME = "op2_warc_index"
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS leader
  FROM pages
), s AS (
  SELECT *, unhex(sha1(payload)) AS raw FROM p
), b AS (
  SELECT *, list_reduce(list_transform(generate_series(0, 159), lambda i: get_bit(CAST(raw AS BIT), CAST(i AS INTEGER))::VARCHAR), lambda x, y: x || y) AS bits
  FROM s
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(generate_series(0, 4), lambda k:
           CAST(substr(bits, CAST(5 * i + k + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER)), lambda x, y: x + y) AS BIGINT), 1)),
         lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM b
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, indexes the archives and reads the index back."""
    path = shared_dir(spark, "llm", "warc")
    archive(open_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return all_captures(spark, f"{path}/index").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
