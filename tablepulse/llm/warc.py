"""WARC archives: captures written as request, response (or revisit) and metadata records, and read back.

Every record is a gzip member of its own. A task hands its members in bundles to Spark's text writer, whose commit
protocol leaves the files of one attempt of a task only; the line separator is an empty member. Files hold a
bounded number of bundles, and bundles a bounded number of bytes (or one record). Reading inflates a file bit by
bit, parses records by the lengths that they state, and assembles transactions: request and metadata records name
their capture in ``WARC-Concurrent-To``, and are joined with it on that, in one exchange.

Record ids are ``<urn:page:ID:...>``: they name the page, so a revisit's ``WARC-Refers-To`` tells which page it
stands for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import HOT_KEYS, cut, new_path, ship

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads under so many bytes are stored again instead of being referred to.
LEAST_REVISIT = 100
#: Compressed bytes of a bundle, about, and bundles in a file at most.
BUNDLE_BYTES = 4 << 20
FILE_BUNDLES = 8
#: Payloads that occur twice or more, which may be broadcast with the first page of each: some 100 bytes a row.
BROADCAST_FIRST = 100_000
RECORDS = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_length long, content_type string, block binary"
#: A gzip member without content, as the text writer's line separator.
_EMPTY_MEMBER = zlib.compress(b"", 6, 31)


def plan_captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (page_id, url, html) with ``digest``, ``length``, ``refers_to`` and ``first``.

    Among rows with equal payloads of ``least`` bytes and more, those with the smallest page_id are
    responses (``first``: the only such one); the others have its page_id in ``refers_to``. Null ids come after all
    others, and are responses where a payload has no other. Which ids are first is aggregated map-side. Payloads that
    occur once are not joined; where many occur twice, those of more than one in 4096 rows are broadcast, so pages
    of a frequent payload stay in their tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("length", F.octet_length("html").cast("long"))
    by_page = rows.where(F.col("length") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    # (is null, page_id): nulls last
    least_page = F.min(F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("n"))).alias("least")
    firsts = cut(by_page.groupBy("digest").agg(least_page, F.sum("n").alias("all")).where("all > 1").select("digest", F.col("least.page_id").alias("id"), (F.col("least.n") == 1).alias("one"), "all"), "firsts")
    told = F.struct("id", "one")
    if firsts.count() <= BROADCAST_FIRST:
        rows = rows.join(F.broadcast(firsts.select("digest", told.alias("told"))), "digest", "left")
    else:
        bound = F.lit(max(1, rows.count() // HOT_KEYS))
        hot, rest = firsts.where(F.col("all") > bound), firsts.where(F.col("all") <= bound)
        rows = rows.join(F.broadcast(hot.select("digest", told.alias("hot"))), "digest", "left")
        alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
        rows = rows.withColumn("key", F.when(F.col("hot").isNull() & (F.col("length") >= least), F.col("digest")).otherwise(alone))
        rows = rows.join(rest.select(F.col("digest").alias("key"), told.alias("rest")), "key", "left").withColumn("told", F.coalesce("hot", "rest"))
    again = F.col("told.id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("told.id"))
    first = F.coalesce(F.col("told.id").isNotNull() & ~again & F.col("told.one"), F.lit(False))
    return rows.select("page_id", "url", F.when(~again | F.col("told").isNull(), F.col("html")).alias("html"), "digest", "length", F.when(again, F.col("told.id")).alias("refers_to"), first.alias("first"))


def _record(kind: str, record_id: str, uri: str, lines: list[tuple[str, str]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *lines, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + CRLF
    return zlib.compress(head.encode() + block + b"\r\n\r\n", 6, 31)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, k, held, bundle = TaskContext.get().partitionId(), 0, 0, []

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(bundle)], pa.binary())], names=["value"])

    for batch in batches:
        columns = (batch[c] for c in ("page_id", "url", "html", "digest", "length", "refers_to", "first"))
        for page, url, html, digest, length, refers, first in zip(*columns):
            page, digest, refers, length = page.as_py(), digest.as_py(), refers.as_py(), str(length.as_py())
            uri = (url.as_py() or "").replace("\r", " ").replace("\n", " ")
            name = "" if page is None else str(page)
            own = f"{task:x}-{k:x}"
            capture = f"<urn:page:{name}:{digest[:32]}{'' if first.as_py() else ':' + own}>"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {length}\r\n\r\n".encode()
            both = [("WARC-Payload-Digest", "sha256:" + digest), ("X-Payload-Length", length), ("Content-Type", "application/http; msgtype=response")]
            if refers is None:
                main = _record("response", capture, uri, both, http + html.as_buffer().to_pybytes())
            else:
                again = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}:{digest[:32]}>")]
                main = _record("revisit", capture, uri, both + again, http)
            to = ("WARC-Concurrent-To", capture)
            request = _record("request", f"<urn:request:{name}:{own}>", uri, [to, ("Content-Type", "application/http; msgtype=request")], f"GET / HTTP/1.1\r\nX-Target: {uri}\r\n\r\n".encode())
            told = b"" if page is None else f"page-id: {page}\r\n".encode()
            metadata = _record("metadata", f"<urn:metadata:{name}:{own}>", uri, [to, ("Content-Type", "application/warc-fields")], told)
            bundle += (main, request, metadata)
            held += len(main) + len(request) + len(metadata)
            k += 1
            if held >= BUNDLE_BYTES:
                yield full()
                held, bundle = 0, []
    if bundle:
        yield full()


def write_warc(captures: DataFrame, path: str, file_bundles: int = FILE_BUNDLES) -> None:
    """Writes three records for each row of ``plan_captures`` as gzipped WARC 1.1 files under ``path``."""
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "digest", "length", F.col("refers_to").cast("long").alias("refers_to"), "first")
    members = rows.mapInArrow(_write, "value binary").select(F.col("value").cast("string"))
    # the encoding is that of the separator alone: values are written byte by byte
    separator = _EMPTY_MEMBER.decode("latin-1")
    members.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_bundles).text(path)


def inflate(data: memoryview, step: int = 1 << 14) -> Iterator[bytes]:
    """The content of an archive, in parts: of all members of a gzip file, or as it is."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + (1 << 20)]) for i in range(0, len(data), 1 << 20))
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("the archive is cut short")
            part = data[at : at + step]
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive that comes in parts."""
    held, headers, begin, length = bytearray(), None, 0, 0
    for part in parts:
        held += part
        at = 0
        while True:
            if headers is None:
                while held[at : at + 2] == b"\r\n":
                    at += 2
                end = held.find(b"\r\n\r\n", at)
                if len(held) - at >= 5 and held[at : at + 5] != b"WARC/":
                    raise ValueError("no WARC record where one should begin")
                if end < 0:
                    break
                lines = held[at:end].decode("utf-8", "replace").split(CRLF)[1:]
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                begin, length = end + 4, int(headers["content-length"])
            if len(held) < begin + length:
                break
            yield headers, bytes(held[begin : begin + length])
            at, headers = begin + length, None
        del held[:at]
        begin -= at
    if headers is not None or bytes(held).strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in RECORDS.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)
    for batch in batches:
        for content in batch["content"]:
            rows, held = [], 0
            for h, block in parse(inflate(memoryview(content.as_buffer()))):
                length = h.get("x-payload-length")
                told = (h.get(k) for k in ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-payload-digest"))
                rows.append((*told, int(length) if length else None, h.get("content-type"), block))
                held += len(block) + 500
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, gzipped or not. A file that breaks off inside a record is
    an error."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_rows, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit record, its request and its metadata.

    The three are joined through concurrent-to identifiers: one exchange brings a capture and the records that name
    it together. A capture without a request or metadata record has a null struct there, of several the one with the
    least record id is taken; records that no capture claims, or that name none, are left out.
    """
    kind = F.col("warc_type")
    main = kind.isin("response", "revisit")
    payload = F.expr("case when warc_type = 'response' then substring(block, octet_length(substring_index(cast(block as string), '\r\n\r\n', 1)) + 5) end")
    response = F.struct("warc_type", "target_uri", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "payload_length", "refers_to", payload.alias("payload"))
    side = F.struct("record_id", "target_uri", F.col("block").cast("string").alias("text"))
    rows = records.select(
        F.when(main, F.col("record_id")).when(kind.isin("request", "metadata"), F.col("concurrent_to")).alias("capture_id"),
        F.when(main, response).alias("response"),
        F.when(kind == "request", side).alias("request"),
        F.when(kind == "metadata", side).alias("metadata"),
    )
    joined = rows.where("capture_id is not null").groupBy("capture_id").agg(F.first("response", True).alias("response"), F.min("request").alias("request"), F.min("metadata").alias("metadata"))
    return joined.where("response is not null")


def resolve(captures: DataFrame) -> DataFrame:
    """Captures as flat rows; ``refers_to`` of revisits: the page that the record they refer to names."""
    number = F.regexp_extract("metadata.text", "(?m)^page-id: (-?[0-9]+)\r?$", 1)
    referred = F.regexp_extract("response.refers_to", "^<urn:page:(-?[0-9]+):", 1)
    return captures.select(
        F.when(number != "", number.cast("long")).alias("page_id"),
        F.col("response.warc_type").alias("record_type"),
        F.col("response.target_uri").alias("url"),
        F.coalesce(F.sha2("response.payload", 256), "response.payload_digest").alias("payload_digest"),
        F.coalesce(F.octet_length("response.payload").cast("long"), "response.payload_length").alias("payload_bytes"),
        F.col("response.payload").alias("payload"),
        F.when(referred != "", referred.cast("long")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives under ``path`` and reads them back.

    One row per input row: page_id, url, record_type, payload (null for revisits), payload_bytes and
    payload_digest of the full payload, refers_to (page of the response that a revisit stands for). Null html
    is an empty payload, a null url an empty one; line ends in a url become blanks; rows without a page_id
    stay without. Repeated rows give repeated captures: all rows of the smallest page_id are responses, and
    ``WARC-Refers-To`` then is what their ids have in common. An empty table gives an empty result. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    path = path or new_path(spark, "warc")
    write_warc(plan_captures(pages, least), path)
    return resolve(transactions(read_records(spark, path)))
