"""WARC archives: write, normalise and read back, all through Spark's own readers and writers.

A monolithic archive is one gzip stream over all its records, from which no record can be read by itself.  The
normaliser inflates each file's stream once, piece by piece, cuts it into records by their stated lengths and
deflates every record as a gzip member of its own.  The members of a file form the new archive, written by the same
task.  A member states its size in its header's extra field, so the sidecar index, which says where each begins, is
made by going from header to header.  Members are joined by Spark's text writer, whose line separator is an empty
gzip member: the result is a plain multi-member file that any reader of such archives takes.

Archives are the unit of work.  Writers bound them by ``RECORDS`` records each, so a task holds one file's
compressed bytes and one record at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.session import stage

#: most records of one written archive
RECORDS = 4096
#: payloads below this many bytes are never stored as revisits
SMALL = 1000
_STEP = 1 << 18
#: an empty gzip member: header, empty deflate block, checksum and length 0
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_URN = "urn:page:"
_END = "\r\n"


def payload(html: Column) -> Column:
    """UTF-8 bytes; null is empty."""
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def verdicts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", small: int = SMALL) -> DataFrame:
    """(id, digest, refers_to) of the pages that revisit another: of equal payloads of at least ``small`` bytes the
    largest id is the response.  Rows that repeat that id are responses too; a null id is less than all others."""
    body = payload(F.col(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(body).alias("digest"), F.length(body).alias("size"))
    rows = rows.filter(F.col("size") >= small).select("id", "digest").distinct()
    first = rows.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1")
    return rows.join(first.drop("rows"), "digest").filter("id is null or id != refers_to").select("id", "digest", "refers_to")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = SMALL) -> DataFrame:
    """One WARC record per page as text, in column ``record``; the closing line break is left to the writer."""
    body = payload(F.col(html_col))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        # a header holds one line
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        body.alias("body"),
        F.sha1(body).alias("digest"),
    )
    # written first, so that Spark knows its size and moves the pages only if the revisits are too many to send around
    back = stage(verdicts(pages, id_col, html_col, small), "warc-revisits")
    back = back.select(F.col("id").alias("i"), F.col("digest").alias("d"), "refers_to")
    rows = rows.join(back, rows["id"].eqNullSafe(back["i"]) & (rows["digest"] == back["d"]), "left")
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    size = F.length("body")
    stored = F.when(revisit, F.lit("")).otherwise(F.col("body").cast("string"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        size.cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.when(revisit, F.lit(0)).otherwise(size).cast("string"),
        F.lit("\r\n\r\n"),
        stored,
        F.lit(_END),
    )
    return rows.select(record.alias("record"))


def write_monolithic(rows: DataFrame, path: str) -> None:
    """Archives that are one gzip stream each, of at most ``RECORDS`` records."""
    writer = rows.select("record").write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS).text(path)


def inflate(data: bytes) -> Iterator[bytes]:
    """The uncompressed bytes of a gzip file of one or more members, piece by piece; each is inflated once."""
    rest = data
    while rest:
        stream = zlib.decompressobj(31)
        out = stream.decompress(rest, _STEP)
        while True:
            if out:
                yield out
            if stream.eof:
                break
            if not stream.unconsumed_tail and not out:
                raise ValueError("the archive ends within a member")
            out = stream.decompress(stream.unconsumed_tail, _STEP)
        rest = stream.unused_data


def _headers(top: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in top.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of each record of an uncompressed WARC stream."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (head := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record header")
                return
        if not held.startswith(b"WARC/"):
            raise ValueError("a record has to begin with its version")
        headers = _headers(bytes(held[:head]))
        after = head + 4 + int(headers["content-length"])
        while len(held) < after + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield headers, bytes(held[head + 4 : after]), bytes(held[: after + 4])
        del held[: after + 4]


#: gzip header with an extra field of one four-byte entry named SL, the member's size
_HEAD = bytes([0x1F, 0x8B, 8, 4, 0, 0, 0, 0, 0, 0xFF, 8, 0]) + b"SL" + bytes([4, 0])


def deflate(record: bytes) -> bytes:
    """One gzip member that states its size, the same bytes every time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = len(_HEAD) + 4 + len(body) + 8
    return _HEAD + struct.pack("<I", size) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def places(archive: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record's member, from header to header."""
    at = 0
    while at < len(archive):
        if archive.startswith(EMPTY_MEMBER, at):
            at += len(EMPTY_MEMBER)
            continue
        if not archive.startswith(_HEAD, at):
            raise ValueError("not a member of a normalised archive")
        (size,) = struct.unpack_from("<I", archive, at + len(_HEAD))
        yield at, size
        at += size


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows = []
            for number, (_, _, record) in enumerate(split_records(inflate(content.as_py()))):
                rows.append((path.as_py(), number, deflate(record)))
                if len(rows) == 64:
                    yield _table(rows, _MEMBERS)
                    rows = []
            if rows:
                yield _table(rows, _MEMBERS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(batch.column("archive"), batch.column("content"), strict=True):
            whole, rows = content.as_py(), []
            for number, (offset, length) in enumerate(places(whole)):
                # a record's header is at its member's beginning
                top = zlib.decompressobj(31).decompress(whole[offset : offset + length], _STEP).partition(b"\r\n\r\n")[0]
                headers = _headers(top)
                rows.append((archive.as_py(), number, offset, length, headers.get("warc-record-id"), headers.get("warc-type")))
            if rows:
                yield _table(rows, _PLACES)


_MEMBERS = {"archive": pa.string(), "number": pa.int64(), "member": pa.binary()}
_PLACES = {"archive": pa.string(), "number": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "record_id": pa.string(), "record_type": pa.string()}


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def _archives(spark: SparkSession, target: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{target}/archives")
    return files.select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content")


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite all gzip archives of folder ``source``: ``target``/archives (one multi-member file per source file, in a
    folder named after it) and ``target``/index (the sidecar: archive, number, offset, length, record_id, record_type).

    A damaged or cut archive fails the job and names what is wrong.  A folder of empty archives gives an empty index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    members = files.mapInArrow(_members, "archive string, number long, member binary")
    name = F.regexp_extract("archive", r"part-(\d+-[0-9a-f-]+-c\d+)|([^/]+)$", 0)
    # a source file is read by one task, which also writes its new archive
    (
        members.select(name.alias("archive"), "number", F.col("member").cast("string").alias("value"))
        .sortWithinPartitions("archive", "number")
        .select("archive", "value")
        .write.partitionBy("archive")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(f"{target}/archives")
    )
    index = _archives(spark, target).mapInArrow(_index, ", ".join(f"{c} {'long' if k == pa.int64() else 'string'}" for c, k in _PLACES.items()))
    index.write.parquet(f"{target}/index")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, wanted in zip(batch.column("content"), batch.column("places"), strict=True):
            whole, rows = content.as_py(), []
            for place in wanted.as_py():
                member = whole[place["offset"] : place["offset"] + place["length"]]
                ((headers, block, _),) = split_records(inflate(member))
                rows.append((headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"),
                             headers.get("warc-payload-digest"), headers.get("x-payload-length"), headers.get("warc-refers-to"), block))
            if rows:
                names = ["record_id", "record_type", "url", "digest", "size", "refers_to", "block"]
                kinds = [*[pa.string()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """The records of a normalised folder, each read at the place that the index gives: record_id, record_type, url,
    digest, size, refers_to and block (the payload bytes, empty for revisits)."""
    index = spark.read.parquet(f"{target}/index")
    wanted = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    both = _archives(spark, target).join(wanted.hint("shuffle_hash"), "archive").select("content", "places")
    return both.mapInArrow(
        _parse, "record_id string, record_type string, url string, digest string, size string, refers_to string, block binary"
    )


def page_table(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records read back.

    For responses, length and digest are those of the payload that was read; a revisit's are those its header
    states.
    """
    number = lambda c: F.regexp_extract(c, rf"<{_URN}(-?\d+)>", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return found.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("size").cast("long")).otherwise(F.length("block").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.expr("substr(digest, 6)")).otherwise(F.sha1("block")).alias("payload_digest"),
        "record_type",
        F.when(revisit, number(F.col("refers_to"))).alias("refers_to"),
    )
