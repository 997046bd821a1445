"""WARC archives compressed with Zstandard: written by Spark tasks and read back record by record.

An archive starts with a skippable frame that holds a dictionary (itself a Zstandard frame); every record is a frame of its own, compressed with that dictionary. The reader streams an
archive, loads the dictionary, decodes one frame at a time and validates it: version line, mandatory fields, Content-Length against the block, the end of the
record, one record a frame, and the payload's digest. What fails comes back as a row with a problem, not as an error.

Each task writes archives of bounded size under names of its own and returns a row for each; the table of these rows, committed by Spark, says which archives count. So an
attempt that is lost or runs twice leaves files that nothing reads. Equal payloads are found by their SHA-256 on small rows; a payload that is there already becomes a revisit record, without its bytes.

Cases: null html is an empty payload, null url an empty Target-URI; of equal payloads the record with the largest page_id is the response (null ids are smallest; of rows that repeat
that id too exactly one), null and repeated ids are kept as they are; payloads below least_bytes are all responses; line breaks and other control characters in a url are percent-encoded; payloads of any length make one record; an
empty table makes no archive and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import importable, scratch_root, small, table, written

#: The magic number of the skippable frame of a dictionary, that of a Zstandard frame and that of a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive ends when it has this many bytes. The date of records, as pages have none.
ARCHIVE_BYTES, DATE = 64_000_000, "2024-01-01T00:00:00Z"
#: The dictionary's size and what it is trained on: so many pages, drawn by a hash, a bounded start of each. It serves compression only.
DICT_BYTES, DICT_PAGES, DICT_CHARS = 32_768, 800, 4096

_MANIFEST = "path string, records bigint, bytes bigint"
_RECORDS = "archive string, record bigint, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, problem string"


def digest(payload: bytes) -> str:
    """The bare base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """The id of a page's record."""
    return f"<urn:quirelake:page:{'' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool = False, refers_to: int | None = None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page refers_to with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n", block, b"\r\n\r\n"])


def parsed(data: bytes) -> dict:
    """The columns of one decoded record; problem says what is wrong with it, or is None."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "problem"))

    def bad(why: str) -> dict:
        return out | {"problem": why}

    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] not in VERSIONS:
        return bad("no WARC version line")
    if not gap:
        return bad("the header does not end")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return bad("a header line without a name")
        try:
            fields.setdefault(name.strip().decode().lower(), value.strip().decode())
        except UnicodeDecodeError:
            return bad("a header line that is not UTF-8")
    out |= {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    if missing := [m for m in MANDATORY if m not in fields]:
        return bad(f"no {missing[0]}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        return bad("content-length is no number")
    size = int(fields["content-length"])
    if len(rest) < size + 4:
        return bad("the block is shorter than content-length")
    if rest[size:] != b"\r\n\r\n":
        return bad("no end of the record after content-length")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap:
        return bad("the HTTP head does not end")
    told = [v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    length = int(told[0]) if told and told[0].isdigit() else None
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    out |= {"payload_digest": value or None, "payload_bytes": length if out["record_type"] == "revisit" else len(payload)}
    if out["record_type"] == "revisit":
        if payload:
            return bad("a revisit with a payload")
        return out if length is not None and value else bad("a revisit without the payload's length or digest")
    out["payload"] = payload
    if length not in (None, len(payload)):
        return bad("the payload's length differs from the HTTP head")
    if name == "sha1" and value != digest(payload):
        return bad("the payload's digest differs")
    return out


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame with a compressed dictionary; nothing for an empty one."""
    body = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", SKIPPABLE, len(body)) + body if dictionary else b""


class _Source:
    """A stream with a look ahead."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.held = stream, b""

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) < n and (more := self.stream.read(max(n - len(self.held), 1 << 18))):
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def some(self) -> bytes:
        """Some next bytes, none at the end."""
        out, self.held = self.held or self.stream.read(1 << 18), b""
        return out

    def back(self, data: bytes) -> None:
        self.held = data + self.held


def frames(stream: BinaryIO) -> Iterator[tuple[bytes, str | None]]:
    """The decoded frames of an archive, one at a time, each with a problem or None; the first skippable frame of a dictionary's kind gives the dictionary."""
    source, decoder, first = _Source(stream), zstandard.ZstdDecompressor(), True
    while start := source.take(4):
        magic = struct.unpack("<I", start)[0] if len(start) == 4 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            told = source.take(4)
            size = struct.unpack("<I", told)[0] if len(told) == 4 else 0
            body = source.take(size)
            if len(told) < 4 or len(body) < size:
                yield b"", "a skippable frame is cut off"
                return
            if first and magic == SKIPPABLE:
                try:
                    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 24) if body[:4] == struct.pack("<I", FRAME) else body
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT))
                except zstandard.ZstdError as e:
                    yield b"", f"the dictionary cannot be read: {e}"
                    return
            first = False
            continue
        first = False
        if magic != FRAME:
            yield b"", "bytes that are no frame"
            return
        source.back(start)
        one, parts = decoder.decompressobj(), []
        try:
            while not one.eof:
                data = source.some()
                if not data:
                    yield b"", "the last frame is cut off"
                    return
                parts.append(one.decompress(data))
            source.back(one.unused_data)
        except zstandard.ZstdError as e:
            yield b"", f"a frame cannot be decoded: {e}"
            return
        yield b"".join(parts), None


def records(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive, parsed and checked."""
    for n, (data, problem) in enumerate(frames(stream)):
        yield {"record": n} | (parsed(data) if problem is None else {"problem": problem})


def trained_dictionary(pages: DataFrame, size: int = DICT_BYTES) -> bytes:
    """A dictionary of size bytes at most, from the starts of about DICT_PAGES different pages, drawn by a hash; empty where they are too few or too alike to train one."""
    share = min(1.0, DICT_PAGES / max(pages.count(), 1))
    at = F.xxhash64("page_id", "html")
    drawn = pages.where("length(html) > 0").select(at.alias("at"), F.substring("html", 1, DICT_CHARS).alias("start")).where(F.pmod("at", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.dropDuplicates(["at"]).orderBy("at").limit(2 * DICT_PAGES).collect()  # drawn first, so that tasks send few rows
    samples = [r.start.encode() for r in rows]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _writer(folder: str, dictionary: bytes, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        lead = dictionary_frame(dictionary)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
        out, name, n, size, done = None, "", 0, 0, []
        try:
            for b in (s for whole in batches for s in small(whole, 2)):
                for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        name, n, size = f"pages-{uuid.uuid4().hex}.warc.zst", 0, len(lead)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)  # the name would make pyarrow compress it again
                        out.write(lead)
                    frame = zip_.compress(record(page_id, url, payload or b"", revisit, refers_to))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        done.append((f"{folder}/{name}", n, size))
        finally:
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return run


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, payload, revisit, refers_to): what each row's record is.

    Rows meet by payload without it: counts by payload and id, then the largest id by payload. Only the payloads of several rows are joined back, so AQE may split a payload that many rows share.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    ids = rows.where(F.length("payload") >= least_bytes).groupBy("key", "page_id").agg(F.count("*").alias("n"))
    tops = ids.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("top")).where("n > 1")  # null ids are smallest
    tops = written(tops.select("key", F.col("top.page_id").alias("top_id"), F.col("top.n").alias("top_n")), "payloads")
    joined = rows.join(tops, "key", "left").withColumn("again", F.expr("top_n is not null and not page_id <=> top_id"))
    if tops.where("top_n > 1").limit(1).count():  # rows that repeat the id too: the one with the first url of them is the response
        tied = F.expr("top_n > 1 and page_id <=> top_id")
        first = F.row_number().over(Window.partitionBy("key").orderBy("url"))
        joined = joined.where(~F.coalesce(tied, F.lit(False))).unionByName(joined.where(tied).withColumn("again", first > 1))
    return joined.select("page_id", "url", "payload", F.col("again").alias("revisit"), F.expr("if(again, top_id, null)").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write pages(page_id, url, html) as archives into folder (any store that pyarrow opens by its uri); returns their table (path, records, bytes)."""
    spark = pages.sparkSession
    importable(spark)
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    write = _writer(folder, trained_dictionary(pages), archive_bytes, level)
    return written(revisits(pages, least_bytes).mapInArrow(write, _MANIFEST), "archives")


def _reader(payload: bool, schema: pa.Schema):
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, file = pafs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(file, compression=None) as stream:
                    for r in records(stream):
                        r["archive"] = path
                        if not payload:
                            r["payload"] = None
                        held.append(r)
                        size += 200 + len(r.get("payload") or b"")
                        if size > 4_000_000:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    return run


def read_archives(paths: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives paths(path): archive, record (its number), record_id, record_type, target_uri, refers_to (a record id), payload_digest, payload_bytes, payload, problem.

    A task reads an archive. Of a revisit the bytes and digest are those of the payload that it refers to. Without payload that column is null, and the bytes stay in the task.
    A frame that cannot be decoded ends its archive with a row that has a problem.
    """
    spark = paths.sparkSession
    importable(spark)
    number = pa.int64()
    schema = pa.schema([(c.split(" ")[0], {"bigint": number, "binary": pa.binary()}.get(c.split(" ")[1], pa.string())) for c in _RECORDS.split(", ")])
    paths = paths.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(_reader(payload, schema), _RECORDS)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder that others have written: (path). Only names are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", True).load(folder).select("path")


def dangling(found: DataFrame) -> DataFrame:
    """Revisits whose response is not among the records, or has another digest or length."""
    held = found.where("record_type = 'response'").selectExpr("record_id as refers_to", "payload_digest", "payload_bytes")
    return found.where("record_type = 'revisit'").join(held, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def pages_of(found: DataFrame) -> DataFrame:
    """The digest of records of pages: page_id, payload_bytes, payload_digest, record_type, refers_to (a page). A record with a problem ends the job."""
    checked = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "problem")))


    def page(c: str):
        return F.regexp_extract(c, "^<urn:quirelake:page:(-?[0-9]+)>$", 1).try_cast("bigint")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), page("refers_to").alias("refers_to"))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole pages table: written as archives in the shared folder, then read back from them."""
    archives = write_archives(table(spark, sf_dir, "pages"), f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}")
    return pages_of(read_archives(archives, payload=False))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
