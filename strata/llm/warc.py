"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what a damaged archive still holds.

Archives are gzip files with one member per record, some megabytes each. The reader streams an archive, of whatever size,
through a window that holds about one record; members may hold one record or many. Where a member or record fails its
checks it searches for the next member that begins with a version line (or, in plain archives and inside members, for the
next version line), goes on from there, and reports the bytes between as a quarantined gap. Of a member that breaks off,
the records before the damage are kept, if their own digests hold.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import joined, materialise, scratch, small_batches, to_arrow

VERSION, MEMBER, END = b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n"
START = re.compile(rb"WARC/1\.[01]\r\n")
#: Compressed bytes after which the writer starts another archive.
ARCHIVE_BYTES = 32 << 20
#: Bytes read at a time, of a record's headers at most, and of a block at most.
STEP, HEADERS, LARGEST = 1 << 20, 1 << 20, 512 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, n_records long, n_bytes long"
RECORDS = "file string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, page_id long, problem string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the response's HTTP headers alone, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~.-_')}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, sha1 and size of each page's html in UTF-8 (null: empty)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.unhex(F.sha1(body)).alias("sha1"), F.length(body).cast("long").alias("size"))


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """sha1, size and the page_id of the response, for payloads of at least `least` bytes that several pages have."""
    return payloads(pages).where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").drop("n")


def located(path: str) -> tuple:
    """The pyarrow.fs file system of a path or URI as Spark writes them (blanks as they are), and the path there."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    host, _, name = rest.removeprefix("//").partition("/")
    fs, root = FileSystem.from_uri(f"{scheme}://{host}/")
    return fs, f"{root.rstrip('/')}/{name}"


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page under folder (any path that pyarrow.fs can write) and returns the manifest of archives.

    pages: page_id, url, html; other columns are ignored. A null html is empty, a null url is left out, and a row with a
    null page_id is written as a response of its own. Of several rows with the same largest page_id and payload each is
    a response, and so is each of rows that repeat it. Payloads are written whole, however long; smaller ones than `least`
    bytes are never revisits. An empty table writes nothing. An archive is written under a temporary name and
    renamed, so that a task which runs again leaves no half archive.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.unhex(F.sha1(body)).alias("sha1"))
    rows = joined(rows, materialise(revisits(pages, least)).drop("size"), "sha1", "left")
    rows = rows.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first_page"), F.col("first_page")).alias("refers_to"))
    schema = to_arrow(pages.sparkSession, MANIFEST)

    def run(batches):
        from pyarrow.fs import FileType
        from pyspark import TaskContext

        fs, root = located(folder)
        fs.create_dir(root)
        part, number, out, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal out, number
            if out:
                stream, temporary, n, size = out
                stream.close()
                name = f"pages-{part:06d}-{number:04d}.warc.gz"
                if fs.get_file_info(f"{root}/{name}").type != FileType.NotFound:  # of an earlier attempt; some stores don't replace
                    fs.delete_file(f"{root}/{name}")
                fs.move(temporary, f"{root}/{name}")
                done.append((name, n, size))
                out, number = None, number + 1

        for batch in batches:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not out:
                    temporary = f"{root}/_{part}-{uuid.uuid4().hex}.tmp"
                    out = [fs.open_output_stream(temporary, compression=None), temporary, 0, 0]
                member = gzipped(record(page, url, payload, digest(payload), refers_to))
                out[0].write(member)
                out[2], out[3] = out[2] + 1, out[3] + len(member)
                if out[3] >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

    return materialise(rows.mapInArrow(run, MANIFEST))


class Window:
    """Bytes of a stream of which only some are held: those not yet passed, as far as they were asked for."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.data, self.at, self.ended = read, bytearray(), 0, False

    def fill(self, n: int) -> bool:
        """Holds n bytes, if there are as many."""
        while len(self.data) < n and not self.ended:
            more = self.read(max(STEP, n - len(self.data)))
            self.data += more
            self.ended = not more
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def resync(self) -> None:
        """Passes at least one byte, up to the next version line or the end."""
        first = 1
        while self.fill(first + 16):
            found = START.search(self.data, first)
            if found:
                return self.skip(found.start())
            self.skip(max(1, len(self.data) - 16))
            self.fill(STEP)
            first = 0
        found = START.search(self.data, first)
        self.skip(found.start() if found else len(self.data))


def parse(window: Window, largest: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at the window's start: its length, headers and block; or what is wrong with it."""
    window.fill(16)
    head = START.match(window.data)
    if not head:
        return "no version line"
    size, stop = 4096, -1
    while stop < 0:
        window.fill(size)
        stop = window.data.find(END, head.end(), size)
        if stop < 0 and (size >= HEADERS or len(window.data) < size):
            return "headers don't end"
        size *= 4
    headers, name = {}, None
    for line in bytes(window.data[head.end() : stop]).split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on with the value before
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header without a colon"
        name = name.strip().lower().decode("latin-1")
        headers[name] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return "no content length"
    if int(length) > largest:
        return f"a block of {length} bytes, beyond the reader's {largest}"
    end = stop + 4 + int(length)
    if not window.fill(end + 4) or window.data[end : end + 4] != END:
        return "the block is cut short"
    block = bytes(window.data[stop + 4 : end])
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        return "the block's digest is wrong"
    return end + 4, headers, block


Found = tuple[int, int | None, dict[str, str] | None, bytes, str | None]


def gap(start: int, stop: int, why: str) -> Found:
    return start, stop - start, None, b"", why


def plain_records(file, largest: int) -> Iterator[Found]:
    file.seek(0)
    window, bad, why = Window(file.read), None, ""
    while window.fill(1):
        got = parse(window, largest)
        if isinstance(got, str):
            if bad is None:
                bad, why = window.at, got
            window.resync()
            continue
        if bad is not None:
            yield gap(bad, window.at, why)
            bad = None
        size, headers, block = got
        yield window.at, size, headers, block, None
        window.skip(size)
    if bad is not None:
        yield gap(bad, window.at, why)


class Member:
    """The records of the gzip member at a place. After them: end (where it stops), or None and kept (it was good up to there,
    to some kilobytes)."""

    def __init__(self, file, start: int, largest: int):
        self.file, self.start, self.largest, self.end, self.kept = file, start, largest, None, start
        self.z, self.at, self.made = zlib.decompressobj(31), start, 0
        self.pieces: deque[tuple[int, int]] = deque()  # content up to here came from the file's bytes from there on

    def inflated(self, _: int) -> bytes:
        while not self.z.eof:
            data = self.z.unconsumed_tail
            if not data:
                self.file.seek(self.at)
                data = self.file.read(STEP >> 5)
                self.at += len(data)
            if not data:
                raise zlib.error("the member breaks off")
            if out := self.z.decompress(data, STEP):
                self.made += len(out)
                self.pieces.append((self.made, self.at - len(data)))
                return out
        return b""

    def good(self, made: int) -> None:
        """Content up to here has been kept."""
        while self.pieces and self.pieces[0][0] < made:
            self.pieces.popleft()
        self.kept = self.pieces[0][1] if self.pieces else self.kept

    def records(self) -> Iterator[Found]:
        window, held, why, several = Window(self.inflated), None, None, False
        try:
            while window.fill(1):
                got = parse(window, self.largest)
                if isinstance(got, str):
                    why = why or got
                    window.resync()
                    continue
                if held:
                    yield self.start, None, *held, None
                    self.good(window.at)
                    several = True
                size, *held = got
                window.skip(size)
        except zlib.error as e:
            # the last record is kept if its own digest holds, unless it is all there is and the member's checksum is wrong
            if held and "warc-block-digest" in held[0] and (several or "incorrect" not in str(e)):
                yield self.start, None, *held, None
                self.good(window.at)
            return
        self.end = self.at - len(self.z.unused_data)
        if held:
            yield self.start, self.end - self.start, *held, None
        if why:
            yield gap(self.start, self.end, f"in a member: {why}")


def opens(file, at: int) -> bool:
    """Does a gzip member start here, whose content starts with a version line?"""
    file.seek(at)
    try:
        return bool(START.match(zlib.decompressobj(31).decompress(file.read(4096), 64)))
    except zlib.error:
        return False


def next_member(file, at: int, size: int) -> int:
    """The next place from `at` on where a member of records opens, or the size."""
    while at < size:
        file.seek(at)
        data, found = file.read(STEP + 2), -1
        while (found := data.find(MEMBER, found + 1)) >= 0:
            if opens(file, at + found):
                return at + found
        at += max(1, len(data) - 2) if len(data) > 2 else 3
    return size


def packed_records(file, size: int, largest: int) -> Iterator[Found]:
    at, bad = 0, None
    while at < size:
        file.seek(at)
        if file.read(3) != MEMBER:
            bad = at if bad is None else bad
            at = next_member(file, at + 1, size)
            continue
        member = Member(file, at, largest)
        for found in member.records():
            if bad is not None:
                yield gap(bad, at, "no readable gzip member")
                bad = None
            yield found
        if member.end is not None:
            if bad is not None:
                yield gap(bad, at, "no readable gzip member")
                bad = None
            at = member.end
        else:
            bad = member.kept if bad is None else bad
            at = next_member(file, at + 1, size)
    if bad is not None:
        yield gap(bad, size, "no readable gzip member")


def salvage(file, largest: int = LARGEST) -> Iterator[Found]:
    """(offset, length, headers, block, problem) of each record; headers None: a quarantined gap.

    file: bytes, or an open file that can be sought. Offsets are the file's; of a record in a member the offset and length
    are the member's, and the length is null for all but the last of several records in one.
    """
    file = io.BytesIO(file) if isinstance(file, bytes) else file
    size = file.seek(0, 2)
    size = file.tell() if size is None else size
    file.seek(0)
    head = file.read(STEP)
    packed = MEMBER in head[:64] or not START.search(head)
    yield from packed_records(file, size, largest) if packed else plain_records(file, largest)


def told(name: str, offset: int, length: int | None, headers: dict[str, str] | None, block: bytes, problem: str | None) -> tuple:
    """A row of RECORDS."""
    if headers is None:
        return name, offset, length, None, None, None, None, None, None, None, None, problem
    http, body = None, block
    if headers.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(END)
    kind = headers.get("warc-type")
    size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http or b"")
    want = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    revisit = kind == "revisit"
    page = headers.get("x-page-id", "")
    ours = None if revisit else digest(body)
    return (
        name, offset, length, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"),
        headers.get("x-refers-to-page-id") or headers.get("warc-refers-to"), want if revisit else ours,
        int(size[1]) if revisit and size else None if revisit else len(body), None if revisit else body,
        int(page) if re.fullmatch(r"-?\d{1,18}", page) else None, "the payload's digest is wrong" if ours and want and ours != want else None,
    )


def read_archives(spark: SparkSession, folder: str, glob: str = "*.warc*", largest: int = LARGEST, whole: bool = False) -> DataFrame:
    """A row per record, and one with a problem per quarantined gap, of every archive under folder.

    payload is the HTTP body (of other records: the block), null for revisits and gaps; payload_bytes and payload_digest
    are of the full payload, which for a revisit its stored HTTP headers and WARC headers tell; refers_to is a page_id if
    the writer was ours, else the record id of WARC-Refers-To. An archive is streamed by one task, which holds about one
    record and some megabytes; a record of more than `largest` bytes is a gap with that problem. A folder without archives
    gives an empty result. whole: read archives by Spark, each as one row, from stores that pyarrow.fs doesn't know.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    schema = to_arrow(spark, RECORDS)
    small_batches(spark)

    def run(batches):
        for batch in batches:
            for path, *content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                fs, name = (None, None) if whole else located(path)
                for found in salvage(content[0] if whole else fs.open_input_file(name), largest):
                    rows.append(told(path.rpartition("/")[2], *found))
                    size += len(found[3])
                    if len(rows) >= 500 or size >= STEP << 3:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", *(["content"] if whole else [])).mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes the pages' archives (to folder, or a new one in the shared scratch folder) and reads them back."""
    spark = pages.sparkSession
    folder = folder or scratch(spark)
    if not write_archives(pages, folder, least).limit(1).count():
        return spark.createDataFrame([], RECORDS)
    return read_archives(spark, folder)


# DuckDB SQL for the digest of archive_round_trip's rows over `pages`. Base32: each five hexadecimal digits are four letters.
ROUND_TRIP_SQL = r"""
with p as (select page_id, coalesce(html, '') html, max(page_id) over (partition by coalesce(html, '')) last from pages),
h as (select *, sha1(html) hex from p)
select page_id, strlen(html)::bigint payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') payload_digest,
       case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to from h
"""
