"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writer. Payloads are compared by SHA-1. Of equal payloads (of at least
``min_dedup_bytes``) the record with the smallest id, the first of it if ids
repeat, is a ``response``; the others are ``revisit`` records that name it.
Digests alone are grouped; a payload travels once, to its archive, dealt out by
digest and a salt, so a payload that a third of all pages share is spread over
tasks. Each record is a gzip member of its own. Archives roll over at
``roll_bytes`` and are renamed into place when whole, so that a task that is run
again leaves the same set; the manifest that Spark commits names the files that
count. Files are written through pyarrow's file systems, to any folder it can
reach that all executors share.

Reader. A member is inflated, its checksum verified, its version line, headers,
length and payload digest checked. After a failed check the reader searches on
for the next place where a member (in plain archives: a version line) passes all
checks, takes up there, and logs the bytes between as a quarantined gap with the
reason, so one bad record costs only itself. Archives are read with Spark's
binary file source.

Cases: a null payload is empty, and equal to other empty ones; null ids and urls
are left out of the headers and read back as null; repeated rows become revisits
of the first; line breaks in a url are percent-encoded; other columns are not
read; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import new_path, written

SALTS = 16
_CHUNK = 1 << 15
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(
    kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None
) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the full length, and no payload."""
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    head += ["WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(Exception):
    """A check that failed; end is where the record would end by its own length, if it names one."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
_BLANK = re.compile(rb"\r?\n\r?\n")
_CLOSE = re.compile(rb"\r\n\r\n|\n\n")
SUSPECT = "inside the range that a damaged record names"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at a version line, and where it ends; Damaged if any check fails. Lines may end by LF alone."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    cut = _BLANK.search(data, at)
    if cut is None:
        raise Damaged("headers have no end")
    head = {}
    for line in data[at : cut.start()].split(b"\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        head[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    if length < 0:
        raise Damaged("length is negative")
    end = cut.end() + length
    block, close = data[cut.end() : end], _CLOSE.match(data, end)
    if len(block) < length or close is None:
        raise Damaged("length does not fit")
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and digest32(block) != want[5:]:
        raise Damaged("block digest differs", close.end())
    http, payload = block, b""
    if head.get("content-type", "").startswith("application/http") and (gap := _BLANK.search(block)):
        http, payload = block[: gap.start()], block[gap.end() :]
    want = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and want.startswith("sha1:") and digest32(payload) != want[5:]:
        raise Damaged("payload digest differs", close.end())
    m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    full = int(m[1]) if m else len(payload)
    return {"head": head, "payload": payload, "payload_bytes": full, "http": http, "suspect": False}, close.end()


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at a place inflates to, as far as it does, where it ends, and what is wrong with it, if anything."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    for step in (_CHUNK, 256, 1):  # a step that fails is tried again by smaller ones, to keep what stands before the fault
        while not z.eof and at < len(data):
            before = z.copy()
            try:
                out.append(z.decompress(view[at : at + step]))
            except zlib.error as e:
                z, reason = before, f"gzip: {e}"
                break
            at = min(at + step, len(data))
        else:
            whole = z.eof
            return b"".join(out), at - len(z.unused_data), "" if whole else "gzip: member is cut short"
    return b"".join(out), at, reason


def _lines(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """As salvage(), for plain bytes."""
    at, named = 0, 0
    while at < len(data):
        try:
            found, end = parse_record(data, at)
            found["suspect"] = at < named
            yield "record", at, end, found
            at = end
        except Damaged as e:
            start, reason = at, str(e)
            if e.end is not None and (e.end == len(data) or _NEXT.match(data, e.end)):
                at = e.end  # its own length leads to a place where a record may start
            else:
                named = max(named, _claimed_end(data, at))
                m = _VERSION.search(data, at + 1)
                while m is not None:
                    try:
                        parse_record(data, m.start())
                        break
                    except Damaged:
                        m = _VERSION.search(data, m.start() + 1)
                at = len(data) if m is None else m.start()
            yield "gap", start, at, reason


def _claimed_end(data: bytes, at: int) -> int:
    """Where the record at a place would end by the length in its headers; its start if it names none."""
    cut = _BLANK.search(data, at)
    m = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})\s*$", data[at : cut.start()]) if cut and _VERSION.match(data, at) else None
    return cut.end() + int(m[1]) if m else at


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, record) and ("gap", start, end, reason) that together cover the archive.

    Records of a gzip member, and gaps between them, have the place of the member. What a damaged member still inflates
    to is read as well; its gap then ends where the next member or version line that can be read starts. A record found
    inside the range that a damaged one names may be a quotation of its payload: it is ``suspect``."""
    at = 0
    while at < len(data):
        if data[at : at + 3] == b"\x1f\x8b\x08":
            inside, end, wrong = _inflate(data, at)
            events = list(_lines(inside))
            read = [(kind, at, end, x if kind == "record" else f"in the member at {a} to {b}: {x}") for kind, a, b, x in events]
            whole = not wrong and any(kind == "record" for kind, *_ in events)
            if whole:
                yield from read
                at = end
                continue
            end = _next_start(data, at)
            yield from ((kind, at, end, x) for kind, _, _, x in read if kind == "record")
            yield "gap", at, end, wrong or (events[0][3] if events else "empty member")
            at = end
            continue
        # Plain bytes up to the next member that can be read.
        end = next((m.start() for m in re.finditer(rb"\x1f\x8b\x08", data[at:]) if _opens(data, at + m.start())), None)
        end = len(data) if end is None else at + end
        yield from ((kind, at + a, at + b, x) for kind, a, b, x in _lines(data[at:end]))
        at = end


def _opens(data: bytes, at: int) -> bool:
    """Whether a member at a place inflates to what starts with a version line."""
    try:
        return _VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 512], 64)) is not None
    except zlib.error:
        return False


def _next_start(data: bytes, at: int) -> int:
    for m in _NEXT.finditer(data, at + 1):
        if data[m.start()] != 0x1F or _opens(data, m.start()):
            return m.start()
    return len(data)


def plan_records(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_dedup_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to: what is to be written, dealt out by digest and salt."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    counted = rows.where(F.length("payload") >= min_dedup_bytes).groupBy("digest")
    least = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first")
    again = counted.agg(least, F.count(F.lit(1)).alias("n")).where("n > 1")
    # Small rows, once for each salt: payloads that many share are then written by many tasks.
    again = again.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # All that decides is of the row itself, so a task that runs again decides alike; of equal rows one is as good as another.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(again, ["digest", "salt"], "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    place = F.row_number().over(Window.partitionBy("digest", "salt", "page_id", "url").orderBy(F.lit(1)))
    rows = rows.withColumn("place", place)
    revisit = F.col("first").isNotNull() & ~(is_first & (F.col("place") == 1))
    return rows.select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
    )


def write_warc(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_dedup_bytes: int = 0,
    roll_bytes: int = 16 << 20,
) -> DataFrame:
    """Write archives into folder; returns the manifest (path, n_records, bytes), itself written beside them."""
    schema = "path string, n_records long, bytes long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0

        def close() -> pd.DataFrame:
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            return pd.DataFrame([(f"{folder}/{name}", n, size)], columns=["path", "n_records", "bytes"])

        for x in batches:
            for r in x.itertuples(index=False):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/.{name}", compression=None)
                ids = [None if pd.isna(v) else int(v) for v in (r.page_id, r.refers_to)]
                url = None if r.url is None or r.url != r.url else r.url
                payload = bytes(r.payload)
                data = member(record(r.kind, ids[0], url, payload, digest32(payload), ids[1]))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    planned = plan_records(df, id_col, url_col, payload_col, min_dedup_bytes)
    return written(planned.mapInPandas(run, schema), "warc-manifest")


READ = (
    "path string, kind string, start long, end long, reason string, page_id long, url string, record_type string, "
    "payload binary, payload_bytes long, payload_digest string, refers_to long"
)


def read_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Records and quarantined gaps of archives: rows of (path, content), as Spark's binaryFile source gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ.split(", ")]
        for x in batches:
            for path, content in zip(x["path"], x["content"]):
                rows = []
                for kind, a, b, r in salvage(bytes(content)):
                    if kind == "gap":
                        rows.append((path, "gap", a, b, r) + (None,) * 7)
                    else:
                        h = r["head"]
                        numbers = [int(v) if (v := h.get(k, "")).lstrip("-").isdigit() else None for k in ("warc-page-id", "warc-refers-to-page-id")]
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append((path, "record", a, b, SUSPECT if r["suspect"] else None, numbers[0], h.get("warc-target-uri"), h.get("warc-type"), r["payload"], r["payload_bytes"], digest, numbers[1]))
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, READ)


def archive_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The archives that a manifest names, as (path, content)."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "path string, content binary")
    name = lambda c: F.substring_index(c, "/", -1).alias("name")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    named = manifest.select(name("path"))
    if files.select(name("path")).join(named, "name", "left_anti").isEmpty():
        return files.select("path", "content")
    # A lost task has left an archive that another attempt wrote anew.
    return files.withColumn("name", name("path")).join(named, "name", "left_semi").select("path", "content")


def round_trip(df: DataFrame, min_dedup_bytes: int = 0) -> DataFrame:
    """Write a WARC record for each row and read the archives back."""
    spark = df.sparkSession
    folder = new_path(spark, "warc")
    manifest = write_warc(df, folder, min_dedup_bytes=min_dedup_bytes)
    return read_warc(spark, archive_files(spark, manifest, folder))
