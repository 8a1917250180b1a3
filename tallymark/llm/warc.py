"""Web archives in ZIP packages: written by partition, read back by byte ranges.

A package holds its members stored, not compressed: archives (``archive/*.warc.gz``
with one gzip member per record, or ``archive/*.warc``) and indexes
(``indexes/*.cdxj`` or ``*.cdx``, also in gzip) with the place of each record. The
reader parses the end record and the central directory (ZIP64 included), finds
the members, lets Spark group the index into ranges of records and fetches only
those bytes. Nothing is unpacked to disk, and packages of other writers are read
by the same rules.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import materialize, work_dir

LEAST_BYTES = 1000  # shorter payloads never become revisits
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"  # the members that are written
READ_TYPES = ("response", "revisit")  # records of other types are passed over
INDEX_BATCH = 10_000  # index lines sent to Spark at once
HELD_BYTES = 32 << 20  # payloads sent to Spark at once
# Fixed values of the ZIP format: signatures and the fixed part of each record.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_END_FORM, _END64_FORM, _LOCATOR_FORM = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
_ENTRY_FORM, _LOCAL_FORM = "<4s6H3L5H2L", "<4s5H3L2H"
_ABSENT16, _ABSENT32 = 0xFFFF, 0xFFFFFFFF


class NotAnArchive(ValueError):
    """The bytes are no ZIP package, or not one that can be read by ranges."""


def open_file(uri: str):
    """Random access to a file of any store that has a Hadoop or cloud client."""
    files, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return files.open_input_file(path)


def _unpacked(form: str, data: bytes, signature: bytes) -> tuple:
    if len(data) < struct.calcsize(form) or data[:4] != signature:
        raise NotAnArchive(f"no record {signature!r} where one should be")
    return struct.unpack_from(form, data)[1:]


def _range(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def directory(file) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, place of the data, length) of each member, from the central directory alone."""
    total = file.size()
    tail_at = max(0, total - struct.calcsize(_END_FORM) - 0xFFFF)
    tail = _range(file, tail_at, total - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and tail_at + at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") > total:
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise NotAnArchive("no end record")
    *_, entries, length, start, _ = _unpacked(_END_FORM, tail[at:], _END)
    locator_at = tail_at + at - struct.calcsize(_LOCATOR_FORM)
    if entries == _ABSENT16 or length == _ABSENT32 or start == _ABSENT32:
        _, end64_at, _ = _unpacked(_LOCATOR_FORM, _range(file, max(0, locator_at), 20), _LOCATOR)
        *_, entries, length, start = _unpacked(_END64_FORM, _range(file, end64_at, 56), _END64)
    listing, at, members = _range(file, start, length), 0, {}
    for _ in range(entries):
        (_, _, flags, method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _, local
         ) = _unpacked(_ENTRY_FORM, listing[at:at + 46], _ENTRY)
        name = listing[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listing[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:  # field 1 holds, in this order, the values that do not fit above
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                size = next(wide) if size == _ABSENT32 else size
                packed = next(wide) if packed == _ABSENT32 else packed
                local = next(wide) if local == _ABSENT32 else local
            extra = extra[4 + n:]
        *_, local_name, local_extra = _unpacked(_LOCAL_FORM, _range(file, local, 30), _LOCAL)
        members[name] = (method, local + 30 + local_name + local_extra, packed)
        at += 46 + n_name + n_extra + n_comment
    return members


class _Span(io.RawIOBase):
    """Some bytes of an open file, as a stream."""

    def __init__(self, file, at: int, n: int):
        self._file, self._at, self._end = file, at, at + n

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = _range(self._file, self._at, min(len(buffer), self._end - self._at))
        buffer[:len(data)] = data
        self._at += len(data)
        return len(data)


def _index_lines(file, at: int, n: int) -> Iterator[str]:
    """The lines of an index, plain or in gzip, read piece by piece."""
    stream = io.BufferedReader(_Span(file, at, n), 1 << 20)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    for line in stream:
        yield line.decode("utf-8", "replace").strip()


def index_entry(line: str) -> dict | None:
    """The JSON block of an index line, bare or behind a key and a time stamp; None for blank and header lines."""
    if not line or line.startswith("!"):
        return None
    try:
        entry = json.loads(line if line.startswith("{") else line.split(" ", 2)[-1])
        return {"filename": entry.get("filename"), "offset": int(entry["offset"]), "length": int(entry["length"])}
    except (ValueError, KeyError, TypeError, AttributeError):
        raise NotAnArchive(f"no place of a record in the index line {line[:80]!r}") from None


def _sort_key(url: str | None) -> str:
    """The URL with its host reversed, without white space, as index lines are sorted by it."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:  # no valid host
        return "-"
    path = f"{parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    return "%20".join(f"{host}){path}".lower().split()) if host else "-"


def _head(first: str, fields: dict[str, str | int | None]) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields.items() if v is not None), "", ""]
    return "\r\n".join(lines).encode()


def _record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _escaped(text: str | None) -> str | None:
    """A header value on one line: line breaks as in a URL."""
    return text if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def _record(page: dict) -> bytes:
    payload = b"" if page["refers_to"] is not None else page["payload"]
    http = _head("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(page["payload"])})
    revisit = page["refers_to"] is not None
    head = _head("WARC/1.1", {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page["page_id"]),
        "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": _escaped(page["url"]),
        "WARC-Payload-Digest": f"sha1:{page['digest']}", "X-Page-Id": page["page_id"],
        "X-Refers-To-Page": page["refers_to"], "WARC-Refers-To": _record_id(page["refers_to"]) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + len(payload)})
    return head + http + payload + b"\r\n\r\n"


def _write_package(uri: str, pages: Iterator[dict], most: int) -> tuple[int, bool]:
    """Writes records until ``most`` bytes are in; the number written, and whether pages may be left."""
    files, path = pafs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    index, at, more = [], 0, False
    with files.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(ARCHIVE, "w", force_zip64=True) as member:
            for page in pages:
                record = gzip.compress(_record(page), 6, mtime=0)
                member.write(record)
                place = {"url": page["url"], "page": page["page_id"], "filename": ARCHIVE.rpartition("/")[2],
                         "offset": str(at), "length": str(len(record))}
                index.append(f"{_sort_key(page['url'])} 19700101000000 {json.dumps(place)}")
                at += len(record)
                if more := at >= most:
                    break
        package.writestr(INDEX, "\n".join(sorted(index)))
        package.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [
            {"name": "data.warc.gz", "path": ARCHIVE}, {"name": "index.cdxj", "path": INDEX}]}))
    return len(index), more


def _packages(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = (page for batch in batches for page in batch.to_pylist())
        more = True
        while more:
            # A task that is repeated writes files of its own; only the names that a finished task returns count.
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            n, more = _write_package(uri, pages, most)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n": [n]})
    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, most: int = PACKAGE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes one record per row and returns the packages (uri, n).

    Of equal payloads of ``least`` bytes or more, the largest id is a response and
    the others revisit it. Rows that tie for the largest id are all responses, and
    so are all rows of a group without an id. A null payload is empty, a null URL
    is left out. No rows give packages without records.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                       F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Pages of one payload meet by digest on the map side, so a payload of a third of all pages is one row per task.
    heads = materialize(own.filter(F.col("size") >= least).groupBy("digest", "size").agg(
        F.max("page_id").alias("head"), F.count("*").alias("k")).filter("k > 1").drop("k"), "payloads")
    joined = own.join(heads, ["digest", "size"], "left")
    refers = F.when(F.col("head") > F.coalesce("page_id", F.col("head") - 1), F.col("head"))
    records = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return materialize(records.mapInArrow(_packages(folder, most), "uri string, n long"), "packages")


def _index_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, archive, offset, length) of every index line; ``archive`` is the place of its member in the package."""
    def batch_of(uri: str, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_pydict({"uri": pa.array([uri] * len(rows), pa.string()), **{
            name: pa.array(column, pa.int64()) for name, column in zip(("archive", "offset", "length"), columns)}})

    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            with open_file(uri) as file:
                members = directory(file)
                archives = {n.rpartition("/")[2]: m for n, m in members.items()
                            if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
                indexes = [m for n, m in members.items() if n.startswith("indexes/")
                           and n.removesuffix(".gz").endswith((".cdxj", ".cdx"))]
                if not archives or not indexes:
                    raise NotAnArchive(f"{uri}: no archive or no index")
                if any(method != zipfile.ZIP_STORED for method, _, _ in (*archives.values(), *indexes)):
                    raise NotAnArchive(f"{uri}: an archive or index is not a stored member")
                rows = []
                for _, at, size in indexes:
                    for entry in filter(None, map(index_entry, _index_lines(file, at, size))):
                        name = entry["filename"] or (next(iter(archives)) if len(archives) == 1 else "")
                        if name.rpartition("/")[2] not in archives:
                            raise NotAnArchive(f"{uri}: the index names {name!r}, which is no archive of the package")
                        _, archive, size = archives[name.rpartition("/")[2]]
                        if not 0 <= entry["offset"] <= entry["offset"] + entry["length"] <= size:
                            raise NotAnArchive(f"{uri}: the index points outside {name!r}")
                        rows.append((archive, entry["offset"], entry["length"]))
                        if len(rows) == INDEX_BATCH:
                            yield batch_of(uri, rows)
                            rows = []
                yield batch_of(uri, rows)


def _index_ranges(packages: DataFrame, most: int) -> DataFrame:
    """(uri, archive, records): the records (offset, length) that start within the same ``most`` bytes of an archive.

    Index lines are in the order of the URLs, and may name a record twice or leave some out.
    """
    entries = packages.select("uri").mapInArrow(
        _index_entries, "uri string, archive long, offset long, length long")
    return entries.groupBy("uri", "archive", F.floor(F.col("offset") / most).alias("part")).agg(
        F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("records")).drop("part")


def parse_record(data: bytes) -> dict:
    """Header fields (names in lower case) and the payload: the block, for HTTP messages behind their head."""
    head, _, block = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise NotAnArchive(f"no WARC record: {version[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block, http = block[:int(fields["content-length"])], b""
    if fields.get("content-type", "application/http").startswith("application/http"):
        http, _, block = block.partition(b"\r\n\r\n")
    chunked = any(line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in http.split(b"\r\n"))
    return {"fields": fields, "payload": block, "chunked": chunked}


def _joined_chunks(block: bytes) -> bytes | None:
    """The body of a chunked transfer; None where the block is none, as some writers store it joined already."""
    out, at = [], 0
    while True:
        end = block.find(b"\r\n", at)
        size = block[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or len(size) > 16 or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if block[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(block[at:at + n])
        at += n + 2


def _digest(value: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a digest header; SHA-1 and SHA-256 are also written in base 32."""
    if not value:
        return None
    kind, _, digits = value.rpartition(":")
    kind = kind.lower().replace("-", "") or "sha1"
    if kind in ("sha1", "sha256") and len(digits.rstrip("=")) == {"sha1": 32, "sha256": 52}[kind]:
        digits = digits.rstrip("=")
        digits = base64.b32decode(digits.upper() + "=" * (-len(digits) % 8)).hex()
    return kind, digits.lower()


def _payload(record: dict) -> tuple[bytes, bool]:
    """The payload of a response, without chunk marks, and whether its digest allows it (or there is none to hold it against)."""
    stored, stated = record["payload"], _digest(record["fields"].get("warc-payload-digest"))
    joined = _joined_chunks(stored) if record["chunked"] else None
    payload = stored if joined is None else joined
    if stated is None or stated[0] not in ("sha1", "sha256", "md5") or "warc-truncated" in record["fields"]:
        return payload, True
    return payload, any(hashlib.new(stated[0], body).hexdigest() == stated[1] for body in {payload, stored})


def _page_id(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _records(with_payload: bool):
    names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "bytes", "record_id"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    if with_payload:
        names, types = [*names, "payload"], [*types, pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ((),) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def record_of(data: bytes) -> dict:
        if data[:2] == b"\x1f\x8b":
            one = zlib.decompressobj(31)
            data = one.decompress(data)
            if not one.eof:
                raise ValueError("a record ends before its end")
        return parse_record(data)

    def row_of(uri: str, record: dict) -> tuple:
        fields, kind = record["fields"], record["fields"]["warc-type"]
        if kind == "response":
            payload, right = _payload(record)
            if not right:
                raise ValueError(f"{uri}: the payload of {fields.get('warc-record-id')} is damaged")
            digest, size = sha1(payload).hexdigest(), len(payload)
        else:
            payload, size, stated = b"", None, _digest(fields.get("warc-payload-digest"))
            digest = stated and (stated[1] if stated[0] == "sha1" else ":".join(stated))
        row = (_page_id(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, digest,
               _page_id(fields.get("x-refers-to-page")), size, fields.get("warc-record-id"))
        return (*row, payload) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, archive, places in zip(*(batch.column(c).to_pylist() for c in ("uri", "archive", "records"))):
                first = places[0]["offset"]
                with open_file(uri) as file:
                    data = _range(file, archive + first, max(p["offset"] + p["length"] for p in places) - first)
                rows, held = [], 0
                for place in places:
                    at = place["offset"] - first
                    record = record_of(data[at:at + place["length"]])
                    if record["fields"].get("warc-type") in READ_TYPES:
                        rows.append(row_of(uri, record))
                        held += len(record["payload"])
                    if held >= HELD_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)
    return run


def read_archives(packages: DataFrame, with_payload: bool = False, most: int = RANGE_BYTES) -> DataFrame:
    """The response and revisit records of the packages named in the column ``uri``.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    record_id and, if asked for, the payload (empty for a revisit). page_id and
    refers_to come from fields that ``write_archives`` adds; in packages of others
    they are null. Records of other types are passed over. A payload is what lies
    behind the HTTP head, without the marks of a chunked transfer; its digest is the
    bare SHA-1, and it is held against the stated SHA-1, SHA-256 or MD5, with or
    without those marks; where it has none or is truncated, it is taken as it is. The
    digest of a revisit is the stated one (with its algorithm, if not SHA-1) and its
    size that of a response with this digest, else null. A record that an index names
    several times counts once; one that no index names is not read. A package without
    stored archives and indexes, or with places outside of them, raises NotAnArchive.
    """
    spark = packages.sparkSession
    ranges = materialize(_index_ranges(packages, most), "ranges")
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri", "archive", "records")
    schema = ("page_id long, url string, record_type string, payload_digest string, refers_to long, bytes long, "
              "record_id string")
    found = ranges.mapInArrow(_records(with_payload), schema + (", payload binary" if with_payload else ""))
    found = materialize(found, "records")
    targets = found.filter("record_type = 'revisit'").select("payload_digest").distinct()
    sizes = found.filter("record_type = 'response'").join(targets, "payload_digest", "left_semi") \
        .groupBy(F.col("payload_digest").alias("its")).agg(F.max("bytes").alias("size"))
    sizes = materialize(sizes, "sizes")
    matched = (F.col("payload_digest") == F.col("its")) & (F.col("record_type") == "revisit")
    return found.join(sizes, matched, "left").select(
        "page_id", "url", F.coalesce("bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        "record_id", *(["payload"] if with_payload else []))


def archive_folder(spark: SparkSession) -> str:
    folder = work_dir(spark, "archives")
    return folder if ":" in folder else f"file://{folder}"
