"""WARC archives with a two-level capture index.

Lines of the index are sorted by reversed-host URL key and capture id and lie in compressed blocks; a sparse
directory has each block's first key and place. A look-up searches the list of directories, then one directory,
then one block, all by bisection, and reads the record's range from its archive.

Executors write files under names of their own and hand back rows that name them, so a task that runs twice
leaves an unused file and no wrong row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import cut, new_folder, slices, small_batches

#: Lines of the index in a block.
BLOCK_LINES = 512
#: Date of the records; captures of one run share it.
DATE = "2024-01-01T00:00:00Z"

# Fixed value: the revisit profile of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: `org,example,www)/a?b`. Not an URL: the text itself."""
    text = (url or "").strip().replace(" ", "%20")
    try:
        parts = urlsplit(text)
        host, port = parts.hostname, parts.port
    except ValueError:
        return text
    if not host:
        return text
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, capture: int | None) -> bytes:
    """Sorts by URL key, then by capture id."""
    return f"{url_key(url)} {(capture if capture is not None else -(1 << 63)) + (1 << 63):020d}".encode()


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _name(capture: int | None) -> str:
    return f"<urn:page:{'none' if capture is None else capture}>"


def _page(name: str) -> int | None:
    value = name.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def record(capture: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(capture)}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Target-URI: {' '.join((url or '').split())}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """Type, capture, payload (None for a revisit), its full size and digest, and what a revisit refers to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_type": fields["warc-type"],
        "capture": _page(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload": None if revisit else payload,
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "refers_to": _page(fields["warc-refers-to"]) if revisit else None,
    }


def deduplicated(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Rows (capture, url, body, digest, refers_to, revisit): of equal payloads of `least` bytes or more, those
    below the largest id revisit it. Null bodies are empty payloads; a null id never is the response of others."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("capture"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"))
    groups = rows.filter(F.octet_length("body") >= least).groupBy("digest").agg(F.max("capture").alias("newest")).withColumnRenamed("digest", "of")
    joined = rows.join(groups, F.col("digest") == F.col("of"), "left")
    revisit = F.col("newest").isNotNull() & ~F.col("capture").eqNullSafe(F.col("newest"))
    return joined.select("capture", "url", "body", "digest", F.when(revisit, F.col("newest")).alias("refers_to"), revisit.alias("revisit"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write archives into folder; rows (key, file, start, size) of the captures, already computed."""
    _filesystem(folder, make=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for part in slices(batch):
                keys, starts, sizes = [], [], []
                for capture, url, body, digest, refers_to, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out = out or files.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(record(capture, url, body.encode(), base32_sha1(digest), refers_to, revisit), 1, mtime=0)
                    out.write(member)
                    keys.append(capture_key(url, capture))
                    starts.append(at)
                    sizes.append(len(member))
                    at += len(member)
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([name] * len(keys)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["key", "file", "start", "size"])
        if out:
            out.close()

    small_batches(rows.sparkSession)
    return cut(rows.select("capture", "url", "body", "digest", "refers_to", "revisit").mapInArrow(run, "key binary, file string, start bigint, size bigint"))


def index(captures: DataFrame, folder: str) -> list[tuple[bytes, str]]:
    """Write the sorted blocks and their directories; (first key, directory file) by range of keys, one for each partition."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        name, out, at, held, directory = uuid.uuid4().hex, None, 0, [], []

        def block() -> None:
            nonlocal out, at
            out = out or files.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
            member = gzip.compress(b"\n".join(held), 6, mtime=0)
            out.write(member)
            directory.append(b"%s\t%d\t%d" % (held[0].partition(b"\t")[0], at, len(member)))
            at += len(member)
            held.clear()

        for batch in batches:
            for key, file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(b"%s\t%s\t%d\t%d" % (key.replace(b"\t", b"%09").replace(b"\n", b"%0A"), file.encode(), start, size))
                if len(held) == BLOCK_LINES:
                    block()
        if held:
            block()
        if out:
            out.close()
            with files.open_output_stream(f"{root}/{name}.dir") as top:
                top.write(b"\n".join(directory))
            yield pa.record_batch([pa.array([directory[0].partition(b"\t")[0]], pa.binary()), pa.array([name])], ["first", "name"])

    ordered = captures.repartitionByRange(parts, "key", "file", "start").sortWithinPartitions("key", "file", "start")
    found = cut(ordered.mapInArrow(run, "first binary, name string")).collect()  # a row for each partition
    return sorted((bytes(r["first"]), r["name"]) for r in found)


class Reader:
    """Look-ups in one archive folder; keeps the directory and the block it read last, which suits sorted look-ups."""

    def __init__(self, folder: str, tops: list[tuple[bytes, str]]) -> None:
        self.files, self.root = _filesystem(folder)
        self.tops, self.firsts = tops, [t[0] for t in tops]
        self._directory: tuple[int, list[tuple[bytes, int, int]], list[bytes]] = (-1, [], [])
        self._block: tuple[tuple[int, int], list[bytes], list[bytes]] = ((-1, -1), [], [])
        self._open: dict[str, pa.NativeFile] = {}

    def _read(self, file: str, start: int, size: int) -> bytes:
        if file not in self._open:
            if len(self._open) >= 64:
                self._open.pop(next(iter(self._open))).close()
            self._open[file] = self.files.open_input_file(f"{self.root}/{file}")
        return self._open[file].read_at(size, start)

    def directory(self, part: int) -> tuple[list[tuple[bytes, int, int]], list[bytes]]:
        if self._directory[0] != part:
            with self.files.open_input_stream(f"{self.root}/{self.tops[part][1]}.dir") as source:
                rows = [(k, int(a), int(n)) for k, a, n in (line.split(b"\t") for line in source.read().split(b"\n"))]
            self._directory = (part, rows, [r[0] for r in rows])
        return self._directory[1:]

    def block(self, part: int, number: int) -> tuple[list[bytes], list[bytes]]:
        if self._block[0] != (part, number):
            _, start, size = self.directory(part)[0][number]
            lines = gzip.decompress(self._read(f"{self.tops[part][1]}.cdx.gz", start, size)).split(b"\n")
            self._block = ((part, number), lines, [x.partition(b"\t")[0] for x in lines])
        return self._block[1:]

    def lines(self, low: bytes, high: bytes) -> Iterator[list[bytes]]:
        """Index lines with low <= key < high, in order, as fields (key, file, start, size)."""
        part = max(bisect_left(self.firsts, low) - 1, 0)
        while part < len(self.tops) and (self.firsts[part] < high):
            rows, firsts = self.directory(part)
            number = max(bisect_left(firsts, low) - 1, 0)
            while number < len(rows) and firsts[number] < high:
                lines, keys = self.block(part, number)
                for line in lines[bisect_left(keys, low) : bisect_left(keys, high)]:
                    yield line.split(b"\t")
                number += 1
            part += 1

    def fetch(self, line: list[bytes]) -> dict:
        raw = self._read(line[1].decode(), int(line[2]), int(line[3]))
        return parse(zlib.decompress(raw, 31))

    def captures(self, url: str) -> Iterator[dict]:
        """All captures of an URL, oldest id first."""
        key = url_key(url).encode().replace(b"\t", b"%09").replace(b"\n", b"%0A")
        for line in self.lines(key + b" ", key + b" :"):
            yield self.fetch(line)


def look_up(wanted: DataFrame, folder: str, tops: list[tuple[bytes, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id, payload_bytes, payload_digest, record_type, refers_to), read back for each capture wanted."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [capture_key(u, c) for c, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary())], [id_col, "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, tops)
        last, places = None, []
        for batch in batches:
            found = []
            for key in batch.column(1).to_pylist():
                key = key.replace(b"\t", b"%09").replace(b"\n", b"%0A")
                if key != last:
                    last, places = key, list(reader.lines(key, key + b"\0"))
                found.append(places.pop(0) if len(places) > 1 else places[0])  # a repeated row has a record of its own
            rows = [reader.fetch(line) for line in found]
            columns = [pa.array([r[k] for r in rows], t) for k, t in (("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))]
            yield pa.record_batch([batch.column(0), *columns], [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = wanted.schema[id_col].dataType.simpleString()
    keys = wanted.select(id_col, url_col).mapInArrow(keyed, f"`{id_col}` {kind}, key binary")
    ordered = keys.repartitionByRange(parts, "key", id_col).sortWithinPartitions("key")
    return ordered.mapInArrow(run, f"`{id_col}` {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> tuple[str, list[tuple[bytes, str]]]:
    """Write pages (page_id, url, html) and their index; the folder and the list of directories."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return folder, index(write(deduplicated(pages, least), folder), folder)


def _filesystem(folder: str, make: bool = False) -> tuple[pafs.FileSystem, str]:
    uri = folder if "://" in folder else f"file://{folder}"
    files, root = pafs.FileSystem.from_uri(uri)
    if make:
        files.create_dir(root, recursive=True)
    return files, root
