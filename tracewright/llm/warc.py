"""WARC records in ZIP packages (operator 11): writing, and reading by range.

A package is a ZIP file with stored members: archives (``archive/*.warc.gz``, each
record a gzip member of its own), an index of their records (``indexes/*.cdxj``) and a
list of resources.  The reader never extracts.  For each package it reads the end
record, the ZIP64 end record where there is one, and the central directory in blocks;
finds archives and indexes; turns index lines into runs of neighbouring records with
absolute places in the package; deals the runs out; and each task reads its runs by
range.  Archives that no index names are read in order by one task; members that are
deflated are inflated as a stream, archives among them in order.

Writing decides first which records are revisits, on digests alone: payloads are
aggregated by digest before they move, so a payload that a third of all pages share
travels once for each task that reads it; of equal payloads of ``least`` bytes or more
the one with the smallest id (nulls last, then url) is written in full, others refer to it.
Each task writes its packages under new names and returns them; the settled list of
packages says which count, so what a lost task has left behind is never read.

Files are reached by pyarrow's file systems, from the address of the shared folder.

Defined results: null html is an empty payload; rows with null ids or urls keep null;
repeated rows are records of their own, one the response, the others revisits; empty
tables give no package; payloads of any length are written and read whole, one at a
time; control characters and non-ASCII in urls and ids are percent-encoded in headers
and read back; further columns are ignored, whatever their names; a file that is no ZIP,
an encrypted member, or a record that is no WARC raises ValueError with its place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, attach, scratch_folder, settle, small_batches

#: Bytes after which an archive member, and a package, is closed.
MEMBER_BYTES, PACKAGE_BYTES = 16 << 20, 128 << 20
#: Bytes of a range read over neighbouring records; a longer record is one read.
RUN_BYTES = 4 << 20
#: Bytes of a directory or index read at once, and index lines sorted by place at once.
BLOCK, LINES = 1 << 20, 100_000
#: Rows that one row is multiplied to at once.
COPIES = 4096
DATE = "2020-01-01T00:00:00Z"
SAFE = "!#$&'()*+,/:;=?@[]~"
STORED, DEFLATED = 0, 8


def base32(hex_: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits, five of them at a time."""
    five = [F.lpad(F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*five), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# --- writing


def warc_record(kind: str, record_id: str, url: str | None, source: str | None, payload: bytes | None, size: int, digest: str, refers: tuple[str, str | None] | None = None) -> bytes:
    """One record; a revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if payload is None else head + payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Source-ID": source, "WARC-Payload-Digest": f"sha1:{digest}"}
    fields["WARC-Block-Digest"] = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    if refers:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{refers[0]}>", "WARC-Refers-To-Target-URI": refers[1]}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Package:
    """A package as it is written: records go in, members are closed as they fill up."""

    def __init__(self, out, member_bytes: int = MEMBER_BYTES):
        self.zip, self.member_bytes = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True), member_bytes
        self.open: list[bytes] = []
        self.at = self.bytes = self.records = self.members = 0
        self.index: list[str] = []
        self.resources: list[dict] = []

    def _put(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data)
        self.resources.append({"name": name.split("/")[-1], "path": name, "hash": "sha256:" + hashlib.sha256(data).hexdigest(), "bytes": len(data)})

    def _close_member(self) -> None:
        if self.open:
            self._put(f"archive/data-{self.members:05}.warc.gz", b"".join(self.open))
            self.open, self.at, self.members = [], 0, self.members + 1

    def add(self, record: bytes, url: str | None, digest: str) -> None:
        data = gzipped(record)
        facts = {"url": url, "digest": f"sha1:{digest}", "offset": str(self.at), "length": str(len(data)), "filename": f"data-{self.members:05}.warc.gz"}
        self.index.append(f"{url or '-'} 20200101000000 {json.dumps(facts)}\n")
        self.open.append(data)
        self.at, self.bytes, self.records = self.at + len(data), self.bytes + len(data), self.records + 1
        if self.at >= self.member_bytes:
            self._close_member()

    def close(self) -> None:
        self._close_member()
        self._put("indexes/index.cdxj", "".join(sorted(self.index)).encode())
        self._put("datapackage.json", json.dumps({"profile": "data-package", "resources": self.resources}).encode())
        self.zip.close()


def _writer(folder: str, member_bytes: int, package_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        package = out = name = None

        def closed() -> pd.DataFrame:
            package.close()
            out.close()
            return pd.DataFrame([(f"{folder}/{name}", package.records)], columns=["package", "records"])

        for b in batches:
            for r in b.itertuples(index=False):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = system.open_output_stream(f"{root}/{name}")
                    package = Package(out, member_bytes)
                url, first_url, source = (None if x is None else quote(x, SAFE) for x in (r.url, r.first_url, r.source))
                refers = None if r.refers is None else (str(uuid.UUID(r.refers)), first_url)
                payload = None if r.payload is None else bytes(r.payload)
                package.add(warc_record("response" if refers is None else "revisit", str(uuid.UUID(r.record)), url, source, payload, r.size, r.digest, refers), url, r.digest)
                if package.bytes >= package_bytes:
                    yield closed()
                    package = None
        if package is not None:
            yield closed()

    return run


def decided(pages: DataFrame, id_col: str, least: int) -> DataFrame:
    """The records to write: source, url, digest, size, payload (null for revisits), record
    and refers (keys of records, null for responses), first_url."""
    rows = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    key = lambda id_, url, copy: F.md5(F.to_json(F.struct(F.col("digest"), id_.cast("string").alias("i"), url.alias("u"), copy.alias("c"))))
    nobody = F.lit(None).cast("string")
    large = rows.filter(F.col("size") >= least)
    kinds = large.groupBy("digest", "size", "id", "url").agg(F.count(F.lit(1)).alias("n"))
    firsts = kinds.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first"), F.sum("n").alias("total"))
    firsts = firsts.select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), "total")
    # One payload for each digest leaves a task, however many rows have it.
    payloads = large.groupBy(F.col("digest").alias("d")).agg(F.first("payload").alias("payload"))
    zero = F.lit(0).cast("long")
    full = payloads.join(firsts, F.col("d") == F.col("digest")).withColumn("size", F.octet_length("payload").cast("long"))
    responses = full.select(F.col("first_id").cast("string").alias("source"), F.col("first_url").alias("url"), base32(F.col("digest")).alias("digest"), "size", "payload", key(F.col("first_id"), F.col("first_url"), zero).alias("record"), nobody.alias("refers"), nobody.alias("first_url"))
    total = large.count()
    of = firsts.select(F.col("digest").alias("d"), "first_id", "first_url", "total").filter("total > 1")
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    copies = attach(kinds, of, F.col("digest") == F.col("d"), F.col("total") * HOT > total).withColumn("k", F.col("n") - is_first.cast("long")).filter("k > 0")
    blocks = copies.withColumn("block", F.explode(F.sequence(zero, F.floor((F.col("k") - 1) / COPIES)))).repartition("digest", "id", "url", "block")
    each = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least("k", (F.col("block") + 1) * COPIES))))
    revisits = each.select(F.col("id").cast("string").alias("source"), "url", base32(F.col("digest")).alias("digest"), "size", F.lit(None).cast("binary").alias("payload"), key(F.col("id"), F.col("url"), F.col("copy")).alias("record"), key(F.col("first_id"), F.col("first_url"), zero).alias("refers"), "first_url")
    out = responses.union(revisits)
    if least > 0:
        small = rows.filter(F.col("size") < least).withColumn("copy", F.monotonically_increasing_id())
        out = out.union(small.select(F.col("id").cast("string").alias("source"), "url", base32(F.col("digest")).alias("digest"), "size", "payload", key(F.col("id"), F.col("url"), F.col("copy")).alias("record"), nobody.alias("refers"), nobody.alias("first_url")))
    return out


def write_packages(pages: DataFrame, id_col: str = "page_id", least: int = 0, folder: str | None = None, member_bytes: int = MEMBER_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each row of (id, url, html); the settled list of packages: package, records."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch_folder(spark, "warc")
    return settle(decided(pages, id_col, least).mapInPandas(_writer(folder, member_bytes, package_bytes), "package string, records long"), "packages")


# --- reading

Read = Callable[[int, int], bytes]  # (place, bytes)


def directory(read: Read, size: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, place of its local header, stored bytes, bytes) of each member, from the central directory."""
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    end = len(tail)
    while True:
        end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("no ZIP end record")
        if len(tail) >= end + 22 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    entries, length, offset = struct.unpack_from("<HLL", tail, end + 10)
    over = tail_at + end
    locator = read(over - 20, 20) if over >= 20 else b""
    if locator[:4] == b"PK\6\7":
        # Where the locator says or, with bytes before the archive, right before the locator.
        for at in (struct.unpack_from("<Q", locator, 8)[0], over - 76):
            record = read(at, 56) if 0 <= at < over else b""
            if record[:4] == b"PK\6\6":
                break
        else:
            raise ValueError("no ZIP64 end record where the locator says")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        over = at
    shift = over - length - offset  # bytes before the archive
    if shift < 0:
        raise ValueError("the central directory does not fit the file")
    at, stop, held = offset + shift, over, b""
    for _ in range(entries):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<3H", held, 28)):
            more = read(at, min(BLOCK, stop - at))
            if not more:
                raise ValueError("the central directory ends early")
            held, at = held + more, at + len(more)
        if held[:4] != b"PK\1\2":
            raise ValueError("no central directory entry where one is due")
        flags, method = struct.unpack_from("<2H", held, 8)
        stored, plain = struct.unpack_from("<2L", held, 20)
        n, x, c = struct.unpack_from("<3H", held, 28)
        header = struct.unpack_from("<L", held, 42)[0]
        name = held[46 : 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        if flags & 1:
            raise ValueError(f"{name} is encrypted")
        extra, i = held[46 + n : 46 + n + x], 0
        while i + 4 <= len(extra):
            kind, m = struct.unpack_from("<2H", extra, i)
            if kind == 1:  # ZIP64: the values that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, i + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            i += 4 + m
        held = held[46 + n + x + c :]
        yield name, method, header + shift, stored, plain


def data_place(read: Read, header: int) -> int:
    """Where a member's bytes begin, behind its local header."""
    local = read(header, 30)
    if local[:4] != b"PK\3\4":
        raise ValueError(f"no local header at {header}")
    return header + 30 + sum(struct.unpack_from("<2H", local, 26))


def blocks_of(read: Read, at: int, size: int, method: int) -> Iterator[bytes]:
    """A member's bytes in blocks, inflated if need be."""
    z = zlib.decompressobj(-15) if method == DEFLATED else None
    for i in range(at, at + size, BLOCK):
        data = read(i, min(BLOCK, at + size - i))
        while data:
            yield z.decompress(data, BLOCK) if z else data
            data = z.unconsumed_tail if z else b""


def gunzipped(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Gzip members one after another, as a stream; a mark (empty bytes) ends each."""
    z = zlib.decompressobj(31)
    for data in blocks:
        while data:
            out = z.decompress(data, BLOCK)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
                yield b""


def lines_of(blocks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for data in blocks:
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    yield rest


def fields_of(record: bytes) -> tuple[dict[str, str], int]:
    """A record's fields by lower-case name, and where its block begins."""
    end = record.find(b"\r\n\r\n")
    first, *lines = record[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}, end + 4


FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "url": "warc-target-uri", "date": "warc-date", "source": "warc-source-id", "declared_digest": "warc-payload-digest"}
RECORD = "package string, place long, type string, record_id string, refers_to string, url string, date string, source string, declared_digest string, http_length long, payload binary"


def parsed(record: bytes) -> tuple:
    """RECORD's columns from type on.  The payload of HTTP is what follows its head; a revisit has none."""
    fields, at = fields_of(record)
    block = record[at : at + int(fields.get("content-length", 0))]
    payload, length = block, None
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
    told = {k: fields.get(v) for k, v in FIELDS.items()}
    for k in ("url", "source"):
        told[k] = None if told[k] is None else unquote(told[k])
    return (*told.values(), length, None if told["type"] == "revisit" else payload)


def records_in_order(blocks: Iterator[bytes], is_gzip: bool) -> Iterator[bytes]:
    """The records of an archive read from its start, one held at a time."""
    if is_gzip:
        held: list[bytes] = []
        for data in gunzipped(blocks):
            held.append(data)
            if not data:
                yield b"".join(held)
                held = []
        return
    rest, blocks = b"", iter(blocks)
    while True:
        while True:
            end = rest.find(b"\r\n\r\n")
            need = None
            if end >= 0:
                fields, at = fields_of(rest)
                need = at + int(fields.get("content-length", 0)) + 4
                if len(rest) >= need:
                    break
            more = next(blocks, None)
            if more is None:
                if rest.strip():
                    raise ValueError("an archive ends within a record")
                return
            parts = [rest, more]
            while need is not None and sum(map(len, parts)) < need and (more := next(blocks, None)) is not None:
                parts.append(more)
            rest = b"".join(parts)
        yield rest[:need]
        rest = rest[need:]


class Reader:
    """Range reads of one file after another."""

    def __init__(self):
        self.path = self.file = None

    def open(self, path: str) -> tuple[Read, int]:
        if path != self.path:
            system, at = fs.FileSystem.from_uri(path)
            self.path, self.file = path, system.open_input_file(at)
        return lambda place, n: self.file.read_at(n, place), self.file.size()


RUN = "package string, place long, size long, method int, gzip boolean, lengths array<long>"


def _runs_of(read: Read, size: int) -> Iterator[tuple]:
    """(place, size, method, gzip, lengths) of runs: neighbouring records of an archive by its
    index; an archive without one whole, with no lengths."""
    archives, indexes = {}, []
    for name, method, header, stored, _ in directory(read, size):
        if name.startswith("archive/") and name.endswith((".warc", ".warc.gz")):
            archives[name.removeprefix("archive/")] = (data_place(read, header), stored, method, name.endswith(".gz"))
        elif name.startswith("indexes/") and name.endswith((".cdxj", ".cdxj.gz")):
            indexes.append((name, data_place(read, header), stored, method))
    named = set()

    def runs(found: list[tuple[str, int, int]]) -> Iterator[tuple]:
        found.sort()
        start, lengths = None, []
        for file, offset, n in [*found, (None, 0, 0)]:
            if start and (file != start[0] or offset != start[1] + sum(lengths) or sum(lengths) + n > RUN_BYTES):
                yield archives[start[0]][0] + start[1], sum(lengths), STORED, archives[start[0]][3], lengths
                start = None
            if start is None:
                start, lengths = (file, offset), []
            lengths.append(n)

    for name, at, stored, method in indexes:
        blocks = blocks_of(read, at, stored, method)
        found = []
        for line in lines_of(gunzipped(blocks) if name.endswith(".gz") else blocks):
            if not line.strip():
                continue
            facts = json.loads(line[line.index(b"{") :])
            file = facts["filename"].split("/")[-1]
            if file in archives and archives[file][2] == STORED:
                named.add(file)
                found.append((file, int(facts["offset"]), int(facts["length"])))
            if len(found) >= LINES:
                yield from runs(found)
                found = []
        yield from runs(found)
    yield from ((at, stored, method, is_gzip, None) for file, (at, stored, method, is_gzip) in archives.items() if file not in named)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = Reader()
    for b in batches:
        for path in b["package"]:
            rows = []
            try:
                for run in _runs_of(*reader.open(path)):
                    rows.append((path, *run))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["package", "place", "size", "method", "gzip", "lengths"])
                        rows = []
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from e
            yield pd.DataFrame(rows, columns=["package", "place", "size", "method", "gzip", "lengths"])


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader, names = Reader(), [c.split()[0] for c in RECORD.split(", ")]
    for b in batches:
        for r in b.itertuples(index=False):
            read, _ = reader.open(r.package)
            rows, held = [], 0
            if r.lengths is None:
                found = ((r.place, record) for record in records_in_order(blocks_of(read, r.place, r.size, r.method), r.gzip))
            else:
                data, ends = read(r.place, r.size), [0]
                for n in r.lengths:
                    ends.append(ends[-1] + int(n))
                found = ((r.place + a, zlib.decompress(data[a:z], 31) if r.gzip else data[a:z]) for a, z in zip(ends, ends[1:]))
            for place, record in found:
                try:
                    rows.append((r.package, place, *parsed(record)))
                except ValueError as e:
                    raise ValueError(f"{r.package} at {place}: {e}") from e
                held += len(record)
                if held > RUN_BYTES:
                    yield pd.DataFrame(rows, columns=names).astype({"http_length": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names).astype({"http_length": "Int64"})


def read_packages(packages: DataFrame) -> DataFrame:
    """The WARC records of packages, given as rows with a column ``package`` (addresses):
    package, place, type, record_id, refers_to, url, date, source, declared_digest,
    http_length, payload (null for revisits)."""
    small_batches(packages.sparkSession)
    # A number is given, as rows are small here and what they stand for is not: tasks must not be merged.
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = packages.select("package").repartition(n, "package").mapInPandas(_runs, RUN)
    return runs.repartition(n, "package", "place").mapInPandas(_records, RECORD)


def digests(records: DataFrame) -> DataFrame:
    """One row for each response and revisit: source, payload_bytes and payload_digest of
    the full payload (of the record referred to, for a revisit), record_type, refers_to (that record's source)."""
    told = records.filter(F.col("type").isin("response", "revisit")).select("source", "type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("size"), base32(F.sha1("payload")).alias("digest"))
    rows = settle(told, "records")
    revisits = rows.filter("type = 'revisit'").select("source", "refers_to")
    asked = revisits.groupBy(F.col("refers_to").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    full = rows.filter("type = 'response'")
    known = full.select("record_id", F.col("source").alias("first"), "size", "digest").join(asked, F.col("record_id") == F.col("r"))
    found = attach(revisits, known, F.col("refers_to") == F.col("record_id"), F.col("n") * HOT > revisits.count())
    out = lambda t, kind, first: t.select("source", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(kind).alias("record_type"), first.alias("refers_to"))
    return out(full, "response", F.lit(None).cast("string")).union(out(found, "revisit", F.col("first")))
