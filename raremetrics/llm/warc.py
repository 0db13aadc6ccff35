"""WARC records in ZIP packages: a writer, and a reader by byte ranges.

A package is a ZIP file with two stored (not compressed) members: ``archive/data.warc.gz``,
whose records are gzip members of their own, and ``indexes/index.cdxj``, one line with
the record's place for each record.  Packages are written as a stream, with a ZIP64
directory, and named anew by every attempt; the manifest names those that count.

The reader finds the central directory from the file's tail (through the ZIP64 locator
where there is one), the members' data from their local headers, and then reads the
index and single records by ranges.  Nothing is extracted, and no step holds more than
a directory, an index or a run of records of ``RUN_BYTES`` (or one longer record).

Defined cases: a null html is an empty payload; a null url an empty target; repeated
rows get a record each; records whose page_id is the smallest of their payload are
responses, also when that row repeats; a null page_id never is the smallest; an empty
table gives no package and an empty result; extra columns are not written.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common

REVISIT_BYTES = 100
PACKAGE_BYTES = 256 << 20
RUN_BYTES = 1 << 20
STRETCH_BYTES = 16 << 20  # of a package, read in order by one task
TASK_BYTES = 128 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_TAIL = 65_557  # end record with the longest comment


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; the names that Hadoop gives to S3 become Arrow's."""
    for hadoop in ("s3a://", "s3n://"):
        if path.startswith(hadoop):
            path = "s3://" + path.removeprefix(hadoop)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PackageWriter:
    """A ZIP file of stored members, written front to back."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc = name.encode(), self.at, 0
        # sizes and checksum follow the data (bit 3)
        self._write(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 8, 0, 0, 33, 0, 0, 0, len(self.name), 0) + self.name)
        self.start = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._write(data)

    def end(self) -> None:
        size = self.at - self.start
        self._write(struct.pack("<4sI2Q" if self.zip64 else "<4sI2I", b"PK\7\x08", self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.header))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, header in self.members:
            extra = struct.pack("<2H3Q", 1, 24, size, size, header) if self.zip64 else b""
            shown = (0xFFFFFFFF,) * 3 if self.zip64 else (size, size, header)
            self._write(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 8, 0, 0, 33, crc, shown[0], shown[1],
                                    len(name), len(extra), 0, 0, 0, 0, shown[2]) + name + extra)
        size, count = self.at - begin, len(self.members)
        if self.zip64:
            where = self.at
            self._write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, begin))
            self._write(struct.pack("<4sIQI", b"PK\6\7", 0, where, 1))
            count, size, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, count, count, size, begin, 0))


def directory(read, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, data offset, size) of a ZIP file's members; ``read(offset, length)`` gives bytes."""
    low = max(0, size - _TAIL)
    tail = read(low, size - low)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, begin = struct.unpack_from("<H2I", tail, at + 10)
    locator = low + at - 20
    if locator >= 0 and (found := read(locator, 20))[:4] == b"PK\6\7":
        where = struct.unpack_from("<Q", found, 8)[0]
        count, length, begin = struct.unpack_from("<3Q", read(where, 56), 32)
    central, out, at = read(begin, length), [], 0
    for _ in range(count):
        if central[at:at + 4] != b"PK\1\2":
            raise ValueError("bad central directory entry")
        method = struct.unpack_from("<H", central, at + 10)[0]
        packed, plain, n, m, k = struct.unpack_from("<2I3H", central, at + 20)
        header = struct.unpack_from("<I", central, at + 42)[0]
        name = central[at + 46:at + 46 + n].decode()
        extra, pos = central[at + 46 + n:at + 46 + n + m], 0
        while pos + 4 <= len(extra):
            kind, width = struct.unpack_from("<2H", extra, pos)
            if kind == 1:  # 64-bit values, those alone whose place holds all ones
                values = list(struct.unpack_from(f"<{width // 8}Q", extra, pos + 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            pos += 4 + width
        name_length, extra_length = struct.unpack_from("<2H", read(header, 30), 26)
        out.append((name, method, header + 30 + name_length + extra_length, packed))
        at += 46 + n + m + k
    return out


def record(row: dict) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{_name(row['page_id'])}>",
            "WARC-Target-URI: " + " ".join((row["url"] or "").split()), "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha256:{row['payload_digest']}"]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_name(row['refers_to'])}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _number(name: str) -> int | None:
    return None if name == "none" else int(name)


def parse(raw: bytes) -> dict:
    """A record's page, target, type and payload; the digest of a response is computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": _number(fields["WARC-Record-ID"][len("<urn:page:"):-1]), "url": fields.get("WARC-Target-URI", ""),
            "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": _number(fields["WARC-Refers-To"][len("<urn:page:"):-1]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


def with_revisits(pages: DataFrame) -> DataFrame:
    """Payload, digest, type and reference of each page's record.

    The first pages of repeated payloads are found from ids and digests alone and written;
    against that table, not an aggregate, the adaptive join can split a payload that very
    many pages share.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(common.materialise(first, "warc-first"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload_bytes", "payload_digest",
                       F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.when(again, F.col("first")).alias("refers_to"),
                       F.when(~again, F.col("payload")).alias("payload"))


def write_packages(rows: DataFrame, folder: str, zip64: bool = True) -> DataFrame:
    """Write the records below ``folder``; the manifest (package, records, size) as a written table."""

    def run(batches):
        system, base = _open(folder)
        writer = out = None

        def finish():
            writer.end()
            writer.begin(INDEX)
            for line in lines:
                writer.write(line)
            writer.end()
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"package": f"{folder}/{name}", "records": len(lines), "bytes": writer.at}])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if writer is None:
                    system.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
                    out = system.open_output_stream(f"{base}/{name}")
                    writer, lines = PackageWriter(out, zip64), []
                    writer.begin(DATA)
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = deflate.compress(record(row)) + deflate.flush()
                place = {"offset": writer.at - writer.start, "length": len(data), "digest": f"sha256:{row['payload_digest']}"}
                lines.append(f"urn:page:{_name(row['page_id'])} 19700101000000 {json.dumps(place)}\n".encode())
                writer.write(data)
                if writer.at >= PACKAGE_BYTES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return common.materialise(rows.transform(common.in_tasks, run, "package string, records long, bytes long"), "warc-manifest")


def members(packages: DataFrame) -> DataFrame:
    """(package, member, method, offset, size) from the central directories."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, local = _open(path)
                with system.open_input_file(local) as f:
                    found = directory(lambda at, n: f.read_at(n, at), f.size())
                yield pa.RecordBatch.from_pylist([dict(zip(("member", "method", "offset", "size"), m, strict=True)) | {"package": path}
                                                  for m in found], schema=schema)

    schema = pa.schema([("package", pa.string()), ("member", pa.string()), ("method", pa.int32()), ("offset", pa.int64()), ("size", pa.int64())])
    return packages.select("package").transform(common.in_tasks, run, "package string, member string, method int, offset long, size long")


def record_places(found: DataFrame) -> DataFrame:
    """(package, offset, length) of every record, from the stored indexes; offsets are those in the package."""
    stored = found.filter(F.col("method") == 0)
    index = stored.filter(F.col("member").startswith("indexes/")).select("package", "offset", "size")
    data = stored.filter(F.col("member") == DATA).select("package", F.col("offset").alias("base"))
    both = index.join(data, "package")  # a row for each package

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, local = _open(row["package"])
                with system.open_input_file(local) as f:
                    at, rest = row["offset"], b""
                    while at < row["offset"] + row["size"]:
                        n = min(RUN_BYTES, row["offset"] + row["size"] - at)
                        *lines, rest = (rest + f.read_at(n, at)).split(b"\n")
                        at += n
                        places = [json.loads(x[x.index(b"{"):]) for x in lines]
                        yield pa.RecordBatch.from_arrays([pa.array([row["package"]] * len(places), pa.string()),
                                                          pa.array([row["base"] + p["offset"] for p in places], pa.int64()),
                                                          pa.array([p["length"] for p in places], pa.int64())], names=["package", "offset", "length"])

    return both.transform(common.in_tasks, run, "package string, offset long, length long")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_tasks(manifest: DataFrame) -> int:
    """Tasks for reading the packages: one per ``TASK_BYTES``, from the sizes in the manifest."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def read_records(places: DataFrame, payload: bool = True, tasks: int | None = None) -> DataFrame:
    """The records at the given places, read in runs of neighbours.

    A place is a few bytes and stands for a record, so without ``tasks`` adaptive execution
    would put the places of many packages into one task.
    """
    # rows of one stretch of a package go together, in order
    keys = ["package", F.floor(F.col("offset") / STRETCH_BYTES)]
    runs = places.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions("package", "offset")
    fields = [f for f in RECORD.split(", ") if payload or not f.startswith("payload binary")]
    names = [f.split()[0] for f in fields]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields])

    def run(batches):
        path = f = None
        for batch in batches:
            packages = batch.column(0).to_pylist()
            offset, length = (batch.column(i).to_numpy() for i in (1, 2))
            k = 0
            while k < len(packages):
                end = k + 1
                while (end < len(packages) and packages[end] == packages[k] and offset[end] == offset[end - 1] + length[end - 1]
                       and offset[end] + length[end] - offset[k] <= RUN_BYTES):
                    end += 1
                if packages[k] != path:
                    if f:
                        f.close()
                    path = packages[k]
                    system, local = _open(path)
                    f = system.open_input_file(local)
                raw = f.read_at(int(offset[end - 1] + length[end - 1] - offset[k]), int(offset[k]))
                found = [parse(zlib.decompress(raw[a:b], 31)) for a, b in zip((offset[k:end] - offset[k]).tolist(),
                                                                          (offset[k:end] + length[k:end] - offset[k]).tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in found], schema=schema)
                k = end
        if f:
            f.close()

    return runs.transform(common.in_tasks, run, ", ".join(fields))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_packages(with_revisits(pages), common.shared_path(spark, "warc"))
    return read_records(record_places(members(manifest)), payload=False, tasks=read_tasks(manifest))


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, u.url, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p JOIN pages u USING (page_id) LEFT JOIN f USING (payload_digest)
"""
