"""Operator 12, WARC archives: a deterministic sharded writer and the reader that checks them.

Writing. Only narrow facts (page_id, digest, length) are grouped to tell which record carries a payload: among equal payloads of
at least ``least`` bytes the one of the smallest page_id is a response, the others revisit it. Places in the order of
(page_id, digest), two-level prefix sums over the bytes to write, cut the records into shards; the shards' first keys, at
most ``MOST_SHARDS``, deal the pages, so shards follow from the rows alone and not from cores, samples or attempts. The one
wide shuffle brings each shard's pages and facts together in order; a task streams them, one record in memory, and starts a
new file once the compressed bytes reach ``file_bytes``. Record ids, dates and digests are computed from the content, so a
rewrite gives the same bytes.

Committing. A task writes under a temporary name of its own attempt and reports file, size, SHA-256 and records. Those
reports, written as a table, name the files of successful attempts only; a second pass renames these and writes the manifest.
An archive is what its manifest lists: a lost executor leaves temporary files, which are deleted, and nothing else.

Reading takes the files of the manifest, spread over tasks, and checks length, SHA-256 and records of each file and the block and
payload digests of each record.

Cases: null html is an empty payload; short payloads are responses each; a repeated row (equal page_id and payload) revisits the
first of them; a null page_id stands last and is never the first of its group, unless the group is that one row, whose repeats
then refer to null; a null url leaves out the target; other characters than printable ASCII in a url are percent-encoded;
other columns are not read, so their names cannot clash; an empty table gives a manifest without files. Equal rows of one
page_id and payload stand in one shard; equal payloads of different pages do not.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewise.llm.common import stage
from gaugewise.llm.ordered import placed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 100
SHARD_BYTES = 32 << 20
MOST_SHARDS = 16_384
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
HEAD_BYTES = 600
FILES = "name string, part string, bytes long, sha256 string, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def facts(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per (page_id, payload): its ``digest``, ``bytes``, ``copies`` and the ``first`` page of its payload."""
    rows = stage(pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", F.unhex(F.sha2("html", 256)).alias("digest"), F.octet_length("html").cast("long").alias("bytes")).groupBy(
        "page_id", "digest", "bytes").agg(F.count("*").alias("copies")), "warc-facts")
    groups = stage(rows.filter(F.col("bytes") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "warc-groups")
    # A payload that very many pages share meets them by broadcast; there can be at most 1,000 of these.
    hot = F.col("rows") > F.greatest(F.lit(10_000), F.lit(rows.count() / 1_000))
    common, rare = F.broadcast(groups.filter(hot).drop("rows")), groups.filter(~hot).drop("rows")
    rest = rows.join(common, "digest", "left_anti").join(rare, "digest", "left")
    return rest.unionByName(rows.join(common, "digest")).withColumn("first", F.coalesce("first", "page_id"))


def record_id(page_id: int | None, digest: bytes, copy: int) -> str:
    name = hashlib.sha256(f"{page_id} {digest.hex()} {copy}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as one gzip member without time or name, so equal records are equal bytes."""
    lines = [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, copy: int, refers: bool,
                first: int | None) -> bytes:
    """A response, or a revisit of ``first`` that carries the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)),
               ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest.hex()}"),
               ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=PRINTABLE)))
    if page_id is not None:
        headers.append(("X-Page-ID", page_id))
    if refers:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(first, digest, 0))]
        if first is not None:
            headers.append(("X-Refers-To-Page-ID", first))
    return _member(headers, http if refers else http + payload)


class _Files:
    """The files of one shard, under temporary names, each closed once its compressed bytes reach the limit."""

    def __init__(self, folder: str, shard: int, limit: int) -> None:
        (self.fs, self.folder), self.shard, self.limit = place(folder), shard, limit
        self.done: list[dict] = []
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0
            block = b"software: gaugewise\r\nformat: WARC File Format 1.1\r\n"
            self._write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name.encode(), 0)),
                                 ("WARC-Date", DATE), ("WARC-Filename", self.name),
                                 ("Content-Type", "application/warc-fields")], block))
        self._write(member)
        self.records += 1
        if self.bytes >= self.limit:
            self.close()

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"name": self.name, "part": self.temporary, "bytes": self.bytes,
                              "sha256": self.sha.hexdigest(), "records": self.records})
            self.out = None


def _writer(folder: str, least: int, file_bytes: int):
    """Rows of shards in order: before its pages, each (page_id, digest) has a row of facts with the first page's id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, copy, first = None, 0, None
        for batch in batches:
            for shard, page_id, digest, of, url, html in zip(*(batch[c].to_pylist() for c in (
                    "shard", "page_id", "digest", "first", "url", "html"))):
                if html is None:
                    copy, first = 0, of
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield _reports(files.done)
                    files = _Files(folder, shard, file_bytes)
                refers = len(html) >= least and (copy > 0 or first != page_id)
                files.add(page_record(page_id, url, html, digest, copy, refers, first))
                copy += 1
        if files is not None:
            files.close()
            yield _reports(files.done)
    return run


def _reports(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("part", pa.string()), ("bytes", pa.int64()),
                                                       ("sha256", pa.string()), ("records", pa.int64())]))


def _named(folder: str):
    """Temporary names become final ones; a second attempt finds that done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{path}/{row['part']}").type == fs.FileType.File:
                    store.move(f"{path}/{row['part']}", f"{path}/{row['name']}")
                elif store.get_file_info(f"{path}/{row['name']}").size != row["bytes"]:
                    raise OSError(f"{row['name']} is neither under its temporary nor under its final name")
            yield batch
    return run


def write(pages: DataFrame, folder: str, least: int = LEAST, shard_bytes: int = SHARD_BYTES,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into a new folder and returns the manifest: name, bytes, sha256 and records of
    each file."""
    spark = pages.sparkSession
    amount = F.col("bytes") * F.when((F.col("bytes") < least), F.col("copies")).when(F.col("first").eqNullSafe(
        F.col("page_id")), 1).otherwise(0) + F.col("copies") * HEAD_BYTES
    order = [F.col("page_id").asc_nulls_last(), F.col("digest")]
    narrow = stage(placed(facts(pages, least), order, amount, "warc-ranges").select(
        "page_id", "digest", "first", "place"), "warc-places")
    last = narrow.agg(F.max("place")).first()[0] or 0
    size = max(shard_bytes, -(-(last + 1) // MOST_SHARDS))
    narrow = narrow.withColumn("shard", F.floor(F.col("place") / size).cast("int"))
    key = F.struct(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), "digest")
    firsts = sorted((tuple(r[1]), r[0]) for r in narrow.groupBy("shard").agg(F.min(key)).collect())
    bounds, shards = [(a, b, bytes(c)) for (a, b, c), _ in firsts], [shard for _, shard in firsts]

    @F.arrow_udf("int")
    def shard_of(absent: pa.Array, page_id: pa.Array, digest: pa.Array) -> pa.Array:
        keys = zip(*(column.to_pylist() for column in (absent, page_id, digest)))
        return pa.array([shards[bisect_right(bounds, k) - 1] for k in keys], pa.int32())

    wide = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn(
        "digest", F.unhex(F.sha2("html", 256)))
    wide = wide.withColumn("shard", shard_of(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), "digest"))
    rows = wide.unionByName(narrow.drop("place"), allowMissingColumns=True)
    # Facts have no html and stand before the pages they are about.
    rows = rows.repartitionById(len(shards) or 1, F.col("shard")).sortWithinPartitions(
        "shard", *order, F.col("html").isNotNull(), "url")
    columns = ("shard", "page_id", "digest", "first", "url", "html")
    rows.select(*columns).mapInArrow(_writer(folder, least, file_bytes), FILES).write.json(f"{folder}/_pending")
    pending = spark.read.schema(FILES).json(f"{folder}/_pending")
    pending.mapInArrow(_named(folder), FILES).drop("part").write.json(f"{folder}/manifest")
    store, path = place(folder)
    for name in ("_temporary", "_pending"):
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{name}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name string, bytes long, sha256 string, records long").json(f"{folder}/manifest")


def _members(source, sha) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    inflate, out = zlib.decompressobj(31), []
    while block := source.read(1 << 20):
        sha.update(block)
        while block:
            out.append(inflate.decompress(block))
            block = inflate.unused_data
            if inflate.eof:
                yield b"".join(out)
                inflate, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the file ends within a record")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record whose length and block digest hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:-4]
    if version != "WARC/1.1" or rest[-4:] != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]):
        raise ValueError("a record is broken")
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a block differs from its digest")
    return headers, block


def _reader(folder: str, payloads: bool, schema: pa.Schema):
    def row(headers: dict[str, str], block: bytes) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.decode().rsplit("Content-Length: ", 1)[1])
        digest, response = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "response"
        if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("a payload differs from its digest")
        page_id, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
        return {"page_id": page_id and int(page_id), "url": headers.get("WARC-Target-URI"), "payload_bytes": length,
                "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": refers and int(refers)} | (
                    {"payload": payload if response else None} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for file in batch.to_pylist():
                sha, found, rows, held = hashlib.sha256(), 0, [], 0
                with store.open_input_stream(f"{path}/{file['name']}", compression=None) as source:
                    for record in _members(source, sha):
                        headers, block = parsed(record)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        found, held = found + 1, held + len(block)
                        rows.append(row(headers, block))
                        if len(rows) == 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if (sha.hexdigest(), found) != (file["sha256"], file["records"]):
                    raise ValueError(f"{file['name']} differs from the manifest")
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of an archive: page_id, url, payload_bytes and payload_digest of the full payload, record_type,
    refers_to (a page_id), and the payload itself (null in revisits) where asked for."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), (
        "payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *(
        [("payload", pa.binary())] if payloads else [])])
    files = manifest(spark, folder)
    files = files.repartition(min(max(files.count(), 1), MOST_SHARDS), "name")
    return files.mapInArrow(_reader(folder, payloads, schema), RECORDS + (", payload binary" if payloads else ""))
