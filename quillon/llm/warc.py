"""WARC archives: deterministic sharded writing, committed through temporary names and a manifest, and reading back.

The archive of a table depends on its rows alone, not on how they are
partitioned or which task ran twice: records are in the order of (key, SHA-256
of the payload, URI), the order is cut into shards of equal bytes, a shard
rolls to its next file once that has `roll` compressed bytes, and headers and
digests are made anew. Every record is a gzip member without a time.

A task writes under names of its own attempt in a temporary folder. What the
attempts that count have written is a table; its files are renamed, and the
rename of that table to `_manifest` commits the archive. Readers open the
files of the manifest only, so a lost executor, a task run twice or a writer
that dies leaves nothing that is read.

Of records with equal payloads (SHA-256) of `least` bytes or more, that with
the largest key is a response and the others are revisits that refer to it;
smaller ones are all responses. A null key is less than any other and comes
back as null, a null URI is left out, a null payload is empty. Control
characters and spaces of a URI are percent-encoded. Among rows with equal key
and payload the one with the least URI counts as the largest; each gets a
record identifier of its own. An empty table makes an archive without files.
Other columns are ignored.
"""

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._order import running
from quillon.llm._store import scratch, shuffles, spread_join, written

#: Shards are cut to SHARD payload bytes, but into SHARDS at least; a file rolls at ROLL compressed bytes.
SHARD, SHARDS, ROLL = 1 << 30, 64, 128 << 20
#: Bytes of a record beside its payload, as counted for the cuts.
HEAD = 512
LEVEL = 6
#: Bytes that are read, or gathered in a batch of rows, at once.
PIECE = 1 << 22
FILES = "shard int, name string, temp string, bytes long, records long, first_key long, last_key long, sha256 string"
RECORDS = "key long, uri string, record_type string, record_id string, refers_to_id string, refers_to long, date string, payload_bytes long, payload_digest string, intact boolean"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: int | None, digest: bytes, nth: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'%s/%s/%d' % (str(key).encode(), digest, nth)).digest()[:16], version=5)}>"


def _uri(uri: str | None) -> str | None:
    return None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + b"Content-Length: %d\r\n\r\n" % len(block)) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _entry(key: int | None, digest: bytes, uri: str | None, payload: bytes, nth: int, refers: tuple | None, date: str) -> bytes:
    """A response, or a revisit of the record that refers = (key, URI) names."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", _record_id(key, digest, nth)), ("WARC-Date", date), ("WARC-Target-URI", _uri(uri)),
        ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Record-Key", key),
    ]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers[0], digest, 0))]
        fields += [("WARC-Refers-To-Target-URI", _uri(refers[1])), ("WARC-Refers-To-Date", date), ("Refers-To-Key", refers[0])]
    return _member(fields, block)


class _Files:
    """The files of one task: rolled by size, counted and hashed as they are written."""

    def __init__(self, temp: str, roll: int, date: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(temp)
        self.temp, self.roll, self.date, self.attempt = temp, roll, date, uuid.uuid4().hex
        self.shard, self.nth, self.out = -1, 0, None

    def add(self, shard: int, key: int | None, member: bytes) -> Iterator[tuple]:
        if self.out and (shard != self.shard or self.size >= self.roll):
            yield self.close()
        if shard != self.shard:
            self.shard, self.nth = shard, 0
        if not self.out:
            self.name = f"part-{shard:06d}-{self.nth:05d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}.{self.attempt}", compression=None)
            self.size, self.records, self.first, self.hash = 0, 0, key, hashlib.sha256()
            info = f"software: quillon\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(shard, b"info", self.nth)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self.write(_member(head, info))
        self.write(member)
        self.records, self.last = self.records + 1, key

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.out.close()
        self.out, self.nth = None, self.nth + 1
        return self.shard, self.name, f"{self.name}.{self.attempt}", self.size, self.records, self.first, self.last, self.hash.hexdigest()


def _names(spec: str) -> list[str]:
    return [x.split()[0] for x in spec.split(", ")]


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(spec.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, spec.split(", "), strict=True)], names=_names(spec))


def _writer(temp: str, roll: int, date: str):
    """A mapInArrow step over rows by shard, key, digest, mark: a mark's row says to whom the rows after it refer."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, run, nth, refers = _Files(temp, roll, date), None, 0, None
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(n) for n in ("shard", "key", "digest", "mark", "uri", "payload", "to_key")]
            for i in range(batch.num_rows):
                shard, key, digest, mark, uri, payload, to_key = (c[i].as_py() for c in columns)
                if (key, digest) != run:
                    run, nth, refers = (key, digest), 0, None
                if not mark:
                    refers = (to_key, uri)
                    continue
                own = refers is not None and refers[0] == key and nth == 0
                done += files.add(shard, key, _entry(key, digest, uri, payload, nth, None if own else refers, date))
                nth += 1
            if done:
                yield _batch(done, FILES)
                done = []
        if files.out:
            yield _batch([files.close()], FILES)

    return step


def _renamer(temp: str, folder: str):
    """A mapInArrow step that gives files their names; a task that runs again finds them done."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, source), target = pafs.FileSystem.from_uri(temp), pafs.FileSystem.from_uri(folder)[1]
        for batch in batches:
            for r in batch.to_pylist():
                old, new = f"{source}/{r['temp']}", f"{target}/{r['name']}"
                if fs.get_file_info(old).type != pafs.FileType.NotFound:
                    fs.move(old, new)
                if fs.get_file_info(new).size != r["bytes"]:
                    raise OSError(f"{new} has not the size that was written")
            yield batch.select(["bytes"])

    return step


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 1000, roll: int = ROLL, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record a row to the archive in folder (a URI that all executors reach) and return its manifest, a row a file.

    Payload bytes are shuffled once, to their shards; what is revisited is
    decided on (key, digest, size) alone and comes to the shards as marks that
    sort before the rows they hold for. Writers stream. A folder that has a
    manifest is left as it is and FileExistsError raised.
    """
    spark = pages.sparkSession
    fs, manifest = _hadoop(spark, f"{folder}/_manifest")
    if fs.exists(manifest):
        raise FileExistsError(f"{folder} holds an archive")
    temp = f"{folder}/.tmp-{uuid.uuid4().hex}"
    fs.mkdirs(_hadoop(spark, temp)[1])
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.unhex(F.sha2(data, 256)).alias("digest"), F.col(uri).cast("string").alias("uri"), data.alias("payload"))
    with scratch():
        narrow = running(rows.select("key", "digest", "uri", F.octet_length("payload").cast("long").alias("size"), (F.octet_length("payload").cast("long") + HEAD).alias("weight")), None, ["key", "digest", "uri"], {"before": "weight"})
        narrow = written(narrow)
        total = narrow.agg(F.sum("weight")).first()[0] or 0
        shards = max(SHARDS, -(-total // SHARD))
        width = max(1, -(-total // shards))
        first = narrow.groupBy(F.expr(f"before div {width}").alias("shard")).agg(F.min(F.struct("key", "digest")).alias("k")).orderBy("shard").collect()
        cuts = [(r["k"]["key"] is not None, r["k"]["key"] or 0, bytes(r["k"]["digest"])) for r in first[1:]]

        @F.arrow_udf("int")
        def shard(keys: pa.Array, digests: pa.Array) -> pa.Array:
            return pa.array([bisect_right(cuts, (k is not None, k or 0, d)) for k, d in zip(keys.to_pylist(), digests.to_pylist(), strict=True)], pa.int32())

        pairs = narrow.where(F.col("size") >= least).groupBy("digest", "key").agg(F.count(F.lit(1)).alias("rows"), F.min("uri").alias("uri"))
        groups = pairs.groupBy("digest").agg(F.sum("rows").alias("n"), F.max(F.struct("key", "uri")).alias("top")).where("n > 1")
        marks = spread_join(pairs, written(groups), "digest", "n").where("rows > 1 or not key <=> top.key")
        marks = marks.select("key", "digest", F.lit(0).alias("mark"), F.col("top.uri").alias("uri"), F.lit(None).cast("binary").alias("payload"), F.col("top.key").alias("to_key"))
        everything = rows.select("key", "digest", F.lit(1).alias("mark"), "uri", "payload", F.lit(None).cast("long").alias("to_key")).union(marks)
        dealt = everything.withColumn("shard", shard("key", "digest")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "digest", "mark", "uri")
        dealt.mapInArrow(_writer(temp, roll, date), FILES).write.parquet(f"{temp}/manifest")
    files = spark.read.schema(FILES).parquet(f"{temp}/manifest")
    files.repartition(shuffles(spark)).mapInArrow(_renamer(temp, folder), "bytes long").agg(F.sum("bytes")).collect()
    if not fs.rename(_hadoop(spark, f"{temp}/manifest")[1], manifest):
        raise OSError(f"{folder} could not be committed")
    fs.delete(_hadoop(spark, temp)[1], True)
    return archive_files(spark, folder)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: a row a file, without temporary names."""
    return spark.read.schema(FILES).parquet(f"{folder}/_manifest").drop("temp")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(PIECE)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        data = data or stream.read(PIECE)
    if parts:
        raise EOFError("the last record is not complete")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _parsed(member: bytes) -> tuple | None:
    """The record of a member as a row of RECORDS and its payload; None for warcinfo."""
    head, _, rest = member.partition(b"\r\n\r\n")
    f = _fields(head)
    if f["warc-type"] == "warcinfo":
        return None
    block = rest[: int(f["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size, revisit = int(_fields(http)["content-length"]), f["warc-type"] == "revisit"
    digest, number = _hex(f["warc-payload-digest"]), lambda k: int(f[k]) if k in f else None
    intact = _digest(block) == f["warc-block-digest"] and rest[len(block) :] == b"\r\n\r\n" and (revisit or len(body) == size and hashlib.sha1(body).hexdigest() == digest)
    row = number("record-key"), f.get("warc-target-uri"), f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"), number("refers-to-key"), f["warc-date"], size, digest, intact
    return *row, None if revisit else body


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of an archive's committed files, streamed: key, uri, record_type, identifiers, digests, intact (all digests and lengths agree), and payload unless it is not wanted (null for revisits)."""
    spec = RECORDS + ", payload binary" * payload
    width = len(_names(spec))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in filter(None, map(_parsed, _members(stream))):
                        rows.append(row[:width])
                        size += HEAD + payload * len(row[-1] or b"")
                        if size >= PIECE:
                            yield _batch(rows, spec)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, spec)

    files = archive_files(spark, folder)
    count = files.count()
    return files.select("name").repartition(max(1, min(count, 64 * shuffles(spark)))).mapInArrow(step, spec)
