"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive file (.warc.zst) starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one
Zstandard frame for each record, so that any record can be read on its own. The dictionary is trained on whole records of a
bounded sample of the pages (TRAIN_ROWS pages by smallest hash of the id, TRAIN_BYTES of them in all); it only affects the
compressed size.

Pages with equal payloads (of min_bytes or more) are one response, that of the largest page_id, and revisits that refer
to it. The groups are found by digests alone, with partial maxima before the shuffle. A Bloom filter of the payloads that occur
more than once then parts the pages: those it does not hold are written where they are read, and only the others go through the
join that brings the response's id to them. That has one row for each digest on one side, so Spark can split a hot payload.

A task writes its files under a name of its own attempt, in the shared folder, renames each when it is whole, and returns
the names; the table of names is written by Spark's committer, so files of lost attempts are never read.

Defined cases: a null html is an empty payload; pages with equal ids and payloads are all responses if theirs is the largest
id; a null page_id ranks below all others and stays null; an empty table gives no file and no rows; further columns are ignored.
A record is built whole, in memory of a few times its payload; batches hold about 2 MB of other pages.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import batches_of, bloom_of, materialize, merge, scratch, table, tidy

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES, TRAIN_ROWS, TRAIN_BYTES = 64 << 10, 1000, 8 << 20
LEVEL, FILE_BYTES, MIN_REVISIT_BYTES = 3, 128 << 20, 0
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps the response's HTTP headers but no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = "".join(c for c in url or "about:blank" if c > " ") or "about:blank"
    fields = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if not revisit:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record("revisit", fields, http)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (in lower case) and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI that executors can write to."""
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:") else f"file://{path}")


def train(pages: DataFrame, size: int = DICTIONARY_BYTES, rows: int = TRAIN_ROWS, total: int = TRAIN_BYTES) -> bytes:
    """A dictionary of records of the pages; empty if there is too little to learn from."""
    import zstandard

    # the sample is picked by ids alone; its pages are then read by a broadcast of at most rows hashes
    key = F.xxhash64("page_id", F.lit("train"))
    chosen = pages.select(key.alias("k")).orderBy("k").limit(rows).distinct()
    sample, held = [], 0
    for r in pages.withColumn("k", key).join(F.broadcast(chosen), "k", "left_semi").select("page_id", "url", "html").limit(rows).toLocalIterator():
        record = page_record(r["page_id"], r["url"], (r["html"] or "").encode(), None, False)
        if held + len(record) <= total:
            sample.append(record)
            held += len(record)
    if held < 8 * size or len(sample) < 16:
        size = held // 8
    if size < 1024 or len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:  # records too much alike or too short
        return b""


class Writer:
    """Archive files of one task; each is renamed to its final name when it is whole."""

    def __init__(self, folder: str, dictionary: bytes, level: int = LEVEL, file_bytes: int = FILE_BYTES):
        import zstandard

        self.fs, self.folder = filesystem(folder)
        self.dictionary, self.limit = dictionary, file_bytes
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True)
        self.out, self.done, self.size, self.records = None, [], 0, 0
        task = TaskContext.get()
        self.stem = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}"

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.stem}-{len(self.done):04d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.folder}/_{self.name}", compression=None)
            self.size = self.records = 0
            self._write(SKIPPABLE.to_bytes(4, "little") + len(self.dictionary).to_bytes(4, "little") + self.dictionary)
            info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self._write(self.compressor.compress(info))
        self._write(self.compressor.compress(record))
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
            self.done.append((self.name, self.records, self.size))
            self.out = None


def read_archive(source, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open archive file, one frame at a time."""
    import zstandard

    head = source.read(8)
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = source.read(int.from_bytes(head[4:], "little"))
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    pending = b""
    while True:
        data = pending or source.read(chunk)
        pending = b""
        if not data:
            return
        frame, parts = d.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                pending = frame.unused_data
                break
            if not (data := source.read(chunk)):
                raise ValueError("an archive ends within a record")
        yield parse_record(b"".join(parts))


FILES = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and the payload's 64-bit key, digest and size."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html", F.xxhash64(payload).alias("key"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))


def repeated(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """key, digest, size and rep, the page whose record holds the payload, of payloads of min_bytes and more that occur more than once."""
    groups = payloads(pages).where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.first("key").alias("key"), F.max("page_id").alias("rep"), F.count("*").alias("n"))
    return groups.where("n > 1").select("key", "digest", "size", "rep")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each page below folder (a URI that all executors share). Returns file, records, bytes."""
    spark = pages.sparkSession
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    held = spark.sparkContext.broadcast(train(pages))
    groups = materialize(repeated(pages, min_bytes), "repeated")
    bloom = bloom_of(groups, "key")

    def records(batch, rep) -> Iterator[bytes]:
        for page_id, url, html, rep in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), rep, strict=True):
            yield page_record(page_id, url, (html.as_py() or "").encode(), rep, rep != page_id)

    def write(batches, alone: bool):
        writer = Writer(folder, held.value, file_bytes=file_bytes)
        for batch in batches:
            if alone:
                batch = batch.filter(pa.array(~bloom.value.may_hold(batch.column("key"))))
            for record in records(batch, batch.column("page_id" if alone else "rep").to_pylist()):
                writer.add(record)
        writer.close()
        yield from batches_of(writer.done, FILES)

    def may_repeat(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.value.may_hold(batch.column("key"))))

    ddl = "file string, records long, bytes long"
    keyed = payloads(pages)
    alone = keyed.select("page_id", "url", "html", "key").mapInArrow(tidy(lambda batches: write(batches, True)), ddl)
    some = keyed.mapInArrow(tidy(may_repeat), keyed.schema)
    met = some.join(merge(groups.select("digest", "size", "rep", F.lit(True).alias("met"))), ["digest", "size"], "left")
    met = met.select("page_id", "url", "html", F.when(F.col("met"), F.col("rep")).otherwise(F.col("page_id")).alias("rep"))
    return materialize(alone.unionByName(met.mapInArrow(tidy(lambda batches: write(batches, False)), ddl)), "archives")


ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """A row for each page record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's digest and length are recomputed from its payload and must agree with its fields; a revisit's are those
    of the payload it stands for.
    """

    def rows(names):
        fs, path = filesystem(folder)
        for name in names:
            with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                for fields, block in read_archive(f):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    if kind == "response" and (size != len(payload) or digest != base32_sha1(payload)):
                        raise ValueError(f"{name}: a payload is not what its record says")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    yield int(page) if page else None, size, digest, kind, int(refers) if refers else None, fields["warc-target-uri"]

    def read(batches):
        for batch in batches:
            yield from batches_of(rows(batch.column("file").to_pylist()), ROWS)

    n = max(1, files.count())
    return files.select("file").repartition(n, "file").mapInArrow(tidy(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(files, folder).drop("url")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS rep FROM pages
), d AS (SELECT page_id, rep, strlen(html) AS payload_bytes, sha1(html) AS h FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN rep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rep = page_id THEN NULL ELSE rep END AS refers_to
FROM d
"""
