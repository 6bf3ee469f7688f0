"""WARC archives: one Zstandard frame per record, with a dictionary in a leading skippable frame.

The dictionary is built from a bounded sample of the records (``SAMPLE`` payloads at most, of up to ``SAMPLE_BYTES`` each, those
with the smallest digests, so that reruns agree), and shipped to the tasks, ``DICTIONARY`` bytes at most.  Each task writes its
records to archives in the shared folder, and begins another one, with a dictionary frame of its own, once ``ARCHIVE`` bytes are
written: no archive grows with the input, so that a reader may hold one whole.  They are written under names of the attempt
first, then moved to the task's final names, so an attempt that dies while it writes leaves nothing that is read, and one that runs
again replaces what the earlier one left, or removes it where it has fewer archives.

Of records with equal payloads (length and SHA-1) of at least ``least`` bytes the one with the largest page id is a response,
the others are revisits that refer to it and hold no payload.

Defined results: a null payload is empty; a null URL is written as none; a page without id is written with an empty id, read
back as null, and is a response if nothing with an id has its payload; pages that repeat an id are records of their own;
extra columns are ignored; an empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text, written

MAGIC = 0x184D2A5D  # of the skippable frame that holds a dictionary
LEAST, SAMPLE, SAMPLE_BYTES, DICTIONARY, LEVEL, ARCHIVE = 1000, 400, 16384, 65536, 3, 1 << 27
DATE = "1970-01-01T00:00:00Z"  # the table has no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record, an HTTP response.  ``refers`` makes it a revisit, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers is not None else http + payload
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers is not None:
        head += [f"WARC-Refers-To: {name(refers)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record; the digest and length of a response are those of the payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([\w-]+): (.*)$", head.decode().replace("\r\n", "\n"), re.M))
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:x-page:").removesuffix(">")) else None
    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != declared:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have the digest in its header")
    else:
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), declared
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload if fields["WARC-Type"] == "response" else None}


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary; where there is too little to train on, the samples themselves (or none) serve as one."""
    joined = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(1024, len(joined) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return joined[:size] if len(joined) >= 8 else b""


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed by itself.  Input is fed in small steps, so that what a frame leaves over is short."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary, at = zstandard.ZstdCompressionDict(data[8:8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            chunk = data[at:at + 8192]
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST,
                   sample: int = SAMPLE, level: int = LEVEL, archive: int = ARCHIVE) -> int:
    """Write every page as a record to ``folder/part-*.warc.zst``; returns the number of records.  An archive ends with the record
    that brings it to ``archive`` bytes."""
    payload = F.encode(as_text(html), "UTF-8")
    rows = pages.select(F.col(id).cast("bigint").alias("page"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    equal = written(rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").drop("n"), "equal-payloads")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(equal.hint("merge"), ["digest", "size"], "left").select(
        "page", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers"))

    found = pages.select(F.sha1(payload).alias("digest"), F.substring(payload, 1, SAMPLE_BYTES).alias("payload"), F.col(url).alias("url"))
    smallest = [r["digest"] for r in found.select("digest").distinct().orderBy("digest").limit(sample).collect()]
    picked = found.filter(F.col("digest").isin(smallest)).groupBy("digest").agg(F.min(F.struct("url", "payload")).alias("one")).orderBy("digest")
    rest = [(r["digest"], r["one"]["url"], bytes(r["one"]["payload"])) for r in picked.collect()]  # at most SAMPLE rows of SAMPLE_BYTES
    dictionary = train([record(0, link, body, len(body), digest, None) for digest, link, body in rest])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        files.create_dir(path)
        task, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        shrink = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
        final, own = (lambda k: f"{path}/part-{task:05d}-{k:05d}.warc.zst"), (lambda k: f"{path}/.attempt-{attempt}-{k:05d}")
        there = lambda k: files.get_file_info(final(k)).type != pa.fs.FileType.NotFound
        out, archives, size = None, 0, 0
        try:
            for b in batches:
                for r in b.to_pylist():
                    if out is None:
                        out, archives, size = files.open_output_stream(own(archives)), archives + 1, 0
                        if dictionary:
                            size += out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                    size += out.write(shrink.compress(record(r["page"], r["url"], r["payload"], r["size"], r["digest"], r["refers"])))
                    n += 1
                    if size >= archive:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        for k in range(archives):
            if there(k):
                files.delete_file(final(k))
            files.move(own(k), final(k))
        while there(archives):  # left by an attempt that died while it moved more archives
            files.delete_file(final(archives))
            archives += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    home = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)  # there even if no task has a record to write
    home.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(home)
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``) of every record in a folder."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), *[("payload", pa.binary())] * payload]
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                rows: list[dict] = []
                for data in frames(archive.as_py()):
                    one = parse(data)
                    rows.append(one if payload else {**one, "payload": None})
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content")
    return files.mapInArrow(read, names)
