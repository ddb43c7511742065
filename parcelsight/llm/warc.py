"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a seek table in a skippable frame at the end of each
archive gives every frame's place, and an index table maps records to a frame and an offset in it.
Archives are written by the tasks into a shared folder. Their names hold the task attempt, and the
index, which Spark commits, names only archives of attempts that counted: readers go by the index,
so leftovers of lost tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, new_folder, written

#: Uncompressed bytes of a frame and of an archive, at least, before the next one is begun.
FRAME_BYTES, ARCHIVE_BYTES = 1 << 18, 1 << 27
LEVEL = 3
#: Payloads shorter than this are never revisits.
RUN_OF_FRAMES = 8
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the seekable Zstandard format and of WARC revisit records.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_id string, archive string, frame long, offset long, length long"
RECORD = ("archive string, frame long, offset long, page_id long, url string, record_type string, "
          "refers_to long, payload_bytes long, payload_digest string, payload binary")


def _urn(page_id: int | None, salt: str) -> str:
    name = f"page:{page_id}" if page_id is not None else f"no-id:{salt}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
           refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to``) has the payload's size and digest only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, '')}",
                 f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(header fields, block, where the next record begins) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(fields["Content-Length"])
    return fields, data[start:stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, uncompressed) sizes of frames."""
    body = b"".join(struct.pack("<II", *s) for s in sizes)
    body += struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int]]:
    """(place, compressed size) of each frame of an open archive, read from its end."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8  # entries with checksums are longer
    body = file.read_at(width * count, size - 9 - width * count)
    places, at = [], 0
    for k in range(count):
        packed, _ = struct.unpack_from("<II", body, width * k)
        places.append((at, packed))
        at += packed
    return places


def _decided(pages: DataFrame) -> DataFrame:
    """Pages with payload_bytes, payload_digest and refers_to (null for responses)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "payload_bytes", F.octet_length("html").cast("long")).withColumn(
        "payload_digest", F.sha1(F.col("html").cast("binary")))
    copied = written(
        rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "copied")
    found = rows.join(copied, "payload_digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select(
        "page_id", "url", "payload_bytes", "payload_digest",
        F.when(other, F.col("first")).alias("refers_to"),
        F.when(F.col("first").isNull() | ~other, F.col("html").cast("binary")).alias("payload"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into ``folder``; returns the index.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the rows with the largest page_id are
    responses and the others revisit it. Null pages are empty ones, null urls are left out of
    their record, null ids can't be referred to. Further columns are left out. No rows: no
    archives.
    """
    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        archive, out, sizes, written_bytes, frame, index = 0, None, [], 0, [], []

        def close_frame():
            nonlocal frame, written_bytes
            if not frame:
                return
            data = b"".join(frame)
            packed = packer.compress(data)
            out.write(packed)
            sizes.append((len(packed), len(data)))
            written_bytes += len(data)
            frame = []

        def close_archive():
            nonlocal out, sizes, written_bytes, archive
            close_frame()
            out.write(seek_table(sizes))
            out.close()
            out, sizes, written_bytes, archive = None, [], 0, archive + 1

        held = 0
        for batch in batches:
            for r in batch.itertuples():
                if out is None:
                    file = f"{name}-{archive:04d}.warc.zst"
                    out = store.open_output_stream(f"{base}/{file}", compression=None)
                page = None if pd.isna(r.page_id) else int(r.page_id)
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                data = record(page, r.url, r.payload, r.payload_bytes, r.payload_digest, refers)
                index.append((page, _urn(page, r.payload_digest), file, len(sizes), held,
                              len(data)))
                frame.append(data)
                held += len(data)
                if held >= FRAME_BYTES:
                    held = 0
                    if written_bytes >= ARCHIVE_BYTES:
                        close_archive()
                    else:
                        close_frame()
            yield _index_frame(index)
            index = []
        if out is not None:
            close_archive()

    bounded_batches(pages.sparkSession)
    return written(_decided(pages).mapInPandas(bundle, INDEX), "index")


def _index_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "record_id", "archive", "frame", "offset",
                                      "length"])
    return out.astype({"page_id": "Int64"})


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all frames that ``index`` names, with columns ``RECORD``.

    Frames are read each by itself, at the place the archive's seek table gives. ``payloads``
    False leaves out the payloads after they have been measured.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        name, file, places = None, None, []
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for archive, number in zip(batch["archive"], batch["frame"], strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, store.open_input_file(f"{base}/{archive}")
                    places = read_seek_table(file)
                at, size = places[number]
                data = unpacker.decompress(file.read_at(size, at))
                rows, offset = [], 0
                while offset < len(data):
                    fields, block, end = parse(data, offset)
                    rows.append((archive, number, offset, *_content(fields, block, payloads)))
                    offset = end
                found = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                yield found.astype({"page_id": "Int64", "refers_to": "Int64"})
        if file is not None:
            file.close()

    # runs of neighbouring frames are dealt over a fixed number of tasks: the list is tiny, so a
    # number left to Spark would be one, whatever the frames weigh
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = (
        index.select("archive", "frame").distinct()
        .repartition(tasks, "archive", F.floor(F.col("frame") / RUN_OF_FRAMES))
        .sortWithinPartitions("archive", "frame"))
    return frames.mapInPandas(unpack, RECORD)


def _content(fields: dict, block: bytes, payloads: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(head.rpartition(b"Content-Length: ")[2])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        payload = None
    return (page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"],
            refers and int(refers), size, digest, payload if payloads else None)


def lookup(index: DataFrame, folder: str) -> DataFrame:
    """Exactly the records of an index's rows; only their frames are read."""
    return read(index, folder).join(
        index.select("archive", "frame", "offset"), ["archive", "frame", "offset"], "left_semi")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
