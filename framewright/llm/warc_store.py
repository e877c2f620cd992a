"""Web archives: WARC 1.1 records, each a Zstandard frame of its own under a dictionary that leads the file.

A file is, one after another,
  * a skippable frame (magic 0x184D2A5D) that holds the dictionary, as the WARC-zstd convention has it,
  * frames of one record each, the first a `warcinfo` record,
  * after some records, a skippable frame (0x184D2A51) with their frames' lengths, and one (0x184D2A50) with a mark.
Any Zstandard reader that takes the dictionary from the first frame gets the plain WARC file; the last two kinds are passed over. Spark's
text sink writes the files: a row is a run of frames, its line end the mark's frame. So they reach any store that Spark
writes to, and a lost or repeated task leaves whole files only. The same mark lets Spark split a file among tasks when it is read.
The mark is drawn anew for every archive; a frame that held it by chance would stop the write. `read_files` reads archives of
other writers, without marks, a file at a time.

Of rows with equal payloads of `REVISIT_BYTES` or more, that with the smallest page_id is a `response`, the others are `revisit` records
of it, with the header of the HTTP response but no payload. Rows that repeat that page_id with that payload are responses (with
one record id), as a record can't revisit its own id; so are all rows if no id is known. Only digests that repeat, with their smallest ids, meet the pages: sent to
all tasks where their counted number allows, else by a shuffle on the digest, in which Spark splits a hot one.

Null and empty texts are an empty payload. A null url is written as about:blank; control characters, blanks and bytes beyond ASCII of a
url are percent-encoded. A null page_id comes after all others. A very long page is one frame. An empty table gives no record.
Columns other than id, url and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_path, slices
from .near_dedup import hinted

DICTIONARY, LENGTHS, MARK = 0x184D2A5D, 0x184D2A51, 0x184D2A50
REVISIT_BYTES = 100
CHUNK_BYTES = 1 << 20
#: Bounds of what the dictionary is trained on: pieces of records, from all parts of all records.
DICT_BYTES, DICT_PIECES, PIECE_CHARS = 64_000, 1500, 3000
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def mark_frame(mark: str) -> bytes:
    """All ASCII, so that it can be a line end: 16 characters give a length below 128."""
    return skippable(MARK, mark.encode("ascii"))


def safe_url(url: str | None) -> str:
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in (url or "about:blank").encode("utf-8", "surrogatepass"))


def record_id(page_id: int | None, digest: str, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {copy}')}>"


def record(kind: str, block: bytes, ident: str, date: str, headers: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, copy: str) -> bytes:
    """A page's response, or its revisit of the response of page `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    headers = [("WARC-Target-URI", safe_url(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    headers += [("X-Page-ID", str(page_id))] * (page_id is not None)
    if refers_to is None:
        return record("response", http + payload, record_id(page_id, digest, copy), date, headers)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return record("revisit", http, record_id(page_id, digest, copy), date, headers)


def parsed(data: bytes) -> dict:
    """Columns of RECORD_SCHEMA of one record; a response whose payload doesn't have its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    of = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size, kind = int(of["content-length"]), of["warc-type"]
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the record {of.get('warc-record-id')} is cut off")
    number = lambda name: int(of[name]) if name in of else None
    digest = of.get("warc-payload-digest", "").removeprefix("sha256:") or None
    out = {"record_type": kind, "record_id": of.get("warc-record-id"), "page_id": number("x-page-id"), "url": of.get("warc-target-uri"),
           "payload_bytes": size, "payload_digest": digest, "refers_to": number("x-refers-to-page-id"), "payload": None}
    if of.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:])}
        out["payload_bytes"] = int(fields[b"content-length"]) if b"content-length" in fields else len(body)
        if kind == "response":
            if digest is not None and (len(body) != out["payload_bytes"] or hashlib.sha256(body).hexdigest() != digest):
                raise ValueError(f"the payload of {out['record_id']} isn't what its digest says")
            out["payload"] = body
    elif kind != "revisit":
        out["payload"] = block
    return out


def pages_of(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(page_id, url, payload, digest): the payload as bytes, its digest as 32 bytes."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))


def repeats(rows: DataFrame) -> DataFrame:
    """(digest, refers_to) of payloads that several rows have, counted by tasks before anything is shuffled."""
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    return large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")


def sampled_records(rows: DataFrame, pieces: int, date: str) -> list[bytes]:
    """Records of pieces of PIECE_CHARS bytes from everywhere in the pages, those with the smallest hashes, `pieces` at most: responses,
    and each fourth time a revisit. The scan passes on only pieces below a bound that the number of rows gives."""
    in_page = F.ceil(F.greatest(F.octet_length("payload"), F.lit(1)) / PIECE_CHARS).cast("int")
    rate = min(1.0, 4 * pieces / max(rows.count(), 1))
    below = F.lit(int(-(1 << 63) + rate * ((1 << 64) - 1025)))
    chosen = F.filter(F.sequence(F.lit(0), in_page - 1), lambda k: F.xxhash64(F.col("mark"), k) <= below)
    marked = rows.select("page_id", "url", "payload", F.xxhash64("payload", "page_id").alias("mark")).select("*", F.explode(chosen).alias("k"))
    piece = F.substring("payload", F.col("k") * PIECE_CHARS + 1, F.lit(PIECE_CHARS))
    top = marked.select("page_id", "url", "mark", "k", piece.alias("piece")).orderBy(F.xxhash64("mark", "k"), "mark", "k").limit(pieces)
    out = []
    for i, r in enumerate(top.collect()):
        data = bytes(r["piece"])
        out.append(page_record(r["page_id"], r["url"], data, hashlib.sha256(data).hexdigest(), None if i % 4 else r["page_id"], date, ""))
    return out


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty where there is too little to train on; frames then need none."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Frames:
    """Compresses records one by one."""

    def __init__(self, dictionary: bytes, mark: str):
        self.mark = mark_frame(mark)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if given is not None:
            given.precompute_compress(level=LEVEL)
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_checksum=True)

    def frame(self, data: bytes) -> bytes:
        out = self.codec.compress(data)
        if self.mark in out:
            raise ValueError("a record holds the archive's mark: write again, with another one")
        return out

    @staticmethod
    def run(frames: list[bytes]) -> bytes:
        return b"".join(frames) + skippable(LENGTHS, np.array([len(f) for f in frames], "<u4").tobytes())


def write(pages: DataFrame, out: str, date: str = "1970-01-01T00:00:00Z", dict_pieces: int = DICT_PIECES, software: str = "framewright",
          id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> bytes:
    """Write the archive's files to `out`, and its mark and dictionary's hash to `out`-set; returns the dictionary. `date` is the
    records' time, which the table doesn't hold."""
    spark = pages.sparkSession
    rows = pages_of(pages, id_col, url_col, text_col)
    given = train_dictionary(sampled_records(rows, dict_pieces, date))
    mark = uuid.uuid4().hex[:16]
    shared = spark.sparkContext.broadcast(given)
    decided = rows.join(hinted(repeats(rows)), "digest", "left")
    # a payload that is too short isn't among the repeats; a row with the smallest id, or a group without ids, is a response
    revisits = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    decided = decided.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("refers_to")).alias("refers_to"))

    def archive(batches):
        frames, task = Frames(shared.value, mark), TaskContext.get().partitionId()
        run, size, seen, started = [], 0, 0, False

        def row(data: bytes):
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in slices(batches, 500):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if not started:
                    started = True
                    about = f"software: {software}\r\nformat: WARC File Format 1.1\r\n".encode("ascii")
                    info = record("warcinfo", about, record_id(None, "", f"info {mark} {task}"), date, [("Content-Type", "application/warc-fields")])
                    run, size = [frames.frame(info)], 0
                    head = skippable(DICTIONARY, shared.value) if shared.value else b""
                seen += 1
                # revisits name their response by its page and payload; other records are numbered
                copy = f"{mark} {task} {seen}" if page_id is None or refers_to is not None else ""
                run.append(frames.frame(page_record(page_id, url, payload, digest.hex(), refers_to, date, copy)))
                size += len(run[-1])
                if size >= CHUNK_BYTES:
                    yield row(head + frames.run(run))
                    head, run, size = b"", [], 0
        if run:
            yield row(head + frames.run(run))

    lines = decided.mapInArrow(archive, "data binary").select(F.col("data").cast("string").alias("value"))
    sink = lines.write.option("lineSep", mark_frame(mark).decode("ascii")).option("compression", "none").option("maxRecordsPerFile", 0)
    sink.text(out)
    spark.createDataFrame([(mark, hashlib.sha256(given).hexdigest())], "mark string, dict_sha256 string").coalesce(1).write.parquet(f"{out}-set")
    return given


def split_run(data: bytes) -> tuple[bytes | None, list[bytes]]:
    """The dictionary, if the run leads its file, and the frames."""
    at, dictionary = 0, None
    if struct.unpack_from("<I", data)[0] == DICTIONARY:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        dictionary = data[8:at]
    # the lengths' frame ends the run, and tells how long it is itself: all lengths before it add up
    for count in _counts(data, at):
        tail = len(data) - 8 - 4 * count
        ends = at + np.cumsum(np.frombuffer(data, "<u4", count, tail + 8).astype(np.int64))
        if ends[-1] == tail:
            starts = np.concatenate([[at], ends[:-1]])
            return dictionary, [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    raise ValueError("a run of frames is cut off")


def _counts(data: bytes, at: int):
    """How many lengths may end the run: places of the frame's magic from which its size reaches just to the end."""
    magic, end = struct.pack("<I", LENGTHS), len(data)
    place = data.rfind(magic, at)
    while place >= 0:
        if place + 8 <= end and place + 8 + struct.unpack_from("<I", data, place + 4)[0] == end and end - place - 8 >= 4:
            yield (end - place - 8) // 4
        place = data.rfind(magic, at, place)


def dictionary_of(lines: DataFrame) -> bytes:
    """The dictionary that leads the archive's files; empty if none was needed."""
    lead = F.substring(F.col("data"), 1, 4) == F.lit(bytearray(struct.pack("<I", DICTIONARY)))
    got = lines.where(lead).limit(1).collect()
    return split_run(bytes(got[0]["data"]))[0] if got else b""


def _records(frames, codec) -> pa.RecordBatch:
    found = [r for r in (parsed(codec.decompress(f)) for f in frames) if r["record_type"] != "warcinfo"]
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds[f.split()[1]]) for n, f in zip(names, RECORD_SCHEMA.split(", "))], names=names)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Every page's record of an archive that `write` made: RECORD_SCHEMA; a revisit has no payload."""
    prepare(spark)
    mark, sha = spark.read.parquet(f"{out}-set").first()
    # the schema is given, so that nothing is listed or read to find it
    lines = spark.read.schema("value string").option("lineSep", mark_frame(mark).decode("ascii")).text(out).select(F.col("value").cast("binary").alias("data"))
    given = dictionary_of(lines)
    if hashlib.sha256(given).hexdigest() != sha:
        raise ValueError(f"the archive at {out} was made with another dictionary")
    shared = spark.sparkContext.broadcast(given)

    def scan(batches):
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        for batch in slices(batches, 1):
            for data in batch.column(0).to_pylist():
                yield _records(split_run(data)[1], codec)

    return lines.mapInArrow(scan, RECORD_SCHEMA)


def frames_of(data: bytes):
    """(dictionary, frames of records) of a whole file of any writer, by the codec's own ends of frames."""
    view, at, dictionary, frames = memoryview(data), 0, b"", []
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY and at == 0:
                dictionary = bytes(view[8 : 8 + size])
                if dictionary[:4] == b"\x28\xb5\x2f\xfd":
                    dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
            at += 8 + size
            continue
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        one, out, place = zstandard.ZstdDecompressor(dict_data=given).decompressobj(), [], at
        while not one.eof and place < len(view):
            part = view[place : place + 65536]
            out.append(one.decompress(part))
            place += len(part)
        if not one.eof:
            raise ValueError("the last frame is cut off")
        at = place - len(one.unused_data)
        frames.append(b"".join(out))
    return dictionary, frames


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc.zst files of any writer, a file a task: RECORD_SCHEMA."""
    prepare(spark)

    def scan(batches):
        as_is = type("AsIs", (), {"decompress": staticmethod(lambda data: data)})
        for batch in slices(batches, 1):
            for data in batch.column(0).to_pylist():
                yield _records(frames_of(data)[1], as_is)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, RECORD_SCHEMA)


def write_and_read(pages: DataFrame, **options) -> DataFrame:
    """One row per page from an archive in the shared folder: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    out = shared_path(pages.sparkSession, "archive")
    write(pages, out, **options)
    return read(pages.sparkSession, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
