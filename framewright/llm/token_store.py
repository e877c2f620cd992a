"""Token-id output: a shared zstandard dictionary, one frame per document, an offset index per shard.

Format (a Parquet table in ascending document order, so that any Spark reader can fetch it):
a row is a shard of consecutive documents and holds
  part, shard      place in the order; `ids_before` ids of the same part come before
  first_id, last_id, n_docs, n_ids
  dict_sha256      hash of the dictionary that the frames need; `width`: bytes per id (2 or 4, little-endian)
  doc_ids, index   n_docs int64 ids; n_docs + 1 int64 offsets into `data`
  data             the documents' zstandard frames, one after another
The dictionary is trained on serialized id arrays of pieces of text from all parts of all documents: of all pieces of
`PIECE_CHARS` characters those with the smallest hashes, `dict_pieces` of them (a parameter; about 6 MB of text). That bounds
the codec's own state, and no id depends on it.

Null and empty texts hold just the end id; rows with the same id are stored in the order of their text's
hash; null ids come first. A very long text is one frame, and a shard of its own if need be. An empty table gives no shard. Columns
other than id and text, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices, texts, tokenizer_path
from .encoding import encoder

SHARD_BYTES, SHARD_DOCS, DICT_BYTES, PIECE_CHARS, DICT_PIECES = 2_000_000, 2000, 64_000, 3000, 2000
NULL_ID = -(1 << 63)
SHARD_SCHEMA = (
    "part int, shard int, ids_before long, first_id long, last_id long, n_docs int, n_ids long, "
    "dict_sha256 string, width int, doc_ids binary, index binary, data binary"
)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def sampled_pieces(docs: DataFrame, pieces: int) -> DataFrame:
    """(piece): `pieces` pieces of the texts, those with the smallest hashes, so that every piece of every text has the same
    chance. The scan passes on only pieces below a bound that the number of rows gives, each of which has a piece or more."""
    in_text = F.ceil(F.octet_length("text") / PIECE_CHARS).cast("int")  # in bytes, which needn't be counted: some may turn out empty
    rate = min(1.0, 4 * pieces / max(docs.count(), 1))
    below = F.lit(int(-(1 << 63) + rate * ((1 << 64) - 1025)))
    chosen = F.filter(F.sequence(F.lit(0), in_text - 1), lambda k: F.xxhash64(F.col("mark"), k) <= below)
    rows = docs.where(in_text > 0).withColumn("mark", F.xxhash64("text", "doc_id")).select("mark", "text", F.explode(chosen).alias("k"))
    rows = rows.select("mark", "k", F.substring("text", F.col("k") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece")).where("piece <> ''")
    return rows.orderBy(F.xxhash64("mark", "k"), "mark", "k").limit(pieces).select("piece")


def train_dictionary(docs: DataFrame, path: str, width: int, dict_pieces: int) -> bytes:
    """Empty where there is too little to train on; frames then need no dictionary."""

    def encode(batches):
        for batch in slices(batches):
            ids = [np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() for b in encoder(path).encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    samples = [bytes(r["ids"]) for r in sampled_pieces(docs, dict_pieces).mapInArrow(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, out: str, vocab_path: str | None = None, end_id: int = 0, dict_pieces: int = DICT_PIECES,
          id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Write the store to `out`; returns the dictionary, which is also written to `out`-dict."""
    spark = docs.sparkSession
    path = vocab_path or tokenizer_path("byte_bpe_50k.json")
    width = id_width(path)
    docs = texts(docs, id_col, text_col)
    dictionary = spark.sparkContext.broadcast(train_dictionary(docs, path, width, dict_pieces))
    sha = hashlib.sha256(dictionary.value).hexdigest()
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches):
        given = dictionary.value
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(given) if given else None)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids, frames, counts = [], [], []

        def row():
            index = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8")
            known = [NULL_ID if i is None else i for i in ids]
            values = (part, shard, before, known[0], known[-1], len(ids), sum(counts), sha, width,
                      np.array(known, "<i8").tobytes(), index.tobytes(), b"".join(frames))
            return pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=arrow)

        names = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SHARD_SCHEMA.split(", ")])
        size = 0
        for batch in slices(batches):
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1).to_pylist())):
                all_ids = np.frombuffer(got + end, "<u4")
                ids.append(doc_id)
                frames.append(pack.compress(all_ids.astype(f"<u{width}").tobytes()))
                counts.append(len(all_ids))
                size += len(frames[-1])
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield row()
                    shard, before, size = shard + 1, before + sum(counts), 0
                    ids, frames, counts = [], [], []
        if ids:
            yield row()

    # a range of ids per partition; the text's hash deals out a repeated id and orders its rows
    order = docs.withColumn("h", F.xxhash64("text"))
    order = order.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    order.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(out)
    spark.createDataFrame([(sha, bytearray(dictionary.value))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}-dict")
    return dictionary.value


def read(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """Every document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the ids as
    little-endian unsigned 32-bit integers, and the ids themselves if asked for."""
    sha, given = spark.read.parquet(f"{out}-dict").first()
    dictionary = spark.sparkContext.broadcast((sha, bytes(given)))
    store = spark.read.schema(SHARD_SCHEMA).parquet(out)
    # a row for each part, of which there are as many as the writer's tasks
    totals = sorted((r["part"], r["n"]) for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, run = [], 0
    for part, n in totals:
        bases.append((part, run))
        run += n
    placed = store.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def unpack(batches):
        for batch in slices(batches):
            for r in batch.to_pylist():
                at = r["base"] + r["ids_before"]
                got = list(documents(r, *dictionary.value))
                n = np.array([len(x) for _, x in got], np.int64)
                start = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                columns = [pa.array([i for i, _ in got], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for _, x in got], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int32) for _, x in got], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.select("base", "ids_before", "dict_sha256", "width", "doc_ids", "index", "data").mapInArrow(unpack, schema)


def documents(shard: dict, sha: str, dictionary: bytes, only: int | None = None):
    """(doc_id, ids as '<u4') of a shard's documents, or of one of them: just its own frame is then opened."""
    if shard["dict_sha256"] != sha:
        raise ValueError(f"the shard needs dictionary {shard['dict_sha256']}, not {sha}")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    ids, index = np.frombuffer(shard["doc_ids"], "<i8"), np.frombuffer(shard["index"], "<i8")
    for k in range(len(ids)) if only is None else np.flatnonzero(ids == only):
        frame = unpack.decompress(shard["data"][index[k] : index[k + 1]])
        yield None if ids[k] == NULL_ID else int(ids[k]), np.frombuffer(frame, f"<u{shard['width']}").astype("<u4")


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document's rows: the shard's id range is pushed to the reader, then one frame is opened."""
    sha, given = spark.read.parquet(f"{out}-dict").first()
    hits = spark.read.schema(SHARD_SCHEMA).parquet(out).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return [x for r in hits.toLocalIterator() for _, x in documents(r.asDict(), sha, bytes(given), doc_id)]


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """Round trip through a store in the shared folder."""
    out = shared_path(docs.sparkSession, "token-store")
    write(docs, out, **options)
    return read(docs.sparkSession, out)
