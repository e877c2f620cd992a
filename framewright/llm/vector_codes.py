"""Product codes of whole-number vectors: each of `parts` equal pieces is named by the nearest entry of its codebook.

Exponion search: a piece starts at the entry it had in the round before, at squared distance D. An entry that is as near or nearer lies
within twice the distance of that one (triangle inequality), so only entries whose squared distance to it is at most 4 D
are looked at, along that entry's list of neighbours, sorted by distance once a round. All distances are exact
integers, the bound holds with equality, and of entries at one distance the lowest index wins, so the result is that of looking at
all entries. In the first round a piece starts at entry 0.

A round is one scan. Each task writes its rows with their codes, from which the next round starts, and, as rows of another kind, its sums
and counts per entry; these are added up in Spark. The table of the round before is then dropped. A lost executor costs the tasks
it ran. The driver gets lengths x parts x entries x piece numbers, whatever the number of rows.

Vectors of each length have codebooks of their own; a length that `parts` doesn't divide takes no part, and `MAX_LENGTHS` lengths are the
most that are served, which bounds what goes to every task. An empty vector has pieces without components: codes and error 0.
Null vectors, null or non-finite components and components beyond `integer_vectors.bound` leave a row out. First entries are
the pieces of the smallest ids, of rows with one id those with the smaller packed bytes, null ids last; with fewer rows there are fewer
entries. Repeated rows count each. An empty table gives no row. Columns but id, vector and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_shared, slices, stored
from .integer_vectors import packed, squared, unpacked
from .near_dedup import hinted

BATCH = 4096
MAX_LENGTHS = 1000


class Codebook:
    """Entries of one part position, and for each entry its neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = entries[:, None, :] - entries[None, :, :]
        between = np.einsum("abi,abi->ab", apart, apart)
        self.order = np.argsort(between, 1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, 1)

    def search(self, pieces: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, exact squared distance) of each piece, and how many distances were computed."""
        best, least = start.astype(np.int64), squared(pieces, self.entries[start])
        needed = (self.sorted[start] <= 4 * least[:, None]).sum(1)  # 4 D fits: D is at most 2^60
        rank = np.argsort(-needed, kind="stable")  # those with more neighbours to see stand in front
        reach, looked = needed[rank], len(pieces)
        for r in range(len(self.entries)):
            rows = rank[: np.searchsorted(-reach, -r)]  # pieces that need over r neighbours
            if not len(rows):
                break
            entry = self.order[start[rows], r]
            d = squared(pieces[rows], self.entries[entry])
            looked += len(rows)
            better = (d < least[rows]) | ((d == least[rows]) & (entry < best[rows]))
            rows = rows[better]
            best[rows], least[rows] = entry[better], d[better]
        return best, least, looked


class Codebooks:
    """For each vector length the entries of every part, (parts, entries, length / parts) in exact integers."""

    def __init__(self, entries: dict[int, np.ndarray]):
        self.entries = entries
        self.books = {length: [Codebook(e) for e in of] for length, of in entries.items()}

    def digest(self, length: int) -> str:
        return hashlib.sha256(",".join(map(str, self.entries[length].ravel().tolist())).encode()).hexdigest()

    def encode(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New codes and errors (rows, parts), and the number of distances, starting at `codes`."""
        books, looked = self.books[x.shape[1]], 0
        pieces = x.reshape(len(x), len(books), -1)
        best, least = np.empty_like(codes), np.empty(codes.shape, np.int64)
        for p, book in enumerate(books):
            best[:, p], least[:, p], n = book.search(pieces[:, p], codes[:, p])
            looked += n
        return best, least, looked

    def decode(self, length: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        of = self.entries[length]
        return of[np.arange(of.shape[0]), codes].reshape(len(codes), length)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The pieces of each length's smallest ids. Tasks pass on `entries` rows a length at most."""
    lengths = [r["length"] for r in rows.select("length").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    rank = F.row_number().over(W.partitionBy("length").orderBy(F.col("id").asc_nulls_last(), "v"))
    top = rows.select("length", "id", "v").withColumn("r", rank).where(F.col("r") <= entries).orderBy("length", "r").collect()
    found: dict[int, list] = {}
    for r in top:
        found.setdefault(r["length"], []).append(np.frombuffer(r["v"], "<i4").astype(np.int64))
    return Codebooks({k: np.array(v).reshape(len(v), parts, k // parts).transpose(1, 0, 2).copy() for k, v in found.items()})


def _encoded(rows: DataFrame, books: Codebooks, parts: int, sums: bool, label: str) -> DataFrame:
    """Rows with new codes and errors; with `sums` also a row per length, part and entry of what the task adds up."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    arrow_label = None

    def scan(batches):
        books, added = shared.value, {}
        names = ["id", "label", "length", "v", "codes", "error", "part", "entry", "n", "total"]
        nonlocal arrow_label
        for batch in slices(batches, BATCH):
            arrow_label = batch.schema.field("label").type
            lengths = batch.column(2).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == length))
                x = unpacked(part.column(3), length)
                before = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(len(x), parts)
                codes, error, _ = books.encode(x, before)
                kept = [part.column(0), part.column(1), part.column(2), part.column(3), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.sum(1), pa.int64())]
                none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept, *none], names=names)
                if sums:
                    size = books.entries[length].shape[1]
                    n, total = added.setdefault(length, (np.zeros((parts, size), np.int64), np.zeros(books.entries[length].shape, np.int64)))
                    pieces = x.reshape(len(x), parts, -1)
                    for p in range(parts):
                        n[p] += np.bincount(codes[:, p], minlength=size)
                        order = np.argsort(codes[:, p], kind="stable")
                        own = codes[order, p]
                        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        total[p, own[start]] += np.add.reduceat(pieces[order, p].astype(np.int64), start, axis=0)
        for length, (n, total) in added.items():
            p, e = np.nonzero(n)
            values = [pa.nulls(len(p), pa.int64()), pa.nulls(len(p), arrow_label), pa.array(np.full(len(p), length), pa.int32()), *(pa.nulls(len(p), t) for t in (pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*values, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=names)

    schema = f"id long, label {label}, length int, v binary, codes binary, error long, part int, entry int, n long, total array<long>"
    return rows.select("id", "label", "length", "v", "codes").mapInArrow(scan, schema)


def _moved(books: Codebooks, table: DataFrame) -> Codebooks:
    """Entries replaced by the floors of the means that the round's sums give; unused ones stay."""
    entries = {k: v.copy() for k, v in books.entries.items()}
    added = table.where("part is not null").select("length", "part", "entry", "n", F.posexplode_outer("total").alias("pos", "t"))
    total = F.sum(F.col("t").cast("decimal(38,0)")).alias("t")
    for r in added.groupBy("length", "part", "entry", "pos").agg(F.sum("n").alias("n"), total).where("pos is not null").collect():
        entries[r["length"]][r["part"], r["entry"], r["pos"]] = int(r["t"]) // r["n"]
    return Codebooks(entries)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(id, label, length, codes: a byte per part, error: squared), and the codebooks after `rounds` rounds."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    label = vectors.schema[label_col].dataType.simpleString()
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = packed(plain, scale, ["id", "label"], "v").where(F.col("length") % parts == 0)
    now = stored(rows.withColumn("codes", F.unhex(F.lit("00" * parts))), "codes")
    books = first_codebooks(now, parts, entries)
    for k in range(rounds + 1):
        new = stored(_encoded(now, books, parts, k < rounds, label), "codes")
        drop_shared(vectors.sparkSession, now._stored_at)
        if k < rounds:
            books = _moved(books, new)
        now, at = new.where("codes is not null"), new._stored_at
        now._stored_at = at
    return now.select("id", "label", "length", "codes", "error"), books


def encode(vectors: DataFrame, books: Codebooks, parts: int = 8, scale: int = 4096,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, length, codes, error) of further vectors under given codebooks; those of a length without one are left out."""
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("int").alias("label"), F.col(vector_col).alias("v"))
    rows = packed(plain, scale, ["id", "label"], "v").where(F.col("length").isin(*books.entries) if books.entries else F.lit(False))
    return _encoded(rows.withColumn("codes", F.unhex(F.lit("00" * parts))), books, parts, False, "int").select("id", "length", "codes", "error")


def digest(vectors: DataFrame, **options) -> DataFrame:
    """One row per vector: id, code (hex), error, label_error (over equal labels, nulls together; null where a long can't hold it),
    codebooks_sha256 of the vector's length."""
    codes, books = compress(vectors, **options)
    sums = stored(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")), "label-errors")
    sums = sums.select(F.col("label").alias("of"), F.expr("try_cast(s as long)").alias("label_error"))
    joined = codes.join(hinted(sums), F.col("label").eqNullSafe(F.col("of")))
    # a row for each of at most MAX_LENGTHS lengths
    shas = vectors.sparkSession.createDataFrame([(k, books.digest(k)) for k in books.entries], "length int, codebooks_sha256 string")
    joined = joined.join(F.broadcast(shas), "length")
    return joined.select(F.col("id").alias(options.get("id_col", "vec_id")), F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")
