"""Bounded-space online packing of token ids into windows.

Each partition keeps at most `open_windows` unfinished windows. A document's ids go to the window that they
fill best; if none has room, the fullest is emitted, topped up with a cut of the document where its gap is
worth a piece of `min_cut` ids, padded otherwise. Documents longer than a window fill whole windows first.
At the end the partitions' unfinished windows are merged, those of `merge_parts` partitions in one task.

A window without padding or of a power-of-two length needs no padding; any other is padded by its reader.
Null and empty texts hold just the end id. Every id lies in exactly one piece. Repeated rows are packed as
often as they occur; an empty table gives no piece. Of windows that a document fills alike the oldest is taken. Columns other than
id and text, of whatever name, are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts, tokenizer_path
from .encoding import encoder

WIDTH = 4  # bytes per id


class Packer:
    """Windows of `size` ids; at most `limit` are open. A piece: (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, size: int, limit: int, min_cut: int):
        self.size, self.limit, self.min_cut = size, limit, min_cut
        self.gaps: list[tuple[int, int]] = []  # (free, window), ascending
        self.open: dict[int, list] = {}
        self.made = 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int):
        """Place ids; yields (window, pieces) of each window that is finished by it."""
        at, n = 0, len(ids) // WIDTH
        while n - at >= self.size:
            yield self._new(), [(doc_id, start + at, ids[at * WIDTH : (at + self.size) * WIDTH], doc_tokens)]
            at += self.size
        while at < n:
            fits = bisect.bisect_left(self.gaps, (n - at, -1))
            if fits == len(self.gaps) and len(self.gaps) < self.limit:
                w, free, take = self._new(), self.size, n - at
                self.open[w] = []
            elif fits < len(self.gaps):
                free, w = self.gaps.pop(fits)
                take = n - at
            else:
                free, w = self.gaps.pop(0)
                take = free if free >= self.min_cut and n - at - free >= self.min_cut else 0
            if take:
                self.open[w].append((doc_id, start + at, ids[at * WIDTH : (at + take) * WIDTH], doc_tokens))
                at, free = at + take, free - take
            if free and take:
                bisect.insort(self.gaps, (free, w))
            else:
                yield w, self.open.pop(w)

    def rest(self):
        yield from self.open.items()


PIECES = "part int, window long, is_open boolean, doc_id long, start long, length long, doc_tokens long, offset long, ids binary"


def _rows(part: int, windows, is_open: bool) -> pa.RecordBatch | None:
    out = [(part, w, is_open, p[0], p[1], len(p[2]) // WIDTH, p[3], o, p[2]) for w, pieces in windows for p, o in zip(pieces, _offsets(pieces))]
    kinds = (pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in PIECES.split(", ")]) if out else None


def _offsets(pieces: list) -> list[int]:
    return [0, *np.cumsum([len(p[2]) // WIDTH for p in pieces]).tolist()]


def merged(pieces: list, size: int, min_cut: int):
    """(window, pieces): pieces, long ones first, packed with few windows open; what then is open is laid end to end."""
    packer = Packer(size, 8, min_cut)
    for p in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is not None, p[0] or 0, p[1])):
        yield from packer.add(*p)
    window, free = [], size
    for doc_id, start, ids, total in (p for _, pieces in packer.rest() for p in pieces):
        while ids:
            take = min(free, len(ids) // WIDTH)
            window.append((doc_id, start, ids[: take * WIDTH], total))
            start, ids, free = start + take, ids[take * WIDTH :], free - take
            if not free:
                yield packer._new(), window
                window, free = [], size
    if window:
        yield packer._new(), window


def pack(docs: DataFrame, size: int = 4096, vocab_path: str | None = None, end_id: int = 2, open_windows: int = 64,
         min_cut: int = 16, merge_parts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned
    32-bit). Tokens are not shuffled but for the unfinished windows, at most `open_windows` of a partition."""
    path = vocab_path or tokenizer_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def place(batches):
        part, packer = TaskContext.get().partitionId(), Packer(size, open_windows, min_cut)
        for batch in slices(batches):
            done = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1).to_pylist())):
                done += packer.add(doc_id, 0, ids + end, len(ids) // WIDTH + 1)
            if done:
                yield _rows(part, done, False)
        if packer.open:
            yield _rows(part, packer.rest(), True)

    pieces = stored(texts(docs, id_col, text_col).mapInArrow(place, PIECES), "pieces", compression="zstd")

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "window", "offset"])
        ids = [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
        left = list(zip(ids, frame["start"].tolist(), frame["ids"].tolist(), frame["doc_tokens"].tolist()))
        out = [(p[0], p[1], len(p[2]) // WIDTH, p[3], (1 << 62) + (int(key[0]) << 32) + w, o, p[2]) for w, ps in merged(left, size, min_cut) for p, o in zip(ps, _offsets(ps))]
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})

    sequence = F.shiftleft(F.col("part").cast("long"), 32) + F.col("window")
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    full = pieces.where("not is_open").withColumn("sequence_id", sequence).select(columns)
    left = pieces.where("is_open").groupBy((F.col("part") / merge_parts).cast("int").alias("merge_group"))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return full.unionByName(left.applyInPandas(merge, schema))
