"""Templates sought in endless signals: overlap-save correlation, over a table or over a stream, with the same result.

A signal is a table of pieces (channel, start: index of the first sample, x: real parts, then imaginary ones, ts). The score of a template m of
N samples at place t is |sum_n x[t + n] conj(m[n])| / (|x[t .. t + N - 1]| |m|), between 0 and 1. A detection is a place whose score is at
least the threshold and that is a peak: higher than at t - 1 and not lower than at t + 1, where these places have a score.

Places are dealt into blocks of `block`. To decide block j one needs the samples from j `block` - 1 to (j + 1) `block` + N - 1: its own, one before,
and N after, which it shares with its neighbour. A block's scores come from one FFT product a run of samples without a gap;
a place has no score where a sample of its window is missing. Blocks lie at fixed indexes, so the
result depends neither on how the signal is cut into pieces nor on micro-batches.

`detections` is the pass over a table: pieces are cut by blocks, and each block is a small group, however long a channel is. `detect_stream` keeps, per
channel, only samples of blocks not yet decided. A block is decided when all its samples are there, or when the watermark has
passed the times of all that are, which closes gaps. Samples that come for a decided block are late and dropped; of samples that
come twice the first arrival stays in a stream, the earlier piece (by start, then by values) in a table; repeats of a piece are one. Null and
non-finite samples are missing ones. Null pieces and pieces without channel or with no start, or one below 0, are left out; a null
time counts as the oldest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewright.functions import vec
from framewright.operators.score import complex_rows
from framewright.shipping import ship

BLOCK = 4096
FOUND = "channel string, label int, place long, score double"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bank:
    """Templates of one length, as (label, unit complex vector), and what a block needs of them."""

    def __init__(self, labels: list[int], templates: np.ndarray, block: int, threshold: float):
        norm = np.sqrt((np.abs(templates) ** 2).sum(1, keepdims=True))
        self.labels, self.unit = labels, templates / np.maximum(norm, vec.ENERGY_FLOOR)
        self.n, self.block, self.threshold = templates.shape[1], block, threshold
        self.spectra: dict[int, np.ndarray] = {}

    def span(self, block: int) -> tuple[int, int]:
        """First sample that a block needs, and the one after its last."""
        return block * self.block - 1, (block + 1) * self.block + self.n

    def scores(self, run: np.ndarray) -> np.ndarray:
        """(templates, places) of a run of samples without a gap, by one product of spectra."""
        places = len(run) - self.n + 1
        size = 1 << (len(run) - 1).bit_length()  # the circular product's first places don't wrap
        if size not in self.spectra:
            self.spectra[size] = np.conj(np.fft.fft(self.unit, size, axis=1))
        raw = np.abs(np.fft.ifft(np.fft.fft(run, size)[None, :] * self.spectra[size], axis=1)[:, :places])
        windows = np.lib.stride_tricks.sliding_window_view(np.abs(run) ** 2, self.n).sum(1)
        return raw / np.maximum(np.sqrt(windows), vec.ENERGY_FLOOR)[None, :]

    def decide(self, block: int, at: np.ndarray, x: np.ndarray) -> list[tuple[int, int, float]]:
        """(label, place, score) of a block from samples `x` at ascending indexes `at`."""
        lo, hi = self.span(block)
        inside = slice(*np.searchsorted(at, [lo, hi]))
        at, x, out = at[inside], x[inside], []
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        for index, run in zip(np.split(at, cuts), np.split(x, cuts)):
            if len(run) < self.n:
                continue
            s = np.pad(self.scores(run), ((0, 0), (1, 1)), constant_values=-1.0)
            here, first = s[:, 1:-1], int(index[0])
            peak = (here >= self.threshold) & (here > s[:, :-2]) & (here >= s[:, 2:])
            for label, place in zip(*np.nonzero(peak)):
                if block * self.block <= first + place < (block + 1) * self.block:
                    out.append((self.labels[label], first + int(place), float(here[label, place])))
        return out


def merged(pieces: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Finite samples of pieces (start, x) by index; where several have a sample, the first piece's."""
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(start, start + len(x)) for start, x in pieces)])
    x = np.concatenate([np.zeros(0, np.complex128), *(x for _, x in pieces)])
    at, x = at[np.isfinite(x)], x[np.isfinite(x)]
    index, first = np.unique(at, return_index=True)
    return index, x[first]


def bank_of(templates: DataFrame, block: int, threshold: float) -> Bank:
    """Of templates (label, mu: stacked): as few as go to every task."""
    from framewright.operators.score import fits

    if not fits(templates):
        raise ValueError("the templates don't fit a broadcast")
    rows = templates.select("label", vec.doubles("mu").alias("mu")).orderBy("label").collect()
    if not rows or len({len(r["mu"]) for r in rows}) != 1:
        raise ValueError("templates of one length are needed")
    n = len(rows[0]["mu"]) // 2
    if n > block:
        raise ValueError("a block must be at least as long as a template")
    return Bank([r["label"] for r in rows], complex_rows(np.array([r["mu"] for r in rows])), block, threshold)


def pieces_of(signal: DataFrame) -> DataFrame:
    rows = signal.where("channel is not null and start >= 0 and x is not null and size(x) >= 2")
    return rows.select(F.col("channel").cast("string").alias("channel"), F.col("start").cast("long").alias("start"), vec.doubles("x").alias("x"), *(["ts"] if "ts" in signal.columns else []))


def as_doubles(x) -> np.ndarray:
    """Nulls as NaN."""
    return np.array([np.nan if v is None else v for v in x], np.float64)


def frame_of(channel: str, found: list[tuple[int, int, float]]) -> pd.DataFrame:
    label, place, score = zip(*found) if found else ((), (), ())
    return pd.DataFrame({"channel": pd.Series([channel] * len(found), dtype=str), "label": np.array(label, np.int32), "place": np.array(place, np.int64), "score": np.array(score, np.float64)})


def detections(signal: DataFrame, templates: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """FOUND of a table of pieces (channel, start, x). Each piece goes to the blocks that need samples of it."""
    ship(signal.sparkSession)
    shared = signal.sparkSession.sparkContext.broadcast(bank_of(templates, block, threshold))
    n = shared.value.n
    rows = pieces_of(signal).withColumn("n", F.expr("size(x) div 2").cast("long"))
    first = F.floor((F.col("start") - n) / block).cast("long") - 1
    last = F.floor((F.col("start") + F.col("n")) / block).cast("long") + 1
    cut = rows.withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.col("block") * block - 1, (F.col("block") + 1) * block + n
    begin, end = F.greatest("start", lo), F.least(F.col("start") + F.col("n"), hi)
    skip, length = (begin - F.col("start")).cast("int"), (end - begin).cast("int")
    own = F.concat(F.slice("x", skip + 1, length), F.slice("x", F.col("n").cast("int") + skip + 1, length))
    cut = cut.where(end > begin).select("channel", "block", begin.alias("start"), own.alias("x")).distinct()

    def decide(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted((int(s), tuple(as_doubles(x))) for s, x in zip(pieces["start"], pieces["x"]))
        at, x = merged([(s, complex_rows(np.array([v]))[0]) for s, v in ordered])
        return frame_of(key[0], shared.value.decide(key[1], at, x))

    return cut.groupBy("channel", "block").applyInPandas(decide, FOUND)


class Detector(StatefulProcessor):
    """One channel's undecided samples."""

    def __init__(self, bank: Bank):
        self.bank = bank

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "start long, x array<double>, ms long")
        self.decided = handle.getValueState("decided", "block long")  # blocks up to it

    def _load(self) -> tuple[list, int | None]:
        known = self.decided.get() if self.decided.exists() else None
        return [(r[0], complex_rows(np.array([r[1]]))[0], r[2]) for r in self.pieces.get()], known[0] if known else None

    def _decide(self, pieces: list, decided: int | None, watermark: int) -> tuple[list, list, int | None]:
        """Detections of blocks that are ready, in order; pieces that later blocks need; the last block decided. Samples are merged once: what
        a decided block no longer needs is passed over, so that the time grows with the pieces and not with their square."""
        out, kept = [], -1
        at, x = merged([p[:2] for p in pieces])
        ordered = sorted((s, s + len(p), ms) for s, p, ms in pieces)
        start, end, times = (np.array(c, np.int64) for c in zip(*ordered)) if ordered else (np.zeros(0, np.int64),) * 3
        reach = np.maximum.accumulate(end)
        while True:
            first = np.searchsorted(at, kept)
            if first == len(at):
                return out, [], decided
            # the first block that needs a sample of what is held
            block = max((int(at[first]) - self.bank.n) // self.bank.block, 0 if decided is None else decided + 1)
            lo, hi = self.bank.span(block)
            needed = range(max(lo, 0), hi)
            held = np.searchsorted(at, [needed.start, needed.stop])
            if held[1] - held[0] != len(needed):
                own = slice(np.searchsorted(reach, kept, "right"), np.searchsorted(start, hi))
                waits = times[own][end[own] > kept]
                if not (len(waits) and waits.max() <= watermark):
                    return out, [(max(s, kept), p[max(0, kept - s) :], ms) for s, p, ms in pieces if s + len(p) > kept], decided
            out += self.bank.decide(block, at, x)
            decided, kept = block, (block + 1) * self.bank.block - 1

    def _store(self, pieces: list, decided: int | None) -> None:
        self.pieces.put([(int(s), np.concatenate([p.real, p.imag]).tolist(), int(ms)) for s, p, ms in pieces]) if pieces else self.pieces.clear()
        if decided is not None:
            self.decided.update((int(decided),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces, decided = self._load()
        open_from, came = 0 if decided is None else (decided + 1) * self.bank.block - 1, set()
        for part in rows:
            for start, x, ts in zip(part["start"].tolist(), part["x"], part["ts"]):
                own, ms = complex_rows(as_doubles(x)[None])[0], 0 if pd.isna(ts) else int(pd.Timestamp(ts).timestamp() * 1000)
                skip = max(0, open_from - start)
                if skip < len(own):
                    pieces.append((start + skip, own[skip:], ms))
                    came.add(ms)
        out, pieces, decided = self._decide(pieces, decided, timerValues.getCurrentWatermarkInMs())
        for ms in came & {ms for *_, ms in pieces}:  # only what waits needs to be woken
            self.handle.registerTimer(ms)
        self._store(pieces, decided)
        yield frame_of(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, pieces, decided = self._decide(*self._load(), timerValues.getCurrentWatermarkInMs())
        self._store(pieces, decided)
        yield frame_of(key[0], out)

    def close(self) -> None:
        pass


def detect_stream(signal: DataFrame, templates: DataFrame, threshold: float = 0.8, block: int = BLOCK, late: str = "1 minute") -> DataFrame:
    """FOUND of a stream of pieces (channel, start, x, ts). `late` is how long a gap is waited for; times lie after the start of
    1970, where Spark's watermark begins. State is kept in RocksDB, which is set here where nothing else is."""
    spark = signal.sparkSession
    ship(spark)
    if spark.conf.get(STATE_STORE, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKS)
    bank = bank_of(templates, block, threshold)
    rows = pieces_of(signal).withWatermark("ts", late)
    return rows.groupBy("channel").transformWithStateInPandas(Detector(bank), FOUND, "Append", "EventTime")
