"""Templates in endless signals: against direct sums, and the stream against the pass over a table, however it is cut."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.streaming import correlate

N, BLOCK, THRESHOLD = 8, 32, 0.7
PIECE = "channel string, start long, x array<double>, ts timestamp"


def signal(seed, length):
    """Noise with both templates in it, turned and scaled, at random places."""
    rng = np.random.default_rng(seed)
    z = 0.3 * (rng.standard_normal(length) + 1j * rng.standard_normal(length))
    m = shapes()
    for k, at in enumerate(range(5, length - N, 23)):
        z[at : at + N] += 3 * np.exp(1j * k) * m[k % 2]
    return z


def shapes():
    rng = np.random.default_rng(77)
    return rng.standard_normal((2, N)) + 1j * rng.standard_normal((2, N))


def templates(spark):
    return spark.createDataFrame([(i + 3, np.concatenate([m.real, m.imag]).tolist()) for i, m in enumerate(shapes())], "label int, mu array<double>")


def direct(z, missing=()):
    """(label, place) of peaks by the definition."""
    m, have = shapes(), np.ones(len(z), bool)
    have[list(missing)] = False
    out = set()
    for label, t in enumerate(m):
        s = np.full(len(z) + 2, -1.0)
        for at in range(len(z) - N + 1):
            if have[at : at + N].all():
                w = z[at : at + N]
                s[at + 1] = abs((w * t.conj()).sum()) / np.linalg.norm(w) / np.linalg.norm(t)
        out |= {(label + 3, at) for at in range(len(z)) if s[at + 1] >= THRESHOLD and s[at + 1] > s[at] and s[at + 1] >= s[at + 2]}
    return out


def cut(z, seed, channel="a", longest=40):
    rng, at, rows = np.random.default_rng(seed), 0, []
    while at < len(z):
        n = int(rng.integers(1, longest))
        part = z[at : at + n]
        rows.append((channel, at, np.concatenate([part.real, part.imag]).tolist(), f"2024-01-01 00:{at // 60 % 60:02d}:{at % 60:02d}"))
        at += n
    return rows


def pieces(spark, rows):
    return spark.createDataFrame(rows, "channel string, start long, x array<double>, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def found(df):
    return sorted((r["channel"], r["label"], r["place"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_the_table_pass_finds_what_the_definition_says(spark, seed):
    z = signal(seed, 500)
    got = correlate.detections(pieces(spark, cut(z, seed)), templates(spark), THRESHOLD, BLOCK)
    rows = found(got)
    assert {(r[1], r[2]) for r in rows} == direct(z) and len(rows) == len(direct(z)) > 20
    assert found(correlate.detections(pieces(spark, cut(z, seed + 10, longest=200)), templates(spark), THRESHOLD, BLOCK)) == rows
    assert all(THRESHOLD <= r[3] <= 1 + 1e-12 for r in rows)


def test_gaps_repeats_and_odd_pieces(spark):
    z = signal(3, 400)
    rows = [r for r in cut(z, 3, longest=12) if not 100 <= r[1] < 150]
    have = {i for r in rows for i in range(r[1], r[1] + len(r[2]) // 2)}
    odd = [("a", None, [1.0, 2.0], None), (None, 3, [1.0, 2.0], None), ("a", 4, None, None), ("a", 9000, [], None), ("a", -5, [1.0, 2.0], None), ("a", 100, [None, 1.0], None), ("a", 101, [float("nan"), 1.0], None)]
    got = correlate.detections(pieces(spark, rows + rows[:5] + odd), templates(spark), THRESHOLD, BLOCK)
    assert {(r[1], r[2]) for r in found(got)} == direct(z, set(range(400)) - have)
    assert correlate.detections(pieces(spark, []), templates(spark), THRESHOLD, BLOCK).count() == 0


def streamed(spark, folder, batches, late="10 seconds"):
    """The detections of a stream whose micro-batches are these rows, closed by a far later piece of another channel."""
    source, name = f"{folder}/in", "d" + os.path.basename(str(folder)).replace("-", "_")
    os.makedirs(source)
    query = None
    for i, rows in enumerate([*batches, [("end", 0, [0.0, 0.0], "2024-01-02 00:00:00")], [("end", 1, [0.0, 0.0], "2024-01-03 00:00:00")]]):
        pieces(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PIECE).parquet(source)
        out = correlate.detect_stream(stream, templates(spark), THRESHOLD, BLOCK, late)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, i
    return found(spark.read.parquet(f"{folder}/out"))


def test_the_stream_equals_the_table_whatever_the_micro_batches(spark, tmp_path):
    """Two channels, cut at random; within a batch and between batches pieces come out of order, by less than is waited for."""
    rows = cut(signal(4, 300), 4) + cut(signal(5, 260), 5, "b")
    want = found(correlate.detections(pieces(spark, rows), templates(spark), THRESHOLD, BLOCK))
    assert len(want) > 15
    by_time = sorted(rows, key=lambda r: r[1])
    rng = np.random.default_rng(6)
    for k, parts in enumerate((3,)):
        cuts = np.array_split(np.arange(len(by_time)), parts)
        batches = [[by_time[i] for i in rng.permutation(c)] for c in cuts]
        batches[0], batches[1] = batches[0][:-1] + batches[1][:1], batches[1][1:] + [batches[0][-1]]  # a piece comes a batch too late
        assert streamed(spark, tmp_path / f"run{k}", batches, "10 minutes") == want


def test_gaps_close_when_the_watermark_passes_and_late_samples_are_dropped(spark, tmp_path):
    z = signal(7, 320)
    rows = cut(z, 7, longest=10)
    late = [r for r in rows if 60 <= r[1] < 75]
    first = [r for r in rows if r not in late]
    gone = {i for r in late for i in range(r[1], r[1] + len(r[2]) // 2)}
    got = streamed(spark, tmp_path / "late", [first, late], "1 second")
    # by the time the late ones come, the watermark has passed all but the last second's blocks
    assert {(r[1], r[2]) for r in got} == direct(z, gone)


def test_samples_are_merged_once_however_many_blocks(monkeypatch):
    """With gaps that the watermark has closed or not, and pieces that overlap; blocks are decided in one pass over what is held."""
    z, calls, merged = signal(8, 40 * BLOCK), [], correlate.merged
    monkeypatch.setattr(correlate, "merged", lambda pieces: calls.append(len(pieces)) or merged(pieces))
    bank = correlate.Bank([3, 4], shapes(), BLOCK, THRESHOLD)
    pieces = [(at, z[at : at + 11], at) for at in range(0, len(z), 10) if not 300 <= at < 330 and not 900 <= at < 950]
    out, rest, decided = correlate.Detector(bank)._decide(pieces, None, 700)
    assert len(calls) == 1 and decided == 26  # the next block needs samples 863 to 903, of which some are missing and times up to 890 not passed
    assert rest[0][0] == 27 * BLOCK - 1 and {ms for *_, ms in rest} == {ms for *_, ms in pieces if ms + 11 > 27 * BLOCK - 1}
    more, rest, decided = correlate.Detector(bank)._decide(rest, decided, 10_000)
    have = {i for s, p, _ in pieces for i in range(s, s + len(p))}
    assert {(label, place) for label, place, _ in out + more} == direct(z, set(range(len(z))) - have) and rest == []
