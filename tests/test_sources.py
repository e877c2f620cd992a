"""Sources, streaming, and the entry points."""

import gzip

import numpy as np
import pytest

from framewright.operators import templates
from framewright.sources import frames as sources
from framewright.streaming import classify


def idx(a):
    return bytes([0, 0, 8, a.ndim]) + np.array(a.shape, ">u4").tobytes() + a.astype(np.uint8).tobytes()


def test_idx_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    images, labels = rng.integers(0, 256, (7, 4, 4)), np.arange(7) % 3
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "train-images-idx3-ubyte").write_bytes(idx(images))
    (tmp_path / "images" / "train-labels-idx1-ubyte.gz").write_bytes(gzip.compress(idx(labels)))
    got = sources.load_frames(spark, "images", "all", data_dir=str(tmp_path)).orderBy("row_id").collect()
    assert [r["label"] for r in got] == labels.tolist()
    assert np.allclose([r["x"] for r in got], images.reshape(7, -1) / 255)
    assert sources.load_frames(spark, "images", "train", data_dir=str(tmp_path)).count() == 6


def test_idx_rejects_other_files():
    with pytest.raises(ValueError):
        sources.idx_array(b"\1\2\3\4")


def test_npz_bank(spark, tmp_path):
    z = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez_compressed(tmp_path / "b.npz", z=z, label=np.array([1, 0, 1, 2]))
    got = sources.read_npz_bank(spark, str(tmp_path / "b.npz")).orderBy("ref_index").collect()
    assert [r["z"] for r in got] == z.tolist() and [r["label"] for r in got] == [1, 0, 1, 2]


def test_signals_are_stacked_and_renamed(spark, tmp_path, monkeypatch):
    row = (0, [1.0, 2.0], [3.0, 4.0], 2, 3, 1.5, 0.5, 2.5, 7.0, 11)
    names = "row_id long, re array<float>, im array<float>, signal_type int, number_of_pulses int, pulse_width double, time_delay double, pulse_repetition_interval double, signal_to_noise_ratio double, index long"
    path = str(tmp_path / "signals.parquet")
    spark.createDataFrame([row], names).write.parquet(path)
    monkeypatch.setenv(sources.SIGNAL_VARIABLE, "")
    assert sources.signal_path("data", "f") == "data/signals/f"
    monkeypatch.setenv(sources.SIGNAL_VARIABLE, path)
    r = sources.load_frames(spark, "signals", "all").first()
    assert r["x"] == [1, 2, 3, 4] and r["label"] == 2 and r["snr_db"] == 7


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        sources.load_frames(spark, "sounds")


def test_embeddings_leave_out_what_is_not_finite(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (None, [1.0, 1.0], 1), (3, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [r["row_id"] for r in sources.from_embeddings(df).collect()] == [0]


def test_stream_is_classified(spark, tmp_path):
    rows = [(i, [float(i % 2), 1.0 - i % 2], i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, label int").selectExpr("*", "timestamp '2020-01-01' as ts")
    df.write.parquet(str(tmp_path / "in"))
    mu = templates.templates(df, 2, 2)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = classify.windowed_accuracy(classify.classify(stream, mu))
    q = got.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["correct"], r["total"]) for r in spark.table("seen").collect()] == [(10, 10)]


class _SignalFile(dict):
    """What a signal file's reader offers."""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def _open_made_up(path):
    n = int(path)
    k = np.arange(n * 3).reshape(n, 3)
    labels = np.zeros(n, [("signal_type", "i4"), ("pulse_width", "f4")])
    labels["signal_type"], labels["pulse_width"] = np.arange(n) % 5, np.arange(n) / 2
    return _SignalFile(iq=(k + 1j * -k).astype(np.complex64), labels=labels)


def test_signal_file_is_read_in_slices_by_tasks(spark):
    got = sources.read_hdf5(spark, "23", 10, _open_made_up).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(23)) and got[22]["re"] == [66.0, 67.0, 68.0] and got[22]["im"] == [-66.0, -67.0, -68.0]
    assert (got[22]["signal_type"], got[22]["pulse_width"]) == (2, 11.0)
    assert sources.read_hdf5(spark, "0", 10, _open_made_up).count() == 0
