"""IDX files by byte ranges: the rows of the whole file, several tasks, and no bytes of rows that a filter leaves out."""

import gzip

import numpy as np
import pytest

from framewright.sources import frames, idx

RNG = np.random.default_rng(4)
IMAGES, LABELS = RNG.integers(0, 256, (53, 3, 4), dtype=np.uint8), RNG.integers(0, 10, 53, dtype=np.uint8)


def written(folder, images=IMAGES, labels=LABELS):
    def content(a):
        return bytes([0, 0, 8, a.ndim]) + b"".join(n.to_bytes(4, "big") for n in a.shape) + a.tobytes()

    paths = [str(folder / "images"), str(folder / "labels")]
    for path, a in zip(paths, (images, labels)):
        with open(path, "wb") as f:
            f.write(content(a))
    return paths


def rows(df):
    return sorted((r["row_id"], tuple(r["x"]), r["label"]) for r in df.collect())


def test_ranges_are_the_file(spark, tmp_path):
    images, labels = written(tmp_path)
    got = idx.read(spark, images, labels, 10)
    assert got.rdd.getNumPartitions() == 6
    want = [(i, tuple((IMAGES[i].ravel() / 255.0).tolist()), int(LABELS[i])) for i in range(53)]
    assert rows(got) == want == rows(frames.read_idx(spark, images, labels)) == rows(idx.read(spark, f"file://{images}", labels))


@pytest.mark.parametrize(
    "where",
    ["row_id = 17", "row_id < 4", "row_id >= 50", "row_id > 5 and row_id <= 12", "row_id in (3, 4, 5, 40, 99)", "row_id between 20 and 29 and label > 4",
     "row_id = 3 or label = 2", "row_id > 60", "row_id = 5 and row_id = 6", "row_id is not null and label in (1, 2)", "row_id % 7 = 0"],
)
def test_filters_give_the_same_rows(spark, tmp_path, where):
    images, labels = written(tmp_path)
    assert rows(idx.read(spark, images, labels, 8).where(where)) == rows(frames.read_idx(spark, images, labels).where(where))


def test_only_the_bytes_of_wanted_rows_are_read(tmp_path, monkeypatch):
    images, labels = written(tmp_path)
    asked = []

    class Watched:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            asked.append((n, at))
            return self.file.read_at(n, at)

    real = idx.opened
    monkeypatch.setattr(idx, "opened", lambda path: Watched(real(path)))
    reader = idx.IdxReader(images, labels, 10)
    left = list(reader.pushFilters([idx.GreaterThanOrEqual(("row_id",), 20), idx.LessThan(("row_id",), 31), idx.EqualTo(("label",), 3), idx.IsNotNull(("row_id",))]))
    assert left == [idx.EqualTo(("label",), 3)]
    parts = reader.partitions()
    assert [(p.lo, p.hi) for p in parts] == [(20, 30), (30, 31)]
    asked.clear()
    got = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in got) == 11
    assert [a for a in asked if a[1] >= 8] == [(120, 16 + 20 * 12), (10, 8 + 20), (12, 16 + 30 * 12), (1, 8 + 30)]


def test_files_that_are_not_what_they_should_be(spark, tmp_path):
    images, labels = written(tmp_path)
    whole = open(images, "rb").read()
    for bad, message in ((whole[:-1], "cut off"), (b"\1\2" + whole[2:], "IDX"), (gzip.compress(whole), "compressed"), (b"", "IDX")):
        with open(tmp_path / "bad", "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError, match=message):
            idx.header(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="label for each"):
        idx.read(spark, images, written(tmp_path, labels=LABELS[:9])[1]).count()
    with pytest.raises(Exception, match="missing"):
        spark.read.format("idx_images").option("images", images).load().count()
    none = written(tmp_path, IMAGES[:0], LABELS[:0])
    assert idx.read(spark, *none).count() == 0
