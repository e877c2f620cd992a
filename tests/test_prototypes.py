"""k-means within classes against plain numpy, its first centres, and every awkward bank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import knn, prototypes
from framewright.schema import BANK


def bank(spark, z, label, parts=3):
    return spark.createDataFrame([(i, list(map(float, v)) if v is not None else None, c) for i, (v, c) in enumerate(zip(z, label))], "ref_index long, z array<double>, label int").repartition(parts)


def lloyd(x, centres, rounds):
    centres = centres.copy()
    for _ in range(rounds):
        best = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for j in range(len(centres)):
            if (best == j).any():
                centres[j] = x[best == j].mean(0)
    return centres


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_rounds_equal_plain_ones_class_by_class(spark, rounds):
    rng = np.random.default_rng(1)
    z, label = rng.standard_normal((240, 5)), np.where(np.arange(240) % 3 == 0, np.arange(240) % 4, 1)  # class 1 has most rows
    b = bank(spark, z, label.tolist())
    start = prototypes.first_by_hash(b, 4)
    got = prototypes.fit(b, 4, rounds, initial="hash")
    for c, centres in got.centres.items():
        assert np.allclose(centres, lloyd(z[label == c], start[c], rounds))
    rows = got.bank(spark).collect()
    assert [r["ref_index"] for r in rows] == list(range(16)) and [r["label"] for r in rows] == sorted(r["label"] for r in rows)


def test_ties_empty_centres_and_repeats(spark):
    """Equal references give equal centres: the first takes all, the others stay."""
    b = bank(spark, [[1, 1]] * 6 + [[5, 5]] * 2, [0] * 8)
    start = prototypes.first_by_hash(b, 8)
    got = prototypes.fit(b, 8, 5, initial="hash")
    assert np.array_equal(got.centres[0], start[0]) and got.rounds == 1 and got.cost(b) == 0


def test_fewer_rows_than_prototypes_odd_rows_and_nothing(spark):
    z = [[0, 0], [1, 0], [9, 9], None, [float("nan"), 1], [2, 2]]
    b = bank(spark, z, [0, 0, 1, 1, 1, None])
    for initial in ("hash", "oversampled"):
        got = prototypes.fit(b, 3, 3, initial=initial)
        assert {c: sorted(v.tolist()) for c, v in got.centres.items()} == {0: [[0, 0], [1, 0]], 1: [[9, 9]]}
    none = prototypes.fit(b.where("ref_index < 0"), 3)
    assert none.centres == {} and none.bank(spark).count() == 0
    with pytest.raises(ValueError):
        prototypes.fit(b, 0)


def test_oversampling_finds_far_clusters_and_does_not_depend_on_the_parts(spark):
    """Twelve far clusters a class, a few very small: random starts miss some, drawing by distance doesn't."""
    rng = np.random.default_rng(2)
    middle = rng.uniform(-1000, 1000, (2, 12, 4))
    sizes = [200, 200, 5, 5, 40, 40, 3, 60, 60, 5, 20, 20]
    z, label = [], []
    for c in range(2):
        for j, n in enumerate(sizes):
            z += (middle[c, j] + rng.standard_normal((n, 4))).tolist()
            label += [c] * n
    b = bank(spark, z, label)
    got = prototypes.fit(b, 12, 8)
    best = sum(((np.array(z)[np.array(label) == c][:, None] - middle[c][None]) ** 2).sum(2).min(1).sum() for c in range(2))
    assert got.cost(b) < 1.2 * best < 0.01 * prototypes.fit(b, 12, 8, initial="hash").cost(b)
    again = prototypes.fit(bank(spark, z, label, 7), 12, 8)
    assert all(np.allclose(again.centres[c], got.centres[c]) for c in got.centres)


def test_prototypes_serve_as_a_bank(spark):
    rng = np.random.default_rng(3)
    middle = rng.uniform(-50, 50, (6, 8))
    label = np.arange(300) % 3
    z = middle[np.arange(300) % 6] + rng.standard_normal((300, 8))
    small = prototypes.fit(bank(spark, z, label.tolist()), 2).bank(spark)
    assert small.schema == spark.createDataFrame([], BANK).schema and small.count() == 6
    queries = spark.createDataFrame([(i, int(label[i]), z[i].tolist()) for i in range(60)], "row_id long, label int, x array<double>")
    assert knn.majority_vote(knn.nearest(queries, small, 1)).where(F.col("y") != F.col("pred")).count() == 0
    unit = prototypes.fit(bank(spark, z, label.tolist()), 2).bank(spark, normalize=True).collect()
    assert all(abs(np.linalg.norm(r["z"]) - 1) < 1e-9 for r in unit)
