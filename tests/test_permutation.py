"""The permutation: one to one at awkward sizes, undone, seeded, and the splits made of it."""

import hashlib

import pytest
from pyspark.sql import functions as F

from framewright.operators import permutation, split


def plain(x, n, seed):
    """The same in plain Python."""
    a, b = permutation.sides(n)
    h = lambda j, v, m: int(hashlib.md5(f"{seed}:{j}:{v}".encode()).hexdigest()[:15], 16) % m
    while True:
        for j in range(permutation.TURNS):
            left, right = divmod(x, b)
            x = ((left + h(j, right, a)) % a) * b + right if j % 2 == 0 else left * b + (right + h(j, left, b)) % b
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 100, 1000, 1021])
def test_one_to_one_and_undone(spark, n):
    df = spark.range(n).withColumn("p", permutation.permuted(F.col("id"), n, 7))
    rows = df.withColumn("q", permutation.permuted(F.col("p"), n, 7, back=True)).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["q"] == r["id"] for r in rows)
    assert [r["p"] for r in rows] == [plain(r["id"], n, 7) for r in rows]


def test_sizes_beyond_any_array(spark):
    n = 10**15 + 37
    got = spark.createDataFrame([(0,), (1,), (n - 1,), (None,)], "id long").withColumn("p", permutation.permuted(F.col("id"), n, 3))
    rows = got.withColumn("q", permutation.permuted(F.col("p"), n, 3, back=True)).collect()
    assert all(r["p"] is None if r["id"] is None else 0 <= r["p"] < n and r["q"] == r["id"] and r["p"] == plain(r["id"], n, 3) for r in rows)


def test_it_mixes_and_follows_the_seed(spark):
    n = 2000
    df = spark.range(n).select(*(permutation.permuted(F.col("id"), n, s).alias(f"p{s}") for s in (1, 2))).toPandas()
    assert (df.p1 == df.p2).sum() < 10
    assert abs(df.p1.corr(df.index.to_series())) < 0.08 and abs(df.p1[:200].mean() - n / 2) < 150


@pytest.mark.parametrize("n, rounding, trains", [(5, "half_even", 4), (15, "half_even", 14), (25, "half_even", 22), (25, "floor", 22), (15, "floor", 13), (997, "half_even", 897)])
def test_exact_sizes_of_splits(spark, n, rounding, trains):
    frames = spark.range(n).withColumnRenamed("id", "row_id")
    parts = {s: {r["row_id"] for r in permutation.split_exactly(frames, s, n, rounding=rounding).collect()} for s in ("train", "val", "test", "all")}
    assert len(parts["train"]) == trains == split.train_size(n, 0.9, rounding) and parts["val"] == parts["test"] == parts["all"] - parts["train"]


def test_a_filter_without_shuffle_or_python(spark):
    plan = permutation.split_exactly(spark.range(1000).withColumnRenamed("id", "row_id"), "val", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_epochs_have_exact_batches(spark):
    frames = spark.range(300).withColumnRenamed("id", "row_id")
    one, two = (permutation.epoch_places(frames, 300, e).withColumn("batch", F.expr("place div 32")) for e in (1, 2))
    assert sorted(r["count"] for r in one.groupBy("batch").count().collect()) == [12] + [32] * 9
    assert one.join(two, ["row_id", "place"]).count() < 10


def test_positions_outside_are_errors(spark):
    with pytest.raises(Exception, match="outside"):
        spark.range(11).select(permutation.permuted(F.col("id"), 10, 1).alias("p")).collect()
