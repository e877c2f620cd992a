"""Versions: data and manifest change together, failures leave the old one, writers don't overtake each other."""

import os

import pytest
from pyspark.sql import functions as F

from framewright.operators import bank as banks
from framewright.operators import mlp, versions


def test_versions_follow_each_other_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    for n in (1, 2, 3):
        got = versions.publish(spark, path, {"a": spark.range(n), "b": spark.range(2 * n)}, {"n": n})
        assert got.number == n == versions.current(spark, path).number
    now = versions.current(spark, path)
    assert (now.table("a").count(), now.table("b").count(), now.manifest) == (3, 6, {"n": 3})
    assert versions.Version(spark, path, 1).table("a").count() == 1
    with pytest.raises(KeyError):
        now.table("c")
    os.makedirs(f"{path}/v-left-by-a-dead-writer")
    assert versions.clean(spark, path, 2) == 2 and versions.numbers(spark, path) == [2, 3]
    assert versions.Version(spark, path, 2).table("b").count() == 4


def test_a_writer_that_was_overtaken_fails_and_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.publish(spark, path, {"a": spark.range(1)}, {})
    late = spark.range(5)
    versions.publish(spark, path, {"a": spark.range(2)}, {"by": "other"}, after=1)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, {"a": late}, {}, after=1)
    # another publishes while the tables are written
    def overtaken():
        yield "a", spark.range(7)
        versions.publish(spark, path, {"a": spark.range(8)}, {"by": "third"})

    tables = type("Tables", (dict,), {"items": lambda self: overtaken()})(a=late)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, tables, {})
    now = versions.current(spark, path)
    assert now.manifest == {"by": "third"} and now.table("a").count() == 8
    assert len([n for n in os.listdir(tmp_path / "t") if n.startswith("v-")]) == 3


def test_a_task_that_dies_leaves_the_old_bank_whole(spark, tmp_path):
    path, encoder = str(tmp_path / "bank"), mlp.by_rule([4, 3, 2])
    f = spark.range(40).selectExpr("id row_id", "int(id % 3) label", "array(double(id), 1D, 2D, 3D) x")
    banks.export(f, encoder, path, run=1)
    bad = f.withColumn("x", F.when(F.col("row_id") == 33, F.expr("cast(raise_error('a task dies') as array<double>)")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="a task dies"):
        banks.export(bad, mlp.by_rule([4, 2]), path, run=2)
    assert banks.manifest_of(spark, path)["run"] == 1 and banks.load(spark, path, encoder).count() == 40
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 1
    banks.export(f.where("row_id < 9"), encoder, path, run=3)
    assert banks.manifest_of(spark, path)["run"] == 3 and banks.load(spark, path, encoder).count() == 9


def test_other_weights_are_an_error_or_a_warning(spark, tmp_path):
    path = str(tmp_path / "bank")
    f = spark.range(5).selectExpr("id row_id", "0 label", "array(1D, 2D) x")
    banks.export(f, mlp.by_rule([2, 2]), path)
    with pytest.raises(ValueError, match="other weights"):
        banks.load(spark, path, mlp.by_rule([2, 1]))
    with pytest.warns(UserWarning, match="other weights"):
        assert banks.load(spark, path, mlp.by_rule([2, 1]), strict=False).count() == 5


def test_checkpoints_are_versions(spark, tmp_path):
    path = str(tmp_path / "net")
    for sizes in ([3, 2], [3, 4, 2]):
        mlp.save(mlp.by_rule(sizes), spark, path, sizes=sizes)
        model, config = mlp.load(spark, path)
        assert config == {"sizes": sizes} and model.digest() == mlp.by_rule(sizes).digest()
