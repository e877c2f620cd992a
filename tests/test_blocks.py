"""Layers by blocks against plain products: uneven blocks, repeated ids, nothing, and what is moved."""

import numpy as np
import pytest

from framewright.operators import blocks, mlp


def frames(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").repartition(3)


def rows(df):
    got = sorted(df.collect(), key=lambda r: r["row_id"])
    return [r["row_id"] for r in got], np.array([r["x"] for r in got])


@pytest.mark.parametrize("in_block, out_block, row_block", [(1024, 1024, 4096), (5, 3, 7), (4, 11, 100), (13, 2, 1)])
def test_a_network_equals_plain_products(spark, in_block, out_block, row_block):
    rng = np.random.default_rng(1)
    net = mlp.Mlp([rng.standard_normal((9, 13)), rng.standard_normal((4, 9))], [rng.standard_normal(9), rng.standard_normal(4)])
    x = rng.standard_normal((25, 13))
    f = frames(spark, x)
    ids, got = rows(blocks.apply(f.unionByName(f.where("row_id < 2")), *net.tables(spark), 2, in_block, out_block, row_block))
    assert ids == [0, 0, 1, 1, *range(2, 25)]
    assert np.abs(got - net.forward(x)[ids]).max() < 1e-12


def test_a_layer_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(mlp, "BROADCAST_WEIGHTS", 1000)
    rng = np.random.default_rng(2)
    net = mlp.Mlp([rng.standard_normal((60, 90))], [rng.standard_normal(60)])
    x = rng.standard_normal((40, 90))
    weights, biases = net.tables(spark)
    one = blocks.layer(weights.drop("layer"), biases.drop("layer"), 32, 25)
    assert (one.across, one.down, one.blocks.count()) == (3, 3, 9)
    ids, got = rows(blocks.dense(frames(spark, x), one, False, 16))
    assert ids == list(range(40)) and np.abs(got - net.forward(x)).max() < 1e-12
    # pieces three times over, weights for each of three groups, three partial sums
    assert one.moved(40, 16) == 8 * (40 * 90 * 3 + 90 * 60 * 3 + 40 * 60 * 3)
    assert one.moved(40, 16) < 24 * 40 * 90 * 60 / 4  # of a row of (id, output, product) per weight and frame


def test_nothing_and_other_lengths(spark):
    weights, biases = mlp.by_rule([4, 3]).tables(spark)
    f = frames(spark, np.ones((3, 4)))
    assert blocks.apply(f.where("row_id < 0"), weights, biases, 1).count() == 0
    with pytest.raises(Exception, match="width"):
        blocks.apply(frames(spark, np.ones((3, 5))), weights, biases, 1).collect()
