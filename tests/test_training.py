"""Training in barrier stages: the same weights whatever the tasks, gradients against differences, the ring."""

import threading

import numpy as np
import pytest

from framewright.operators import mlp, training
from framewright.operators.ring import TOKEN_BYTES, Ring


def frames(spark, n=150, dim=6, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(rng.standard_normal((n, dim)))]
    return spark.createDataFrame(rows, "row_id long, label int, x array<double>").repartition(parts)


def weights(got):
    return np.concatenate([a.ravel() for net in (got.encoder, got.decoder, got.head) if net for a in (*net.weights, *net.biases)])


def test_weights_do_not_depend_on_the_tasks(spark):
    f = frames(spark)
    f = f.unionByName(f.where("row_id = 7"))  # a repeated row
    got = {n: training.train_autoencoder(f, f, 3, (5,), epochs=3, batch=20, rate=1e-2, joint_weight=0.2, num_classes=3, tasks=n) for n in (1, 2, 4)}
    assert {n: g.tasks for n, g in got.items()} == {1: 1, 2: 2, 4: 4}
    for n in (2, 4):
        assert np.abs(weights(got[n]) - weights(got[1])).max() < 1e-9
        assert np.abs(np.array(got[n].epochs) - np.array(got[1].epochs)).max() < 1e-9
    assert got[1].epochs[-1][2] < got[1].epochs[0][2]


def test_an_epoch_equals_the_same_steps_by_hand(spark):
    f = frames(spark, 60)
    got = training.train_autoencoder(f, f, 2, (4,), epochs=2, batch=16, rate=1e-2, seed=5, tasks=3)
    net = training.Net(6, (4,), 2, 10, 0.0)
    state = training.Descent(net.random(5), 1e-2, "adam")
    for epoch in (1, 2):
        rows = f.selectExpr(f"pmod(xxhash64(row_id, {epoch}, 5), 4L) b", "row_id", "x").collect()
        for b in range(4):
            x = np.array([r["x"] for r in sorted(rows, key=lambda r: r["row_id"]) if r["b"] == b])
            if len(x):
                state.move([g / len(x) for g in net.losses(state.p, x, np.zeros(len(x), int), True)[2]])
    best = got.epochs[-1][2] < got.epochs[0][2]
    assert best and np.abs(weights(got) - np.concatenate([a.ravel() for a in [*state.p[0:4:2], *state.p[1:4:2], *state.p[4:8:2], *state.p[5:8:2]]])).max() < 1e-9


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(3)
    net = training.Net(5, (4, 3), 2, 3, 0.7)
    p, x, y = net.random(4), rng.standard_normal((7, 5)), rng.integers(0, 3, 7)
    _, _, g = net.losses(p, x, y, True)
    loss = lambda: (lambda a: a[0] + 0.7 * a[1])(net.losses(p, x, y, False))
    for i, a in enumerate(p):
        for at in list(np.ndindex(a.shape))[:6]:
            kept = a[at]
            a[at] = kept + 1e-6
            up = loss()
            a[at] = kept - 1e-6
            down = loss()
            a[at] = kept
            assert g[i][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_adam_and_descent_take_the_steps_they_should():
    for optimizer, want in (("adam", 1 - 0.1 * 2 / (2 + 1e-8)), ("sgd", 1 - 0.1 * 2)):
        state = training.Descent([np.ones(1)], 0.1, optimizer)
        state.move([np.full(1, 2.0)])
        assert state.p[0][0] == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        training.Descent([], 0.1, "other")


def test_fewer_rows_than_tasks_and_none(spark):
    f = frames(spark, 3)
    got = training.train_autoencoder(f, f, 1, (2,), epochs=1, batch=1, tasks=4)
    assert len(got.epochs) == 1 and np.isfinite(weights(got)).all()
    none = training.train_autoencoder(f.where("row_id < 0"), f, 1, (2,), epochs=1)
    assert none.epochs[0][1] == 0 and none.tasks == 1
    with pytest.raises(ValueError, match="shapes"):
        training.train_autoencoder(f, f, 1, (2,), initial=(mlp.by_rule([6, 3, 1]), mlp.by_rule([1, 3, 6]), mlp.by_rule([1, 10])))


def test_start_from_given_weights_and_stay_with_rate_zero(spark):
    f, nets = frames(spark, 40), (mlp.by_rule([6, 3, 2]), mlp.by_rule([2, 3, 6]), mlp.by_rule([2, 10]))
    got = training.train_autoencoder(f, f, 2, (3,), epochs=1, rate=0.0, initial=nets)
    assert got.encoder.digest() == nets[0].digest() and got.decoder.digest() == nets[1].digest() and got.head is None


class Place:
    """A barrier stage's context for threads."""

    def __init__(self, rank, size, meet, places):
        self.rank, self.size, self.meet, self.places = rank, size, meet, places

    def partitionId(self):
        return self.rank

    def getTaskInfos(self):
        return [type("Info", (), {"address": "127.0.0.1:1"})] * self.size

    def allGather(self, message):
        self.places[self.rank] = message
        self.meet.wait()
        return list(self.places)


@pytest.mark.parametrize("size, length", [(1, 5), (2, 1), (3, 10), (5, 3), (4, 100_003)])
def test_the_ring_sums(size, length):
    meet, places, out = threading.Barrier(size), [None] * size, [None] * size
    values = [np.random.default_rng(r).standard_normal(length) for r in range(size)]

    def run(rank):
        ring = Ring(Place(rank, size, meet, places), b"t" * TOKEN_BYTES)
        out[rank] = [ring.total(values[rank]), ring.total(np.full(length, float(rank)))]
        ring.close()

    threads = [threading.Thread(target=run, args=(r,)) for r in range(size)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    for first, second in out:
        assert first.tobytes() == out[0][0].tobytes() and np.allclose(first, sum(values)) and (second == sum(range(size))).all()
