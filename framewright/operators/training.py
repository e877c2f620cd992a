"""Training an auto-encoder, with a class head on its latent if wanted, in barrier stages.

An epoch is one Spark job of tasks that run at once (`mapInArrow` with `barrier=True`). Each task holds a share of the rows, sorted by the
batch they are dealt into, and streams through it: for a step it sums errors and gradients over its rows of the batch, the
tasks add these sums up among themselves (`ring`), and each makes the same Adam step. The first task's state comes to the driver once an
epoch; gradients never do. Which rows make up a batch doesn't depend on the tasks, so the weights are those of a single task but
for the rounding of sums. A lost executor costs the epoch, which starts again from the state it began with.

The number of tasks follows the cluster, with `TASK_ROWS` rows of a batch for each. A barrier stage needs that many free slots, and
Spark allows none with dynamic allocation.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.vec import doubles
from framewright.operators import mlp
from framewright.operators.ring import TOKEN_BYTES, Ring
from framewright.operators.score import as_rows
from framewright.shipping import ship

#: Rows of a batch that make another task worth its exchange.
TASK_ROWS = 16
DECAY, SQUARE_DECAY, FLOOR = 0.9, 0.999, 1e-8
STATE = "n long, mse double, ce double, step long, parameters binary, first binary, second binary"


class Net:
    """Shapes of an auto-encoder and its head, and the loss over rows. Parameters are weights and biases by turns, the head's last."""

    def __init__(self, width: int, hidden, latent: int, num_classes: int, joint_weight: float):
        self.sizes, self.depth = [width, *hidden, latent, *reversed(hidden), width], len(hidden) + 1
        self.layers, self.width, self.joint_weight = len(self.sizes) - 1, width, joint_weight
        self.shapes = [(b, a) for a, b in [*zip(self.sizes, self.sizes[1:]), (latent, num_classes)]]

    def random(self, seed: int) -> list[np.ndarray]:
        rng, p = np.random.default_rng(seed), []
        for b, a in self.shapes:
            p += [rng.uniform(-1, 1, (b, a)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
        return p

    def given(self, encoder: mlp.Mlp, decoder: mlp.Mlp, head: mlp.Mlp) -> list[np.ndarray]:
        p = [a.copy() for net in (encoder, decoder, head) for layer in zip(net.weights, net.biases) for a in layer]
        if [w.shape for w in p[::2]] != self.shapes:
            raise ValueError(f"the networks' shapes aren't {self.shapes}")
        return p

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for b, a in self.shapes:
            out += [flat[at : at + a * b].reshape(b, a), flat[at + a * b : at + a * b + b]]
            at += a * b + b
        return out

    def losses(self, p: list[np.ndarray], x: np.ndarray, label: np.ndarray, grads: bool):
        """Sums over rows of squared errors (a mean over positions), of cross-entropies, and of gradients."""
        acts = [x]
        for i in range(self.layers):
            h = acts[-1] @ p[2 * i].T + p[2 * i + 1]
            acts.append(h if i + 1 in (self.depth, self.layers) else np.maximum(h, 0))
        diff = acts[-1] - x
        mse, ce, g = float((diff**2).sum()) / self.width, 0.0, [np.zeros_like(a) for a in p] if grads else []
        rows = np.arange(len(x))
        if self.joint_weight > 0:
            logits = acts[self.depth] @ p[-2].T + p[-1]
            e = np.exp(logits - logits.max(1, keepdims=True))
            soft = e / e.sum(1, keepdims=True)
            ce = float(-np.log(np.maximum(soft[rows, label], 1e-300)).sum())
        if grads:
            d = 2 * diff / self.width
            for i in reversed(range(self.layers)):
                if i + 1 == self.depth and self.joint_weight > 0:
                    soft[rows, label] -= 1
                    of_head = self.joint_weight * soft
                    g[-2], g[-1] = of_head.T @ acts[self.depth], of_head.sum(0)
                    d = d + of_head @ p[-2]
                if i + 1 not in (self.depth, self.layers):
                    d = d * (acts[i + 1] > 0)
                g[2 * i], g[2 * i + 1] = d.T @ acts[i], d.sum(0)
                d = d @ p[2 * i]
        return mse, ce, g


class Descent:
    """Parameters and an optimiser's state; every task that makes the same steps has the same."""

    def __init__(self, parameters: list[np.ndarray], rate: float, optimizer: str):
        if optimizer not in ("adam", "sgd"):
            raise ValueError("optimizer must be adam or sgd")
        self.p, self.rate, self.optimizer, self.step = parameters, rate, optimizer, 0
        self.m, self.v = [np.zeros_like(a) for a in parameters], [np.zeros_like(a) for a in parameters]

    def move(self, gradient: list[np.ndarray]) -> None:
        self.step += 1
        for i, g in enumerate(gradient):
            if self.optimizer == "sgd":
                self.p[i] = self.p[i] - self.rate * g
                continue
            self.m[i] = DECAY * self.m[i] + (1 - DECAY) * g
            self.v[i] = SQUARE_DECAY * self.v[i] + (1 - SQUARE_DECAY) * g * g
            mean, square = self.m[i] / (1 - DECAY**self.step), self.v[i] / (1 - SQUARE_DECAY**self.step)
            self.p[i] = self.p[i] - self.rate * mean / (np.sqrt(square) + FLOOR)


class Trained:
    def __init__(self, encoder: mlp.Mlp, decoder: mlp.Mlp, head: mlp.Mlp | None, epochs: list[tuple], best_epoch: int, tasks: int):
        self.encoder, self.decoder, self.head, self.epochs, self.best_epoch, self.tasks = encoder, decoder, head, epochs, best_epoch, tasks

    def save(self, spark: SparkSession, path: str, **config) -> None:
        """Checkpoints of the best epoch's networks."""
        config |= {"best_epoch": self.best_epoch, "val_mse": min(e[2] for e in self.epochs)}
        for name in ("encoder", "decoder", "head"):
            if getattr(self, name) is not None:
                mlp.save(getattr(self, name), spark, f"{path}/{name}", **config)


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _by_batch(parts):
    """(batch, x, labels) of sorted Arrow batches (batch, x, label): a batch's rows at once, in the order of their batches."""
    now, x, label = None, [], []
    for part in parts:
        if not part.num_rows:
            continue
        key = part.column(0).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            if now is not None and key[a] != now:
                yield now, np.concatenate(x), np.concatenate(label)
                x, label = [], []
            now = int(key[a])
            x.append(as_rows(part.column(1).slice(a, b - a)))
            label.append(part.column(2).slice(a, b - a).to_numpy(zero_copy_only=False))
    if now is not None:
        yield now, np.concatenate(x), np.concatenate(label)


def _epoch(dealt: DataFrame, net: Net, state: Descent, n_batches: int) -> tuple:
    """One epoch over rows (batch, x, label) sorted by batch within each task; the state moves on. Returns rows, mean error, mean
    cross-entropy, each row's as its batch found it."""
    shared, token = dealt.sparkSession.sparkContext.broadcast((state, net)), secrets.token_bytes(TOKEN_BYTES)

    def train(parts):
        state, net = shared.value
        ring, sums = Ring(BarrierTaskContext.get(), token), np.zeros(3)
        try:
            mine = _by_batch(parts)
            ahead = next(mine, None)
            for batch in range(n_batches):
                here = np.zeros(3 + sum(a.size for a in state.p))
                if ahead is not None and ahead[0] == batch:
                    mse, ce, g = net.losses(state.p, ahead[1], ahead[2], True)
                    here = np.concatenate([[len(ahead[1]), mse, ce], _flat(g)])
                    ahead = next(mine, None)
                here = ring.total(here)
                if here[0]:
                    sums += here[:3]
                    state.move(net.split(here[3:] / here[0]))
        finally:
            ring.close()
        if ring.rank == 0:
            blobs = [pa.array([_flat(a).tobytes()], pa.binary()) for a in (state.p, state.m, state.v)]
            yield pa.RecordBatch.from_arrays([pa.array([int(sums[0])]), pa.array([sums[1]]), pa.array([sums[2]]), pa.array([state.step]), *blobs], names=[f.split()[0] for f in STATE.split(", ")])

    row = dealt.mapInArrow(train, STATE, barrier=True).collect()[0]  # of the first task alone
    shared.destroy()
    state.step = row["step"]
    state.p, state.m, state.v = (net.split(np.frombuffer(row[c], float).copy()) for c in ("parameters", "first", "second"))
    return row["n"], row["mse"] / max(row["n"], 1), row["ce"] / max(row["n"], 1)


def evaluate(rows: DataFrame, net: Net, parameters: list[np.ndarray]) -> tuple:
    """(rows, mean error, mean cross-entropy) of rows (x, label), summed by all tasks and then by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((parameters, net))

    def scan(parts):
        n, mse, ce = 0, 0.0, 0.0
        for part in parts:
            if part.num_rows:
                p, net = shared.value
                one = net.losses(p, as_rows(part.column(0)), part.column(1).to_numpy(zero_copy_only=False), False)
                n, mse, ce = n + part.num_rows, mse + one[0], ce + one[1]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mse]), pa.array([ce])], names=["n", "mse", "ce"])

    sums = rows.select("x", "label").mapInArrow(scan, "n long, mse double, ce double").agg(F.sum("n"), F.sum("mse"), F.sum("ce")).first()
    n, mse, ce = (v or 0 for v in sums)
    return n, mse / max(n, 1), ce / max(n, 1)


def train_autoencoder(train: DataFrame, val: DataFrame, latent: int, hidden=(512, 256), epochs: int = 30, batch: int = 256,
                      rate: float = 1e-3, joint_weight: float = 0.0, num_classes: int = 10, seed: int = 42, optimizer: str = "adam",
                      initial: tuple[mlp.Mlp, mlp.Mlp, mlp.Mlp] | None = None, tasks: int | None = None) -> Trained:
    """Mini-batch training on all rows (row_id, label, x) of both tables. The loss is the mean squared error, plus `joint_weight` times
    the head's cross-entropy. Every epoch deals each row into one of the batches by a hash, so that batches have `batch` rows
    on average. The epoch with the smallest validation error is kept, the earliest if several are. `initial`: encoder, decoder and
    head to start from, in place of random ones. `tasks`: in place of as many as the cluster and the batch allow."""
    spark = train.sparkSession
    ship(spark)
    rows, held = (df.select("row_id", doubles("x").alias("x"), F.col("label").cast("long").alias("label")) for df in (train, val))
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    width = width or held.agg(F.max(F.size("x"))).first()[0] or 1
    net = Net(width, hidden, latent, num_classes, joint_weight)
    state = Descent(net.given(*initial) if initial else net.random(seed), rate, optimizer)
    tasks = tasks or max(1, min(spark.sparkContext.defaultParallelism, -(-min(batch, max(n_rows, 1)) // TASK_ROWS)))
    n_batches = max(1, -(-n_rows // batch))
    # dealt out once, by rows and not by ids, which may repeat; an epoch only sorts what a task has
    rows = rows.repartition(tasks, F.xxhash64("row_id", "x")).persist()
    held = held.persist()
    log, best = [], None
    for epoch in range(1, epochs + 1):
        key = F.pmod(F.xxhash64("row_id", F.lit(epoch), F.lit(seed)), F.lit(n_batches))
        dealt = rows.withColumn("batch", key).sortWithinPartitions("batch", "row_id").select("batch", "x", "label")
        _, mse, ce = _epoch(dealt, net, state, n_batches)
        _, val_mse, val_ce = evaluate(held, net, state.p)
        log.append((epoch, mse, val_mse, ce, val_ce))
        if best is None or val_mse < best[0]:
            best = val_mse, epoch, [a.copy() for a in state.p]
    rows.unpersist()
    held.unpersist()
    _, best_epoch, p = best
    cut = 2 * net.depth
    head = mlp.Mlp([p[-2]], [p[-1]]) if joint_weight > 0 else None
    return Trained(mlp.Mlp(p[0:cut:2], p[1:cut:2]), mlp.Mlp(p[cut:-2:2], p[cut + 1 : -2 : 2]), head, log, best_epoch, tasks)
