"""A linear layer too large for a broadcast: a block-matrix product.

Weights (out, pos, w) are laid in blocks of `out_block` x `in_block`, one row each; frames are dealt into groups of about `row_block` and their
vectors cut at the same positions. A group's piece and a block that share their positions meet in one task and make a product of two
matrices; products of one group and block row are added up position block by position block. So nothing is shuffled by scalars:
with n rows, R groups, O block rows and I position blocks, n in O doubles of pieces, in out R of weights and, if I is above 1, n out I of
partial sums (`moved` gives the bytes). A task holds a group's pieces, one block and their product.

Frames that repeat an id are computed each. A position that a block doesn't name has weight 0. No frames give no rows; vectors of another
length than `width` are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.functions.vec import doubles
from framewright.operators.score import as_rows
from framewright.shipping import ship

BLOCK = "ob int, cb int, weights binary, bias binary"


class Layer:
    """A layer's blocks, a table of BLOCK, and its shape."""

    def __init__(self, blocks: DataFrame, width: int, height: int, in_block: int, out_block: int):
        self.blocks, self.width, self.height, self.in_block, self.out_block = blocks, width, height, in_block, out_block
        self.across, self.down = math.ceil(width / in_block), math.ceil(height / out_block)

    def moved(self, n: int, row_block: int) -> int:
        """Bytes of doubles that a product with n frames shuffles."""
        groups = max(1, math.ceil(n / row_block))
        return 8 * (n * self.width * self.down + self.width * self.height * groups + (n * self.height * self.across if self.across > 1 else 0))


def layer(weights: DataFrame, biases: DataFrame, in_block: int = 1024, out_block: int = 1024) -> Layer:
    """Blocks of (out, pos, w) and (out, b), written out once. Biases go with their first block."""
    ship(weights.sparkSession)
    width, height = weights.agg(F.max("pos") + 1, F.max("out") + 1).first()
    w = weights.select((F.col("out") / out_block).cast("int").alias("ob"), (F.col("pos") / in_block).cast("int").alias("cb"), F.col("out").cast("int").alias("out"), F.col("pos").cast("int").alias("pos"), F.col("w").cast("double").alias("w"))
    b = biases.select((F.col("out") / out_block).cast("int").alias("ob"), F.lit(0).alias("cb"), F.col("out").cast("int").alias("out"), F.lit(-1).alias("pos"), F.col("b").cast("double").alias("w"))

    def lay(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ob, cb = key[0].as_py(), key[1].as_py()
        out, pos, w = (rows[c].to_numpy() for c in ("out", "pos", "w"))
        tall, wide = min(out_block, height - ob * out_block), min(in_block, width - cb * in_block)
        block, bias, is_bias = np.zeros((tall, wide)), np.zeros(tall), pos < 0
        bias[out[is_bias] - ob * out_block] = w[is_bias]
        block[out[~is_bias] - ob * out_block, pos[~is_bias] - cb * in_block] = w[~is_bias]
        return pa.table([pa.array([ob], pa.int32()), pa.array([cb], pa.int32()), pa.array([block.tobytes()], pa.binary()), pa.array([bias.tobytes()], pa.binary())], names=[f.split()[0] for f in BLOCK.split(", ")])

    return Layer(scratch.written(w.unionByName(b).groupBy("ob", "cb").applyInArrow(lay, BLOCK), "weight-blocks"), width, height, in_block, out_block)


def dense(frames: DataFrame, one: Layer, relu: bool, row_block: int = 4096, x: str = "x") -> DataFrame:
    """Frames (row_id, x) with `x` replaced by the layer's output."""
    ship(frames.sparkSession)
    fits = F.assert_true(F.size(doubles(x)) == one.width, F.lit("a vector's length isn't the layer's width")).isNull()
    rows = frames.select(F.monotonically_increasing_id().alias("key"), "row_id", doubles(x).alias("x")).where(fits)
    rows = scratch.written(rows, "rows")
    groups = max(1, math.ceil(rows.count() / row_block))
    dealt = rows.withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(one.across - 1)), lambda c: F.slice("x", c * one.in_block + 1, one.in_block))
    left = dealt.select("key", "rb", F.posexplode(cut).alias("cb", "piece")).withColumn("ob", F.explode(F.sequence(F.lit(0), F.lit(one.down - 1))))
    right = one.blocks.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    last = one.across == 1

    def finished(values: np.ndarray) -> np.ndarray:
        return np.maximum(values, 0) if relu else values

    def table(key: np.ndarray, rb: int, ob: int, values: np.ndarray) -> pa.Table:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.float64()))
        return pa.table([pa.array(key), pa.array(np.full(len(key), rb), pa.int32()), pa.array(np.full(len(key), ob), pa.int32()), lists], names=["key", "rb", "ob", "part"])

    def multiply(at: tuple[pa.Scalar, ...], pieces: pa.Table, blocks: pa.Table) -> pa.Table:
        rb, ob, cb = (v.as_py() for v in at)
        tall = min(one_out, height - ob * one_out)
        if not len(pieces):
            return table(np.zeros(0, np.int64), rb, ob, np.zeros((0, tall)))
        p = as_rows(pieces["piece"].combine_chunks())
        values = np.zeros((len(p), tall))
        for weights, bias in zip(blocks["weights"].to_pylist(), blocks["bias"].to_pylist()):
            values += p @ np.frombuffer(weights, float).reshape(tall, -1).T + np.frombuffer(bias, float)
        return table(pieces["key"].to_numpy(), rb, ob, finished(values) if last else values)

    def add(at: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        key, values = parts["key"].to_numpy(), as_rows(parts["part"].combine_chunks())
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
        return table(key[order][start], at[0].as_py(), at[1].as_py(), finished(np.add.reduceat(values[order], start, axis=0)))

    one_out, height, schema = one.out_block, one.height, "key long, rb int, ob int, part array<double>"
    parts = left.groupBy("rb", "ob", "cb").cogroup(right.groupBy("rb", "ob", "cb")).applyInArrow(multiply, schema)
    if not last:
        parts = parts.groupBy("rb", "ob").applyInArrow(add, schema)
    whole = parts.groupBy("key").agg(F.flatten(F.sort_array(F.collect_list(F.struct("ob", "part")))["part"]).alias("x"))
    return whole.join(rows.select("key", "row_id"), "key").select("row_id", "x")


def apply(frames: DataFrame, weights: DataFrame, biases: DataFrame, layers: int, in_block: int = 1024, out_block: int = 1024, row_block: int = 4096) -> DataFrame:
    """(row_id, x): a network's output, its weights (layer, out, pos, w) and biases (layer, out, b) as tables, ReLU between layers."""
    for k in range(layers):
        one = layer(*(t.where(F.col("layer") == k).drop("layer") for t in (weights, biases)), in_block, out_block)
        frames = dense(frames, one, k + 1 < layers, row_block)
    return frames
