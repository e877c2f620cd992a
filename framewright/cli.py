"""Command line: `python -m framewright.cli COMMAND --data PATH ...` prints one JSON line per result row.

Commands: matched-filter, retrieval, benchmark, stats, train, export-bank. `--data` is a frame table (row_id, x, label) or, with
`--kind embeddings`, a vector table, or a folder with signals or images for these kinds.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from framewright import schema
from framewright.operators import bank as banks
from framewright.operators import mlp, score, split, stats, training
from framewright.plans import evaluate
from framewright.sources import frames as sources


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewright", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        c.add_argument("--data", required=True)
        c.add_argument("--kind", choices=("table", "embeddings", "signals", "images"), default="table")
        c.add_argument("--classes", type=int, default=schema.IMAGE_CLASSES)
        c.add_argument("--train-fraction", type=float, default=0.9)
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--max-samples", type=int, help="a prefix by row_id, before splitting")
        c.add_argument("--split", choices=split.SPLITS, default="val", help="what is evaluated")
        return c

    filt = command("matched-filter", "accuracy of class-mean templates")
    filt.add_argument("--mode", choices=score.MODES, default="time")
    near = command("retrieval", "accuracy of the vote of the nearest references")
    near.add_argument("--k", type=int, default=5)
    near.add_argument("--no-normalize", action="store_true")
    near.add_argument("--limit", type=float, help="references farther than this don't vote")
    near.add_argument("--checkpoint", help="an encoder's checkpoint: compare in its latent space")
    near.add_argument("--bank", help="a stored bank that the checkpoint's encoder made")
    bench = command("benchmark", "run-time report of the matched filter")
    bench.add_argument("--mode", choices=("time", "fft"), default="fft")
    bench.add_argument("--max-train", type=int)
    bench.add_argument("--max-eval", type=int)
    bench.add_argument("--frame-repeats", type=int, default=2000)
    bench.add_argument("--warm-up", type=int, default=2)
    command("stats", "rows by split and class")
    command("smoke", "each split's first frame: shape, types, label")
    fit = command("train", "train an auto-encoder and keep its best epoch")
    fit.add_argument("--out", required=True)
    fit.add_argument("--latent", type=int, default=64)
    fit.add_argument("--hidden", type=int, nargs="*", default=[512, 256])
    fit.add_argument("--epochs", type=int, default=30)
    fit.add_argument("--batch", type=int, default=256)
    fit.add_argument("--rate", type=float, default=1e-3)
    fit.add_argument("--joint-weight", type=float, default=0.0)
    out = command("export-bank", "encode the training rows as a reference bank")
    out.add_argument("--checkpoint", required=True)
    out.add_argument("--out", required=True)
    return top


def _frames(spark: SparkSession, a: argparse.Namespace, part: str) -> DataFrame:
    if a.kind in ("signals", "images"):
        return sources.load_frames(spark, a.kind, part, data_dir=a.data, train_fraction=a.train_fraction, seed=a.seed, max_samples=a.max_samples)
    rows = spark.read.parquet(a.data)
    frames = split.prefix(sources.from_embeddings(rows) if a.kind == "embeddings" else rows, a.max_samples)
    return split.seeded(frames, part, frames.count(), fraction=a.train_fraction, seed=a.seed)


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The rows that a command prints."""
    if a.command == "stats":
        every = _frames(spark, a, "all").select("row_id", "label")
        return stats.split_counts(split.labelled(every, every.count(), a.train_fraction, a.seed), a.classes)
    if a.command == "smoke":
        parts = [evaluate.first_frame(_frames(spark, a, part), part) for part in split.SPLITS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    if a.command == "benchmark":
        every = _frames(spark, a, "all")
        return evaluate.runtime(every, every.count(), a.classes, a.mode, a.max_train, a.max_eval, a.frame_repeats, warm_up=a.warm_up)
    train = _frames(spark, a, "train")
    if a.command == "export-bank":
        encoder, config = mlp.load(spark, a.checkpoint)
        return spark.createDataFrame([(json.dumps(banks.export(train, encoder, a.out, **config)),)], "manifest string")
    val = _frames(spark, a, a.split)
    if a.command == "train":
        got = training.train_autoencoder(train, val, a.latent, tuple(a.hidden), a.epochs, a.batch, a.rate, a.joint_weight, a.classes, a.seed)
        got.save(spark, a.out, latent=a.latent, hidden=a.hidden, epochs=a.epochs, seed=a.seed, joint_weight=a.joint_weight)
        return spark.createDataFrame(got.epochs, schema.EPOCHS)
    if a.command == "matched-filter":
        first = train.select("x").first()
        return evaluate.matched_filter(train, val, a.classes, len(first["x"]) if first else 1, a.mode)
    if a.checkpoint:
        encoder, _ = mlp.load(spark, a.checkpoint)
        bank = banks.load(spark, a.bank, encoder) if a.bank else banks.encoded(train, encoder)
        return evaluate.latent_retrieval(val, encoder, bank, a.k, not a.no_normalize)
    return evaluate.knn_retrieval(val, banks.from_frames(train), a.k, not a.no_normalize, a.limit)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"framewright {a.command}").getOrCreate()
    for line in result(spark, a).toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    main()
