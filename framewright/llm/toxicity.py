"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Each distinct character n-gram of a lower-cased text is a feature (hashed); its value is the log ratio of
the shares of toxic and clean training documents that hold it, and a logistic regression learns a
weight for each such value. Only labelled texts are learned from; labels and metadata are never inputs. Features are all
n-grams of at least `MIN_DOCS` training documents whose presence tells the classes apart at the level of `EVIDENCE` (a
likelihood-ratio statistic; 10.8 is chance in one of a thousand): a rule that doesn't depend on how many there are.

Bound (a parameter): at most `max_train` labelled rows are learned from, those with the smallest hash of their id.
Scoring covers every row and the whole of every text, in blocks of bounded length. Null and empty texts get the
score of a text without known n-grams. If no labelled text or just one class is there, the score
is the smoothed share of toxic rows. Repeated label rows of a document count once, by the largest label; of several texts of
a labelled id the smallest is learned from; repeated rows are scored each. An empty table gives no row; columns other than id
and text, of whatever name, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, drop_shared, id_remainder, prepare, slices, stored, texts

SIZES = (3, 4, 5, 6)
BITS = 20
BLOCK_CHARS = 400_000
TRAIN_TASKS, PARTS = 8, 8
MIN_DOCS, EVIDENCE = 3, 10.83


def hashed_ngrams(batch_texts: list[str], sizes=SIZES, bits=BITS):
    """For each n: (bucket of each n-gram, index of its text). N-grams don't cross texts; a text is padded with blanks."""
    padded = [" " + t.lower() + " " for t in batch_texts]
    length = np.array([len(t) for t in padded], np.int64)
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(chars))  # characters from here to the text's end
    owner = np.repeat(np.arange(len(padded)), length)
    rolling = np.zeros(len(chars), np.uint32)
    for n in range(1, max(sizes) + 1):
        rolling = rolling[: len(chars) - n + 1] * np.uint32(0x01000193) + (chars[n - 1 :] + np.uint32(1))
        if n in sizes:
            mixed = rolling * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B + 2 * n)
            inside = left[: len(mixed)] >= n
            yield (mixed >> np.uint32(32 - bits))[inside], owner[: len(mixed)][inside]


def blocks_of(batch_texts: list[str]):
    """(first index, texts) in blocks of bounded length; a long text is a block by itself."""
    first, size = 0, 0
    for i, t in enumerate(batch_texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield first, batch_texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(batch_texts):
        yield first, batch_texts[first:]


def present(batch_texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of the buckets marked in `wanted`, ordered by text."""
    found = [np.zeros(0, np.int64)]
    for bucket, owner in hashed_ngrams(batch_texts):
        hit = wanted[bucket]
        found.append(owner[hit].astype(np.int64) << BITS | bucket[hit])
    pairs = distinct(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, ratio: np.ndarray, l2: float, steps: int):
    """Weights by bucket and an intercept: logistic regression on ratio-scaled presence, full-batch Adam."""
    used = distinct(buckets)
    column, scale = np.searchsorted(used, buckets).astype(np.int32), ratio[used]
    w, b = np.zeros(len(used)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    value = scale[column]
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, weights=w[column] * value, minlength=len(labels))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(column, weights=error[rows] * value, minlength=len(used)) / len(labels) + l2 * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * scale
    return weights, float(b)


def log_ratios(counts: np.ndarray, n_class: np.ndarray) -> np.ndarray:
    """log((share of toxic documents with the n-gram) / (share of clean ones)), add-one smoothed."""
    share = (counts + 1.0) / (n_class[:, None] + 2.0)
    return np.log(share[1] / share[0])


def telling_buckets(counts: np.ndarray, n_class: np.ndarray) -> np.ndarray:
    """Mask of the buckets whose presence tells the classes apart, by the likelihood-ratio statistic."""
    n, total = counts.sum(0), n_class.sum()
    rest = n_class[:, None] - counts

    def info(k, row, col):
        return k * np.log(np.maximum(k, 1e-12) * total / np.maximum(row * col, 1e-12))

    g = 2 * sum(info(counts[c], n_class[c], n) + info(rest[c], n_class[c], total - n) for c in (0, 1))
    return (n >= MIN_DOCS) & (g >= EVIDENCE)


class Model:
    """A fitted classifier: a weight for each bucket and an intercept. Its size doesn't depend on the data."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.wanted = weights, bias, weights != 0

    def scores(self, batch_texts: list[str]) -> np.ndarray:
        z = np.full(len(batch_texts), self.bias)
        for first, block in blocks_of(batch_texts):
            rows, buckets = present(block, self.wanted)
            z[first : first + len(block)] += np.bincount(rows, weights=self.weights[buckets], minlength=len(block))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, l2: float = 1e-3, steps: int = 100) -> Model:
    """Learn from the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks. Class counts by bucket are summed
    by tasks, a part of the buckets in each; the driver gets these sums and the telling buckets of the sample. Texts are not
    shuffled: the ids of the sample, at most `max_train`, go to them."""
    spark = docs.sparkSession
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = stored(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "toxic-ids")
    picked = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = stored(picked.repartition(TRAIN_TASKS), "toxic-sample")
    width = (1 << BITS) // PARTS

    def count(batches):
        counts, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        every = np.ones(1 << BITS, bool)
        for batch in slices(batches):
            all_texts, toxic = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64) > 0
            n += np.bincount(toxic, minlength=2)
            for first, block in blocks_of(all_texts):
                rows, buckets = present(block, every)
                for c in (0, 1):
                    counts[c] += np.bincount(buckets[toxic[first + rows] == c], minlength=1 << BITS).astype(np.int32)
        for p in range(PARTS):
            piece = counts[:, p * width : (p + 1) * width].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n.tobytes()]), pa.array([piece])], names=["part", "n", "counts"])

    def add(batches):
        total: dict[int, list] = {}
        for batch in slices(batches):
            for p, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                got = [np.frombuffer(n, np.int64), np.frombuffer(blob, np.int32)]
                total[p] = [a + b for a, b in zip(total[p], got)] if p in total else got
        for p, (n, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n.tobytes()]), pa.array([counts.tobytes()])], names=["part", "n", "counts"])

    schema = "part int, n binary, counts binary"
    n_class, counts = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int64)
    for row in sample.mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect():
        n_class = np.frombuffer(row["n"], np.int64)  # the same in all parts
        counts[:, row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.int32).reshape(2, -1)
    if n_class.min() == 0:
        drop_shared(spark, sample._stored_at)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((n_class[1] + 1) / (n_class[0] + 1))))
    shared = spark.sparkContext.broadcast(telling_buckets(counts, n_class))

    def select(batches):
        for batch in slices(batches):
            all_texts, out = batch.column(1).to_pylist(), []
            for _, block in blocks_of(all_texts):
                rows, buckets = present(block, shared.value)
                cuts = np.searchsorted(rows, np.arange(1, len(block)))
                out += [x.astype(np.int32).tobytes() for x in np.split(buckets, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.binary())], names=["toxic", "buckets"])

    got = sample.mapInArrow(select, "toxic int, buckets binary").collect()
    drop_shared(spark, sample._stored_at)
    each = [np.frombuffer(r["buckets"], np.int32) for r in got]
    labels = np.array([r["toxic"] > 0 for r in got], float)
    rows = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
    return Model(*fit(rows, np.concatenate(each), labels, log_ratios(counts, n_class), l2, steps))


def learnable(modulus: int = 4, held_out: int = 2):
    """Which rows may be learned from: all but those whose id falls in the held-out remainder."""
    return id_remainder(modulus) != held_out


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row: one pass without a shuffle; the model is a fixed 4 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in slices(batches):
            s = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that score below the threshold."""
    prepare(docs.sparkSession)
    shared, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scan(batches):
        for batch in slices(batches):
            s = shared.value.scores([t or "" for t in batch.column(where).to_pylist()])
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(scan, docs.schema)
