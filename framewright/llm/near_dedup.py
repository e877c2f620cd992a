"""Near-duplicates by MinHash and a multi-index Hamming join.

A document's set of word shingles gives a signature of b-bit symbols (b = 16), one per MinHash function.
Signatures are cut into chunks of `CHUNK` symbols, and for each chunk every way to ignore `ERRORS` of its symbols
makes a key. By the pigeonhole principle two signatures that differ in fewer than
chunks * (ERRORS + 1) symbols share a key: all pairs under that distance are found. The number of chunks is chosen so that a
pair at the similarity threshold shares no key with a chance below `MISS`. Pairs that share a key are compared by their whole
signatures and by a finer sketch, the smallest hash in each of `BINS` ranges. Those no farther apart in either than a pair at the
threshold is, but with a chance below `MISS`, are confirmed on the full sets: signatures alone would let pass so many pairs of
a large group of half similar texts that their number grew with the square of its size.

Skew: equal sets are one class from the start. In a key's bucket, members are first compared with the bucket's
smallest member only (a star over all buckets of that member); components of these links are found; only then, in stars
that still hold several components, are pairs of *different* components compared by signature, in blocks of bounded size. So
neither the copies of a text nor the members of a large group are expanded into pairs, and no link that could
join two components is left out.

Only texts of classes that share a key with another are moved: a scan keeps them, against a broadcast list where its counted
size allows, and by a shuffle join beyond that.

Null or empty texts have no set and link with nothing; rows with a null id link with nothing either. Repeated rows
share their class; an id with several texts keeps the links of each and so connects them. Very long texts are hashed in
blocks, and are one row throughout; pairs at the threshold link. An empty table gives no row; columns other than id and text, of
whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, distinct, drop_shared, lower_ascii_words, slices, stored, texts
from .components import components

CHUNK, ERRORS, MISS, BLOCK = 6, 1, 1e-6, 1024
BINS, DEVIATIONS = 512, 5
MEMO_WORDS = 400_000
#: Rows of keys that are sent to every task at most (about 50 MB there).
BROADCAST_ROWS = 500_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int, memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words are none."""
    words = lower_ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        rolled = mixed(rolled * _M2 + h[k : k + n]) if k else h[:n].copy()
    return distinct(mixed(rolled + np.uint64(len(h) if len(h) < size else size)))


class Plan:
    """Sizes that follow from the similarity threshold (per cent)."""

    def __init__(self, percent: int):
        j = percent / 100
        kept = sum(math.comb(CHUNK, e) * (1 - j) ** e * j ** (CHUNK - e) for e in range(ERRORS + 1))
        self.percent = percent
        self.chunks = max(2, math.ceil(math.log(MISS) / math.log(1 - kept)))
        self.symbols = CHUNK * self.chunks
        # symbols that differ in a pair at the threshold: more than `most` with a chance below MISS
        tail, self.most = 1.0, -1
        while tail >= MISS:
            self.most += 1
            tail -= math.comb(self.symbols, self.most) * (1 - j) ** self.most * j ** (self.symbols - self.most)
        self.width = 2 * self.symbols + BINS
        rng = np.random.default_rng(20240517)
        self.a = rng.integers(0, 1 << 32, self.symbols, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.symbols, dtype=np.uint32)
        self.left_out = [c * CHUNK + i for c in range(self.chunks) for i in range(CHUNK)]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.symbols, 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 20_000):
            low = np.minimum(low, (x[at : at + 20_000, None] * self.a + self.b).min(0))
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """For each of equal ranges of hashes a byte of the smallest hash in it, 0 where there is none."""
        shift, ranges = np.uint64(64 - BINS.bit_length() + 1), np.arange(BINS, dtype=np.uint64)
        at = np.searchsorted(shingles, ranges << shift)
        first = shingles[np.minimum(at, len(shingles) - 1)]
        full = (at < len(shingles)) & (first >> shift == ranges)
        return np.where(full, first % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)

    def near(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Which pairs may reach the threshold: by their sizes, exactly; by how many symbols of their signatures differ; and by
        the ranges of their sketches that differ, as many as a sample without replacement from a union at the threshold would
        show. Rows of `a` and `b`: signature, then sketch, as bytes."""
        j, width = self.percent / 100, 2 * self.symbols
        out = 100 * np.minimum(size_a, size_b) >= self.percent * np.maximum(size_a, size_b)
        at = np.flatnonzero(out)
        differ = (a[at, :width] != b[at, :width]).reshape(len(at), -1, 2).any(2).sum(1)
        out[at] = differ <= self.most
        at = at[out[at]]
        one, two = a[at, width:], b[at, width:]
        used = ((one | two) != 0).sum(1)
        union = np.maximum(2, (size_a[at] + size_b[at]) / (1 + j))
        spread = np.sqrt(used * j * (1 - j) * np.maximum(0, union - used) / (union - 1))
        out[at] = (one != two).sum(1) <= used * (1 - j) + DEVIATIONS * spread + 1
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, keys): per chunk and left-out symbol, the hash of the chunk's other symbols and their place."""
        out = []
        for c in range(self.chunks):
            part = signatures[:, c * CHUNK : (c + 1) * CHUNK].astype(np.uint64)
            for i in range(CHUNK):
                h = np.full(len(part), c * CHUNK + i + 1, np.uint64)
                for k in range(CHUNK):
                    if k != i:
                        h = mixed(h * _M2 + part[:, k])
                out.append(h)
        return np.stack(out, 1).view(np.int64)


def features(docs: DataFrame, shingle: int, plan: Plan) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, print, signature); h1 and h2 identify the text; print: 128 bits of the whole set, null for
    an empty one; the sketch's bytes follow the signature's."""

    def scan(batches):
        memo = Memo(word_hash, MEMO_WORDS)
        for batch in slices(batches):
            sizes, prints, signatures = [], [], []
            for text in batch.column(3).to_pylist():
                s = shingle_set(text, shingle, memo)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(plan.signature(s).tobytes() + plan.sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, signatures))],
                names=["doc_id", "h1", "h2", "n_shingles", "print", "signature"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    return rows.mapInArrow(scan, "doc_id long, h1 long, h2 long, n_shingles long, print binary, signature binary")


def _as_matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def key_rows(classes: DataFrame, plan: Plan) -> DataFrame:
    """(key, rep) of every class, a row for each of its keys."""

    def scan(batches):
        for batch in slices(batches):
            k = plan.keys(np.ascontiguousarray(_as_matrix(batch.column(1), plan.width)[:, : 2 * plan.symbols]).view("<u2"))
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(rep, pa.int64())], names=["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(scan, "key long, rep long")


def close_pairs(pairs: DataFrame, signatures: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their signatures."""

    def scan(batches):
        for batch in slices(batches):
            if batch.num_rows:
                of = [_as_matrix(batch.column(i), plan.width) for i in (2, 3)]
                sizes = [batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(plan.near(*of, *sizes)))

    one = signatures.select(F.col("rep").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = signatures.select(F.col("rep").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    fits = F.lit(100) * F.least("na", "nb") >= F.lit(plan.percent) * F.greatest("na", "nb")
    both = pairs.join(one, "a").join(two, "b").where(fits)
    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(scan, "a long, b long")


def hinted(keys: DataFrame) -> DataFrame:
    """Keys to be joined with a table of texts: sent to the texts where their counted size allows, else both are shuffled."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys.hint("merge")


def texts_of(docs: DataFrame, classes: DataFrame, used: DataFrame) -> DataFrame:
    """(rep, text): one text of each class that `used` (rep) names."""
    wanted = stored(classes.join(used, "rep", "left_semi").select("rep", "h1", "h2"), "wanted")
    rows = docs.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    # of a text's copies each task keeps one before anything is shuffled
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = rows.join(F.broadcast(wanted), ["h1", "h2"]).groupBy("rep").agg(F.first("text").alias("text"))
    else:
        own = rows.groupBy("h1", "h2").agg(F.first("text").alias("text")).join(wanted.hint("merge"), ["h1", "h2"]).select("rep", "text")
    return stored(own, "pair-texts", "zstd")


def confirmed(pairs: DataFrame, own: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def scan(batches):
        memo, last, last_set = Memo(word_hash, MEMO_WORDS), None, None
        for batch in slices(batches):
            keep = []
            for b, ta, tb in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if b != last:
                    last, last_set = b, shingle_set(tb, shingle, memo)
                s = shingle_set(ta, shingle, memo)
                at = np.searchsorted(last_set, s)
                both = int((last_set[np.minimum(at, len(last_set) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(last_set) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = own.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = own.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(scan, "u long, v long"), "links")


def crossing_pairs(stars: DataFrame, signatures: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """Pairs that may reach the threshold, among members of a star but in different components; large stars in blocks.
    Members of a bucket all belong to the star of its smallest member, so no pair with a common key is left out."""
    labelled = stars.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_stars = labelled.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = (
        labelled.join(open_stars.select("hub", blocks.alias("blocks")), "hub")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")
        .join(signatures, "rep")
        .select("hub", "i", "j", "block", "rep", "component", "n_shingles", "signature")
    )

    def group(rep, block, component, size, signature):
        """Arrays of the pairs of two blocks, some at a time."""
        cross = (block != block[0]).any()
        for at in range(0, len(rep) - 1, 64):
            end = min(at + 64, len(rep))
            differ = component[at:end, None] != component[None, at:]
            differ &= np.arange(at, end)[:, None] < np.arange(at, len(rep))[None, :]
            differ &= 100 * np.minimum(size[at:end, None], size[None, at:]) >= plan.percent * np.maximum(size[at:end, None], size[None, at:])
            if cross:
                differ &= block[at:end, None] != block[None, at:]
            x, y = (k + at for k in np.nonzero(differ))
            for k in range(0, len(x), 20_000):
                a, b = x[k : k + 20_000], y[k : k + 20_000]
                near = plan.near(signature[a], signature[b], size[a], size[b])
                if near.any():
                    a, b = rep[a[near]], rep[b[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def scan(batches):
        held = None

        def pairs_of(columns, ends):
            for a, b in zip([0, *ends[:-1]], ends):
                yield from group(*(c[a:b] for c in columns[3:]))

        for batch in slices(batches):
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 3, 5, 6)]
            new.append(_as_matrix(batch.column(7), plan.width))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            if len(cut):
                yield from pairs_of(held, cut.tolist())
                held = [c[cut[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield from pairs_of(held, [len(held[0])])

    dealt = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return dealt.mapInArrow(scan, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    plan, docs = Plan(percent), texts(docs, id_col, text_col)
    each = stored(features(docs, shingle, plan), "shingles")
    linkable = each.where("print is not null and doc_id is not null")
    one_text = F.min(F.struct("h1", "h2")).alias("text")
    classes = linkable.groupBy("print").agg(F.min("doc_id").alias("id"), one_text, *(F.first(c).alias(c) for c in ("n_shingles", "signature")))
    # numbers follow ids, so that an original whose copies came later is the smallest member of most buckets
    classes = classes.orderBy("id", "print").select(F.monotonically_increasing_id().alias("rep"), "print", "id", "text.h1", "text.h2", "n_shingles", "signature")
    classes = stored(classes, "classes")
    signatures = classes.select("rep", "n_shingles", "signature")
    keys = key_rows(classes, plan)
    buckets = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("key", "hub")
    stars = stored(keys.join(buckets, "key").where("rep > hub").select("hub", "rep").distinct(), "stars")
    own = texts_of(docs, classes, stars.select("rep").unionByName(stars.select(F.col("hub").alias("rep"))).distinct())
    links = confirmed(close_pairs(stars.select(F.col("rep").alias("a"), F.col("hub").alias("b")), signatures, plan), own, shingle, percent)
    # an id that stands for several sets connects them
    owners = linkable.join(classes.select("print", "rep"), "print").select("doc_id", "rep").distinct()
    several = owners.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).where("u < top").select("doc_id", "u")
    same_id = several.join(owners, "doc_id").where("rep > u").select("u", F.col("rep").alias("v"))
    links = stored(links.unionByName(same_id), "all-links")
    found = stored(components(links), "components")
    more = confirmed(crossing_pairs(stars, signatures, found, plan), own, shingle, percent)
    if not more.isEmpty():
        found = stored(components(links.unionByName(more)), "components")
    drop_shared(docs.sparkSession, own._stored_at)
    merged = classes.select("print", "id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    merged = stored(merged.select("print", "id", F.coalesce("component", "rep").alias("component")), "merged")
    smallest = merged.groupBy("component").agg(F.min("id").alias("of_class"))
    merged = merged.join(smallest, "component").select("print", "of_class")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.coalesce("of_class", "doc_id"))
    return (
        each.select("doc_id", "n_shingles", "print").join(merged, "print", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
