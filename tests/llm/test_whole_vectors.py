"""Clusters, vector codes: exact against brute force, with every awkward row."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from framewright.llm import clustering, vector_codes
from framewright.llm.integer_vectors import bound, packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, length int, v string, id string, codes int, cluster int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, 1, "x", "y", 2, 3) for i, v, label in rows], SCHEMA).repartition(parts)


def vectors(seed, n, dim=64, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) * spread).astype(np.float32).tolist()


def odd(rows, dim=64):
    """Null and short vectors, null and non-finite components, components beyond the bound."""
    v = vectors(99, 1, dim)[0]
    return rows + [(9001, None, 1), (9002, [], 1), (9003, v[:7], 1), (9004, [None, *v[1:]], 1), (9005, [math.nan, *v[1:]], None),
                   (9006, [math.inf, *v[1:]], 1), (9007, [-math.inf, *v[1:]], 1), (9008, [3e38, *v[1:]], 1)]


# --- packing ------------------------------------------------------------------------------------------------


def test_packed_rows(spark):
    rows = odd([(1, [0.1, -0.1, 2.0, -3.5], 1), (2, [1.0, 2.0], 2)], 4)
    got = {r["vec_id"]: r for r in packed(table(spark, rows), 256, ["vec_id", "label"]).collect()}
    assert set(got) == {1, 2, 9002, 9003}
    x = np.frombuffer(got[1]["v"], "<i4").tolist()
    assert x == [math.floor(256 * float(np.float32(a))) for a in (0.1, -0.1, 2.0, -3.5)] and got[1]["length"] == 4
    assert bytes(got[9002]["v"]) == b"" and {r["vec_id"] for r in packed(table(spark, rows), 256, ["vec_id"], length=4).collect()} == {1, 9003}


def test_bound_leaves_room():
    for length in (1, 8, 64, 768, 100_000):
        assert 4 * length * (2 * bound(length)) ** 2 < 1 << 63


def test_the_largest_components_are_exact(spark):
    big = bound(64) / 4096
    rows = [(i, [big if (i >> (k % 4)) & 1 else -big for k in range(64)], 0) for i in range(16)]
    codes, books = vector_codes.compress(table(spark, rows), entries=4, rounds=2)
    for r in codes.collect():
        x = [math.floor(4096 * (big if (r["id"] >> (k % 4)) & 1 else -big)) for k in range(64)]
        y = books.decode(64, np.frombuffer(r["codes"], np.uint8)[None])[0].tolist()
        assert r["error"] == sum((a - b) ** 2 for a, b in zip(x, y))


# --- clusters -----------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(np.float32(a))) for a in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(a is not None and abs(a) < 1e5 for a in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    first = sorted(kept, key=lambda r: (mark(r[0]), np.array(r[1], "<i4").tobytes()))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        for j, group in own.items():
            centroids[j] = [sum(column) // len(group) for column in zip(*group)]
    found = [(i, *nearest(v)) for i, v in kept]
    by = defaultdict(int)
    for _, d, j in found:
        by[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, by[j], sum(by.values()), sha[j]) for i, d, j in found]


def test_clusters_equal_brute_force_with_odd_rows_ties_and_repeats(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(1, 60))]
    rows += [(7, rows[7][1], 0), (None, rows[8][1], 0), (70, [0.0] * 64, 0), (71, [0.0] * 64, 0)]  # repeats, a null id, ties
    rows = odd(rows)
    got = clustering.cluster(table(spark, rows), k=9, rounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_clusters(rows, 9, 3)))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(2, 5))]
    got = clustering.cluster(table(spark, rows))
    assert {r["distance"] for r in got.collect()} == {0} and got.select("cluster").distinct().count() == 5
    assert clustering.cluster(table(spark, [(1, None, 0)])).count() == 0


def test_an_empty_cluster_stays():
    x = np.array([[10, 10], [12, 10], [100, 100]])
    best, d, _ = clustering.nearest(x, np.array([[0, 0], [11, 10], [11, 10], [100, 101]]))
    assert best.tolist() == [1, 1, 3] and d.tolist() == [1, 1, 1]


@pytest.mark.parametrize("scale", [3, 300, 40_000, 1 << 25])
def test_screening_never_loses_the_nearest(scale):
    """Where float32 can't tell two centroids apart, integers do; of equal ones the smallest number wins."""
    rng = np.random.default_rng(scale)
    base = rng.integers(-scale, scale + 1, (6, 64))
    centroids = np.concatenate([base, base + (rng.random((6, 64)) < 0.02), base])
    x = np.concatenate([base[rng.integers(0, 6, 300)] + rng.integers(-1, 2, (300, 64)), rng.integers(-scale, scale + 1, (300, 64))])
    best, d, opened = clustering.nearest(x, centroids)
    exact = ((x[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
    assert d.tolist() == exact.min(1).tolist()
    assert best.tolist() == [row.index(min(row)) for row in exact.tolist()]
    assert opened > 0


def test_intervals_hold_the_true_scores():
    rng = np.random.default_rng(5)
    for scale in (1, 1000, 1 << 24):
        x, c = rng.integers(-scale, scale + 1, (200, 64)), rng.integers(-scale, scale + 1, (40, 64))
        score = ((c.astype(np.float64) ** 2).sum(1).astype(np.float32)[None] - np.float32(2) * (x.astype(np.float32) @ c.astype(np.float32).T)).astype(object)
        true = (c.astype(object) ** 2).sum(1)[None] - 2 * (x.astype(object) @ c.astype(object).T)
        width = clustering.radius(np.sqrt((x.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1)), 64)
        assert all(abs(int(s) - t) <= w for s, t, w in zip(score.ravel(), true.ravel(), width.ravel()))


def test_most_rows_are_decided_by_screening():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.standard_normal((2000, 64))).astype(np.int64)
    assert clustering.nearest(x, x[:40])[2] < 0.02 * len(x)


# --- vector codes -------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    usable = lambda v: v is not None and all(a is not None and abs(a) < 1000 for a in v) and len(v) % parts == 0
    kept = [(i, label, [math.floor(scale * float(np.float32(a))) for a in v]) for i, v, label in rows if usable(v)]
    out, by_length = [], defaultdict(list)
    for r in kept:
        by_length[len(r[2])].append(r)
    for length, group in by_length.items():
        w = length // parts
        piece = lambda v, p: v[p * w : (p + 1) * w]
        first = sorted(group, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
        books = [[piece(v, p) for _, _, v in first] for p in range(parts)]

        def nearest(v, p):
            return min((sum((a - b) ** 2 for a, b in zip(piece(v, p), e)), j) for j, e in enumerate(books[p]))

        for _ in range(rounds):
            for p in range(parts):
                own = defaultdict(list)
                for _, _, v in group:
                    own[nearest(v, p)[1]].append(piece(v, p))
                for j, found in own.items():
                    books[p][j] = [sum(column) // len(found) for column in zip(*found)]
        sha = hashlib.sha256(",".join(str(a) for book in books for e in book for a in e).encode()).hexdigest()
        for i, label, v in group:
            best = [nearest(v, p) for p in range(parts)]
            out.append((i, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), sha))
    by = defaultdict(int)
    for _, label, _, d, _ in out:
        by[label] += d
    return [(i, code, d, by[label], sha) for i, label, code, d, sha in out]


def test_codes_equal_brute_force_with_odd_rows_ties_and_lengths(spark):
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors(3, 70))]
    rows += [(7, rows[7][1], 1), (None, rows[8][1], 2), (80, [0.0] * 64, 1), (81, [0.0] * 64, 1)]
    rows += [(100 + i, v, 4) for i, v in enumerate(vectors(4, 20, 16))]  # another length, with codebooks of its own
    rows = odd(rows)
    got = vector_codes.digest(table(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_codes(rows)))


def test_few_rows_and_none(spark):
    got = vector_codes.digest(table(spark, [(i, v, 0) for i, v in enumerate(vectors(5, 3))])).collect()
    assert sorted(r["code"] for r in got) == ["00" * 8, "01" * 8, "02" * 8] and {r["error"] for r in got} == {0}
    assert vector_codes.digest(table(spark, [(1, None, 0), (2, [1.0] * 7, 0)])).count() == 0


@pytest.mark.parametrize("start", ["zero", "any", "nearest"])
def test_the_search_looks_at_enough_entries(start):
    """From whatever entry it starts, ties and equal entries included."""
    rng = np.random.default_rng(7)
    entries = rng.integers(-40, 41, (16, 3))
    entries[9], entries[12] = entries[4], entries[4] + [1, 0, 0]
    x = np.concatenate([rng.integers(-60, 61, (800, 3)), entries, entries + 1])
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    at = {"zero": np.zeros(len(x), int), "any": rng.integers(0, 16, len(x)), "nearest": d.argmin(1)}[start]
    best, least, looked = vector_codes.Codebook(entries).search(x, at)
    assert best.tolist() == d.argmin(1).tolist() and least.tolist() == d.min(1).tolist()
    assert looked <= 17 * len(x)


def test_the_search_leaves_far_entries_out():
    rng = np.random.default_rng(8)
    entries = rng.integers(-100_000, 100_001, (64, 8))
    x = entries[rng.integers(0, 64, 3000)] + rng.integers(-900, 901, (3000, 8))
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    best, _, looked = vector_codes.Codebook(entries).search(x, d.argmin(1))
    assert best.tolist() == d.argmin(1).tolist() and looked < 3 * len(x)


def test_codes_decode_and_further_vectors_are_encoded(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(9, 50))]
    codes, books = vector_codes.compress(table(spark, rows), rounds=2)
    again = {r["id"]: (bytes(r["codes"]), r["error"]) for r in vector_codes.encode(table(spark, rows), books).collect()}
    assert again == {r["id"]: (bytes(r["codes"]), r["error"]) for r in codes.collect()}
    x = unpacked(packed(table(spark, rows[:1], 1), 4096, ["vec_id"]).toArrow().combine_chunks()["v"], 64)[0].astype(np.int64)
    y = books.decode(64, np.frombuffer(again[0][0], np.uint8)[None])[0]
    assert again[0][1] == int(((x - y) ** 2).sum())
