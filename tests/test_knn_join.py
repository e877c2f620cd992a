"""The join by cells against a cross join: row for row, with ties, hot cells, and figures of what was left out."""

import tracemalloc

import numpy as np
import pytest

from framewright.operators import knn, mlp
from framewright.operators.knn_join import Cells, nearest_by_cells, within

QUERY, BANK = "row_id long, label int, x array<double>", "ref_index long, z array<double>, label int"


def tables(spark, x, z):
    queries = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], QUERY).repartition(3)
    bank = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(z)], BANK).repartition(3)
    return queries, bank


def rows(df):
    return sorted((r["qid"], r["y"], r["rank"], r["ref_index"], r["label"], round(r["distance"], 9)) for r in df.collect())


def clustered(seed, n, centres=12, dim=6, spread=2):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).integers(-400, 401, (centres, dim))
    return (middle[rng.integers(0, centres, n)] + rng.integers(-spread, spread + 1, (n, dim))).astype(float)


def loose(seed, n, dim=6):
    return np.random.default_rng(seed).integers(-3, 4, (n, dim)).astype(float)


@pytest.mark.parametrize("make", [clustered, loose])
@pytest.mark.parametrize("k, block_rows, query_rows", [(1, 20_000, 20_000), (5, 40, 13), (7, 5, 3)])
def test_equals_the_cross_join_with_ties(spark, make, k, block_rows, query_rows):
    """Whole numbers: many distances are equal, and both ways compute them exactly."""
    queries, bank = tables(spark, make(1, 90), make(2, 400))
    got = nearest_by_cells(queries, bank, k, block_rows=block_rows, query_rows=query_rows)
    assert rows(got.neighbours) == rows(knn.nearest_by_expressions(queries, bank, k))


def test_normalized_vectors_and_the_way_of_large_banks(spark):
    queries, bank = tables(spark, clustered(3, 60) + 0.5, clustered(4, 300) + 0.25)
    want = rows(knn.nearest_by_expressions(queries, bank, 4, True))
    assert rows(knn.nearest(queries, bank, 4, True, broadcast_bytes=0)) == want == rows(knn.nearest(queries, bank, 4, True))


def test_one_hot_cell_and_equal_references(spark):
    """Two thirds of the bank are one vector: its cell is dealt over blocks, and ties go to the smallest indexes."""
    z = np.concatenate([np.zeros((200, 3)), clustered(5, 100, dim=3)])
    queries, bank = tables(spark, np.concatenate([np.zeros((50, 3)), clustered(6, 30, dim=3)]), z)
    got = nearest_by_cells(queries, bank, 3, block_rows=20, query_rows=7)
    assert rows(got.neighbours) == rows(knn.nearest_by_expressions(queries, bank, 3))


def test_few_references_repeated_queries_and_nothing(spark):
    queries, bank = tables(spark, loose(7, 20), loose(8, 4))
    queries = queries.unionByName(queries)
    got = nearest_by_cells(queries, bank, 9)
    assert rows(got.neighbours) == rows(knn.nearest_by_expressions(queries, bank, 9)) and got.neighbours.count() == 160
    assert nearest_by_cells(queries, bank.where("ref_index < 0"), 2) is None
    assert nearest_by_cells(queries.where("row_id < 0"), bank, 2).neighbours.count() == 0
    with pytest.raises(ValueError):
        nearest_by_cells(queries, bank, 0)
    with pytest.raises(Exception, match="length"):
        nearest_by_cells(queries.selectExpr("row_id", "label", "slice(x, 1, 2) as x"), bank, 1).neighbours.count()


def test_share_of_pairs_that_is_visited(spark):
    """With clusters most of the bank is left out; without structure in many dimensions hardly anything can be."""
    queries, bank = tables(spark, clustered(9, 200, 40), clustered(10, 2000, 40))
    some = nearest_by_cells(queries, bank, 5).work().first()
    assert some["n_queries"] == 200 and some["n_refs"] == 2000 and some["visited"] < 0.12
    rng = np.random.default_rng(11)
    queries, bank = tables(spark, rng.standard_normal((100, 48)), rng.standard_normal((1000, 48)))
    got = nearest_by_cells(queries, bank, 5)
    most = got.work().first()["visited"]
    assert 0.5 < most <= 1 and rows(got.neighbours) == rows(knn.nearest(queries, bank, 5))


def test_bounds_hold():
    """Every reference lies within the bounds that its cell gives, and k of them within the upper one."""
    for scale in (1e-6, 1.0, 1e6):
        rng = np.random.default_rng(12)
        z, x, k = rng.standard_normal((500, 5)) * scale, rng.standard_normal((200, 5)) * scale, 4
        cells = Cells(z[:25], k, float((z * z).sum(1).max()))
        of, radius = cells.nearest(z)
        for c in range(25):
            own = np.sort(radius[of == c])
            cells.size[c], cells.low[c], cells.high[c] = len(own), own[0], own[-1]
            cells.near[c, : min(k, len(own))] = own[:k]
        d = np.sqrt(((x[:, None] - z[None]) ** 2).sum(2))
        p, slack = cells.distances(x), cells.slack(x)
        lower = cells.lower(p, cells.nearest(x)[0], slack)
        for c in range(25):
            assert (d[:, of == c].min(1) >= lower[:, c]).all()
        assert (np.sort(d, 1)[:, k - 1] <= cells.upper(p + slack[:, None])).all()
        assert (lower > 0).mean() > 0.3


@pytest.mark.parametrize("k", [1, 4, 50])
def test_peaks_found_by_bounds_are_those_of_all_pairs(k):
    """Noise, of which the bound leaves out little, and narrow bands, of which it leaves out most; equal references too."""
    rng = np.random.default_rng(13)
    n = 32

    def bands(count, seed):
        r = np.random.default_rng(seed)
        place, phase = r.integers(0, n, count), r.uniform(0, 2 * np.pi, count)
        wave = np.exp(1j * (2 * np.pi * place[:, None] * np.arange(n) / n + phase[:, None])) + 0.02 * (r.standard_normal((count, n)) + 1j * r.standard_normal((count, n)))
        return np.concatenate([wave.real, wave.imag], 1)

    shares = []
    for q, z in ((rng.standard_normal((20, 2 * n)), rng.standard_normal((300, 2 * n))), (bands(20, 1), bands(300, 2))):
        z = knn._unit(np.concatenate([z, z[:5]]), 1e-8)
        ref, seen = np.arange(len(z)) * 3, 0
        f, s = np.fft.fft(knn.complex_rows(knn._unit(q, 1e-8))), np.conj(np.fft.fft(knn.complex_rows(z)))
        peaks = np.abs(np.fft.ifft(f[:, None] * s[None], axis=2)).max(2)
        for i, (near, d, n_seen) in enumerate(knn.best_circular(q, z, ref, k)):
            assert near.tolist() == np.lexsort((ref, -peaks[i]))[:k].tolist() and np.allclose(-d, peaks[i][near])
            seen += n_seen
        shares.append(seen / len(q) / len(z))
    assert shares[1] < shares[0] <= 1 and (k > 4 or shares[1] < 0.3)


@pytest.mark.parametrize("measure", list(knn.MEASURES))
def test_references_are_met_tile_by_tile(measure):
    """What is held for 256 queries stays far below the 120 MB of their rough distances to 60,000 references; ties over all tiles go to
    the smaller index."""
    rng = np.random.default_rng(21)
    z = knn._unit(np.repeat(rng.standard_normal((6000, 8)), 10, 0)[rng.permutation(60_000)], 1e-8)
    q, ref = rng.standard_normal((256, 8)), rng.permutation(60_000)
    known = knn.MEASURES[measure](z)
    tracemalloc.start()
    row, pos, rank, d = knn.best_of_block(q, known, ref, 25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and row.tolist() == np.repeat(np.arange(256), 25).tolist() and rank.tolist() == list(range(1, 26)) * 256
    for one in (0, 255):
        every = known.exact(np.full(len(z), one), np.arange(len(z)))
        want = np.lexsort((ref, every))[:25]
        assert pos[row == one].tolist() == want.tolist() and d[row == one].tolist() == every[want].tolist()


def test_circular_peaks_of_long_frames():
    rng = np.random.default_rng(22)
    z, q = knn._unit(rng.standard_normal((90, 300)), 1e-8), rng.standard_normal((7, 300))
    row, pos, _, d = knn.best_of_block(q, knn.Circular(z), np.arange(90), 4)
    for one, (near, want, _) in enumerate(knn.best_circular(q, z, np.arange(90), 4)):
        assert pos[row == one].tolist() == near.tolist() and np.allclose(d[row == one], want)


def test_verified_share_of_circular_peaks(spark):
    queries, bank = tables(spark, loose(14, 9, 8), loose(15, 70, 8))
    got = knn.circular_work(queries, bank, 2).first()
    assert got["pairs"] == 630 and 0 < got["verified"] <= 630
    assert knn.circular_work(queries, bank.where("ref_index < 0")).first()["pairs"] == 0


def test_a_cell_of_copies_takes_bounded_memory():
    """All pairs of 256 queries and 20,000 equal references are as near as the nearest: they are met tile by tile."""
    q, z = np.ones((300, 4)), np.ones((20_000, 4))
    ref = np.arange(len(z))[::-1].copy()
    tracemalloc.start()
    row, pos, d = within(q, z, ref, np.full(len(q), np.inf), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert row.tolist() == np.repeat(np.arange(300), 3).tolist() and set(ref[pos].tolist()) == {0, 1, 2} and not d.any()


def test_latents_that_all_fall_together_take_bounded_memory():
    """A network that maps every frame to one point makes all references of a broadcast bank as near as the nearest: rough distances alone
    would be 80 MB for 256 queries."""
    z = mlp.by_rule([64, 16, 8]).forward(np.zeros((40_000, 64)))
    ref = np.arange(len(z))[::-1].copy()
    known = knn.Euclidean(z)
    tracemalloc.start()
    row, pos, rank, d = knn.best_of_block(z[:300], known, ref, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6
    assert row.tolist() == np.repeat(np.arange(300), 5).tolist() and rank.tolist() == [1, 2, 3, 4, 5] * 300
    assert ref[pos].tolist() == [0, 1, 2, 3, 4] * 300 and not d.any()


def test_tiles_find_the_nearest_within_the_limit():
    rng = np.random.default_rng(4)
    q, z, ref = rng.integers(-3, 4, (300, 3)).astype(float), rng.integers(-3, 4, (5000, 3)).astype(float), rng.permutation(5000)
    limit = np.where(np.arange(300) % 3 == 0, np.inf, rng.integers(0, 3, 300).astype(float))
    row, pos, d = within(q, z, ref, limit, 4)
    for i in range(300):
        far = np.sqrt(((z - q[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((ref, far))[:4] if far[j] <= limit[i]]
        assert pos[row == i].tolist() == want and d[row == i].tolist() == far[want].tolist()
