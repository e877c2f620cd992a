"""The quantised bank: estimates by definition, exact with enough re-ranking, recall and bytes with little."""

import tracemalloc

import numpy as np
import pytest

from framewright import scratch
from framewright.operators import knn, quantized


def bank(spark, z, parts=3):
    return spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(z)], "ref_index long, z array<double>, label int").repartition(parts)


def asked(spark, x):
    return spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "row_id long, label int, x array<double>").repartition(2)


def rows(df):
    return sorted((r["qid"], r["y"], r["rank"], r["ref_index"], r["label"], round(r["distance"], 9)) for r in df.collect())


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(50).standard_normal((40, dim)) * 3
    return middle[rng.integers(0, 40, n)] + rng.standard_normal((n, dim))


def test_codes_and_estimates_by_definition():
    rng = np.random.default_rng(1)
    books = quantized.Codebooks([rng.standard_normal((7, 3)) for _ in range(4)])
    x, q = rng.standard_normal((50, 12)), rng.standard_normal((5, 12))
    codes = books.encode(x)
    y = books.decode(codes)
    for p in range(4):
        cut = slice(3 * p, 3 * p + 3)
        assert (codes[:, p] == ((x[:, None, cut] - books.entries[p][None]) ** 2).sum(2).argmin(1)).all()
    assert np.allclose(books.estimates(books.tables(q), codes), ((q[:, None] - y[None]) ** 2).sum(2))
    assert books.bytes() == 4 * 7 * 3 * 4


def test_with_all_re_ranked_it_is_exact(spark):
    b, q = bank(spark, np.round(clustered(2, 200))), asked(spark, np.round(clustered(3, 30)))
    books = quantized.fit(b, 4, 8, 3)
    coded = scratch.written(quantized.encode(b, books), "codes")
    want = rows(knn.nearest_by_expressions(q, b, 5))
    assert rows(quantized.nearest(q, b, coded, books, 5, 200)) == want
    assert rows(quantized.nearest(q, b, coded, books, 5, 200, broadcast_bytes=0, block_rows=37)) == want


def test_blocks_give_what_a_broadcast_gives_and_recall_is_high(spark):
    b, q = bank(spark, clustered(4, 3000)), asked(spark, clustered(5, 60))
    books = quantized.fit(b, 8, 32, 4, sample=1500)
    coded = scratch.written(quantized.encode(b, books), "codes")
    one = quantized.nearest(q, b, coded, books, 10, 60)
    assert rows(one) == rows(quantized.nearest(q, b, coded, books, 10, 60, broadcast_bytes=0, block_rows=800))
    got = quantized.recall(one, knn.nearest(q, b, 10)).first()
    assert got["total"] == 600 and got["recall"] >= 0.9
    assert coded.count() * 8 + books.bytes() < 3000 * 16 * 4 / 6


def test_repeated_queries_few_references_and_nothing(spark):
    b, q = bank(spark, clustered(6, 3)), asked(spark, clustered(7, 4))
    books = quantized.fit(b, 4, 256, 2)
    coded = quantized.encode(b, books)
    got = quantized.nearest(q.unionByName(q), b, coded, books, 5, 10)
    assert got.count() == 2 * 4 * 3 and rows(got) == rows(knn.nearest_by_expressions(q.unionByName(q), b, 5))
    assert quantized.nearest(q, b.where("ref_index < 0"), coded.where("ref_index < 0"), books, 1).count() == 0
    assert quantized.nearest(q.where("row_id < 0"), b, coded, books, 1).count() == 0


def test_lengths_that_do_not_fit_are_errors(spark):
    b = bank(spark, clustered(8, 5))
    with pytest.raises(ValueError, match="divides"):
        quantized.fit(b, 5)
    with pytest.raises(ValueError, match="byte"):
        quantized.fit(b, 4, 300)
    books = quantized.fit(b, 4, 4, 1)
    with pytest.raises(Exception, match="length"):
        quantized.encode(bank(spark, clustered(9, 2, 8)), books).count()
    with pytest.raises(ValueError, match="rerank"):
        quantized.nearest(asked(spark, clustered(9, 2)), b, quantized.encode(b, books), books, 5, 3)


def test_with_all_re_ranked_no_pair_is_written(spark):
    b, q = bank(spark, clustered(10, 60)), asked(spark, clustered(11, 9))
    books = quantized.fit(b, 4, 8, 2)
    got = quantized.nearest(q, b, scratch.written(quantized.encode(b, books), "codes"), books, 5, 1 << 20)
    assert "estimate" not in got._jdf.queryExecution().toString()
    assert rows(got) == rows(knn.nearest_by_expressions(q, b, 5))


def test_estimates_are_held_by_tiles():
    """Of 64 x 150,000 estimates, 77 MB, a tile at a time; ties go to the smaller index over all tiles."""
    rng = np.random.default_rng(12)
    books = quantized.Codebooks([rng.integers(0, 3, (4, 2)).astype(float) for _ in range(4)])
    codes, ref, q = rng.integers(0, 4, (150_000, 4)).astype(np.uint8), rng.permutation(150_000), rng.integers(0, 3, (64, 8)).astype(float)
    keys = [np.arange(64), np.arange(64), np.arange(64)]
    tracemalloc.start()
    got = quantized._guess(books, keys, q, codes, ref, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    found = got.column(3).to_numpy().reshape(64, 40)
    for i, row in enumerate(books.estimates(books.tables(q[:3]), codes)):
        assert found[i].tolist() == ref[np.lexsort((ref, row))[:40]].tolist()
