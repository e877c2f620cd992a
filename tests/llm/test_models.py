"""Near-duplicates, vectors, toxicity, language model and pipeline, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from framewright.llm import ann, components, context_mixing, embedding_dedup, language_model, near_dedup, toxicity, vectors, word_mixing
from tests.llm.helpers import documents, no_documents, odd_documents, odd_rows, prose

RNG = np.random.default_rng(8)


# components


def smallest_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40, 60)] + [(0, k) for k in range(100, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (5, 3), (3, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == smallest_reachable({n for e in real for n in e}, real)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# near-duplicates


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def expected(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return smallest_reachable({i for i, _ in sets}, edges)


def varied(seed, n, changes):
    words, rng = prose(seed, n).split(), random.Random(seed * 1000 + changes)
    for k in rng.sample(range(n), changes):
        words[k] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, percent):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # buckets of several blocks
    texts = [varied(s, 120, c) for s in range(6) for c in (0, 1, 2, 3, 4, 5, 6, 8, 12)]
    texts += [varied(77, 90, 2 + k % 3) + f" end{k}" for k in range(25)] + [texts[0]] * 4 + [texts[0].upper(), "", "a b", "A  b", "b a", "solo"]
    random.Random(1).shuffle(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents(spark, texts), size, percent).collect()}
    want = expected(list(enumerate(texts)), size, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(shingles(texts[i], size)) for i, r in got.items())


def test_ids_with_several_texts_lose_no_link(spark):
    one, two, three = varied(1, 100, 0), varied(2, 100, 0), varied(3, 100, 0)
    rows = [(5, one), (5, two), (7, two + " more"), (9, one + " extra"), (3, three), (11, three + " end"), (11, one), (20, varied(9, 100, 0))]
    got = [(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()]
    assert sorted(got) == sorted((i, 20 if i == 20 else 3) for i, _ in rows)


def test_texts_are_found_by_shuffle_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = [varied(s, 80, c) for s in range(4) for c in (0, 1, 2)] + [varied(1, 80, 0)] * 5
    want = near_dedup.near_duplicates(documents(spark, texts), 3, 85).collect()
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, near_dedup.near_duplicates(documents(spark, texts), 3, 85).collect())) == sorted(map(tuple, want))


def test_near_duplicates_of_awkward_rows(spark):
    got = near_dedup.near_duplicates(odd_documents(spark), 3, 85).collect()
    want = expected([(i, t) for i, t, *_ in odd_rows()], 3, 85)
    assert len(got) == len(odd_rows()) and all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


def test_pigeonhole_guarantee():
    plan = near_dedup.Plan(85)
    base = RNG.integers(0, 1 << 16, (1, plan.symbols)).astype("<u2")
    for _ in range(50):
        other = base.copy()
        at = RNG.choice(plan.symbols, plan.chunks * (near_dedup.ERRORS + 1) - 1, replace=False)
        other[0, at] ^= 1
        assert set(plan.keys(base)[0]) & set(plan.keys(other)[0])


# vectors


VECTORS = "vec_id long, embedding array<float>, label int, n long, v string"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, [None, 1.0, 0.0]), (6, [2.0, 0.0, 0.0]),
            (7, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (9, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (40, None)]
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS)


def table(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v], 0, 0, "") for i, v in enumerate(x)], VECTORS)


def test_neighbours_recall_ties_and_scores(spark, monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 500)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    x = rng.standard_normal((1500, 24)).astype(np.float32) * rng.uniform(0.5, 1.5, (1500, 1)).astype(np.float32)
    x[700:760] = x[0]
    df = table(spark, x)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d, hits = x.astype(float), 0
    for q in range(0, 1500, 20):
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(s == pytest.approx(d[q] @ d[v], abs=1e-12) for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        score = d @ d[q]
        score[q] = -np.inf
        hits += sum(s >= np.sort(score)[-20] - 1e-9 for _, _, s in own)
    assert hits / (75 * 20) >= 0.9
    assert [v for _, v, _ in sorted(got[0])] == list(range(700, 720))


def test_neighbours_of_awkward_rows(spark):
    df = odd_vectors(spark)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()]
    assert sorted(got) == [(0, 1, 6, 2.0), (0, 2, 7, 1.0), (0, 3, 7, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 6, 0.0), (20, 3, 7, 0.0), (20, 4, 7, 0.0)]
    none = spark.createDataFrame([], VECTORS)
    assert ann.nearest(none, none, 20).count() == 0


def test_rows_that_share_a_query_s_id_are_candidates(spark):
    """Only the query's own row isn't: another vector of its id is, and so is a repeat of the row, and each asks for itself."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (3, [2.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], VECTORS)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect())
    one = [(0, 1, 3, 2.0), (0, 2, 0, 0.0), (0, 3, 0, 0.0)]
    other = [(0, 1, 0, 1.0), (0, 2, 3, 0.5), (0, 3, 0, 0.0)]
    assert got == sorted(one + other + other)


def test_vector_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    centres = RNG.standard_normal((30, 16))
    x = np.concatenate([RNG.standard_normal((400, 16)), centres[RNG.integers(0, 30, 150)] + 0.12 * RNG.standard_normal((150, 16)), np.repeat(centres[:1], 90, 0) + 0.05 * RNG.standard_normal((90, 16)), np.repeat(centres[1:2], 30, 0)])
    x = (x * RNG.uniform(0.2, 5, (len(x), 1))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    want = smallest_reachable(range(len(x)), np.argwhere(links).tolist())
    got = embedding_dedup.embedding_duplicates(table(spark, x)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (int(links[i].sum()), want[i], want[i] == i) for i in range(len(x))}


def test_vector_duplicates_of_awkward_rows(spark):
    got = sorted(map(str, embedding_dedup.embedding_duplicates(odd_vectors(spark)).collect()))
    by = {}
    for r in embedding_dedup.embedding_duplicates(odd_vectors(spark)).collect():
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert len(got) == 13 and by[0] == [(3, 0)] and by[6] == [(3, 0)] and by[7] == [(3, 0)] * 2
    assert all(by[i] == [(0, i)] for i in (1, 2, 3, 4, 5, 9, 20, 40)) and by[None] == [(0, None)]
    assert embedding_dedup.embedding_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_and_verified_share_of_the_index():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.BlockIndex(np.arange(len(x)), x, 1 + 1e-9, ann.VERIFY)
    hits = 0
    for q in range(60):
        score = x @ x[q]
        score[q] = -np.inf
        hits += (index.search(x[q], q, 20)[1] >= np.sort(score)[-20] - 1e-12).sum()
    assert hits >= 0.9 * 60 * 20 and index.verified <= 0.07 * 60 * len(x)


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    long, short = rng.standard_normal((45, 6)), rng.standard_normal((30, 3))
    long[41], short[22] = long[40] * 2, short[20] * 3
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(long)] + [(100 + i, [float(a) for a in v]) for i, v in enumerate(short)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    of = dict(rows)
    # the queries' commonest length is not the table's
    asked = df.where("vec_id in (0, 100, 120)")
    got = {}
    for r in ann.nearest(df, asked, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 100, 120):
        want = sorted((-float((np.array(v) * np.array(of[q])).sum()), i) for i, v in rows if i != q and len(v) == len(of[q]))[:20]
        assert [(i, pytest.approx(-s)) for s, i in want] == [(i, s) for _, i, s in sorted(got[q])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert found[41] == (1, 40) and found[122][1] == found[120][1] <= 120 and found[122][0] >= 1 and found[0] == (0, 0) and len(found) == 75


def test_large_doubles_keep_their_precision(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [3.0000000001, -3.0]), (3, [-1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in ann.nearest(df, df.where("vec_id = 2"), 5).collect()}
    assert got[0] == pytest.approx(3.0000000001e200) and got[3] == pytest.approx(-6.0000000001e-300, rel=1e-12)
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert found == {0: 1, 1: 1, 2: 0, 3: 0}


def test_leaves_are_bounded_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 40)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    centres = RNG.standard_normal((40, 32))
    x = np.concatenate([RNG.standard_normal((900, 32)), centres[RNG.integers(0, 40, 200)] + 0.1 * RNG.standard_normal((200, 32))]).astype(np.float32)
    df = table(spark, x).select("vec_id", vectors.F.col("embedding").cast("array<double>").alias("v"))
    classes = df.select(vectors.F.col("vec_id").alias("rep"), vectors.F.lit(1).cast("long").alias("weight"), "v")
    first = embedding_dedup.first_places(classes, 0.95)
    placed = embedding_dedup.split_large(first, 0.95)
    size = {}
    for r in placed.collect():
        for h in r["homes"]:
            size[h] = size.get(h, 0) + 1
    assert max(size.values()) <= 40
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    got = embedding_dedup.embedding_duplicates(table(spark, x)).collect()
    assert all(r["n_links"] <= links[r["vec_id"]].sum() for r in got)
    assert sum(r["n_links"] for r in got) >= 0.97 * links.sum()


def test_usable_vectors(spark):
    assert sorted(r["vec_id"] for r in vectors.usable(odd_vectors(spark)).collect()) == [0, 6, 7, 7, 9, 20]


# toxicity


def labelled(spark, n):
    rows = [(i, prose(i, 40) + (" you pathetic idiot" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, toxic int, quality int")


def test_classifier_on_held_out_documents(spark):
    docs, labels = labelled(spark, 400)
    model = toxicity.train(docs, labels.where(toxicity.learnable()))
    rows = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held", toxicity.id_remainder(4) == 2).where("held").collect()
    assert len(rows) > 50 and all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in rows)
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i in range(400) if i % 5}


def test_classifier_sees_the_end_of_long_texts(spark):
    docs, labels = labelled(spark, 300)
    model = toxicity.train(docs, labels)
    long = prose(5, 60_000)
    assert model.scores([long, long + " pathetic idiot"])[1] > model.scores([long])[0]
    assert np.allclose(model.scores([long, "x"]), [model.scores([long])[0], model.scores(["x"])[0]])


def test_ngrams_do_not_cross_texts():
    for n_total, one, two in ((5, "ab", "cd"), (8, "", "é猫")):
        both = [(b.tolist(), o.tolist()) for b, o in toxicity.hashed_ngrams([one, two])]
        single = [[b.tolist() for b, _ in toxicity.hashed_ngrams([t])] for t in (one, two)]
        for k, (b, o) in enumerate(both):
            assert [x for x, w in zip(b, o) if w == 0] == single[0][k] and [x for x, w in zip(b, o) if w == 1] == single[1][k]


def test_classifier_on_awkward_rows(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd_documents(spark), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(no_documents(spark), model).count() == 0
    one_class = toxicity.train(docs, labels.where("toxic = 0"))
    assert one_class.scores(["anything"])[0] < 0.01
    nothing = toxicity.train(docs, labels.limit(0))
    assert nothing.scores([""])[0] == 0.5


def slow_model(rows, l2=1e-3, steps=100):
    """Counts, ratios, features and weights again, with dictionaries over n-grams instead of hashed arrays."""
    grams = [{" ".join([str(n), (" " + t.lower() + " ")[k : k + n]]) for n in toxicity.SIZES for k in range(len(t) + 3 - n)} for t, _ in rows]
    y = np.array([c for _, c in rows], float)
    n_class = np.array([(y == 0).sum(), (y == 1).sum()])
    counts = {}
    for g, c in zip(grams, y):
        for w in g:
            counts.setdefault(w, [0, 0])[int(c)] += 1

    def g2(k):
        table = np.array([k, n_class - k], float)
        want = np.outer(table.sum(1), n_class) / n_class.sum()
        return 2 * (table[table > 0] * np.log(table[table > 0] / want[table > 0])).sum()

    used = sorted(w for w, k in counts.items() if sum(k) >= toxicity.MIN_DOCS and g2(np.array(k)) >= toxicity.EVIDENCE)
    ratio = np.array([np.log((counts[w][1] + 1) / (n_class[1] + 2) * (n_class[0] + 2) / (counts[w][0] + 1)) for w in used])
    x = np.array([[w in g for w in used] for g in grams]) * ratio
    w, b = np.zeros(len(used)), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m = v = np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = np.append(x.T @ error / len(y) + l2 * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return lambda text: 1 / (1 + np.exp(-(b + sum(weight * r for g, weight, r in zip(used, w, ratio) if g.split(" ", 1)[1] in " " + text.lower() + " "))))


def test_classifier_equals_a_second_computation(spark):
    rows = [(prose(i, 12) + (" pathetic" if i % 4 == 0 else "") + (" idiot" if i % 8 == 1 else ""), int(i % 4 == 0)) for i in range(48)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(rows)], "doc_id long, toxic int")
    model, slow = toxicity.train(docs, labels), slow_model(rows)
    texts = [t for t, _ in rows] + ["", "pathetic words", prose(99, 30)]
    assert np.allclose(model.scores(texts), [slow(t) for t in texts], atol=2e-3)


def test_of_several_texts_of_a_labelled_id_the_smallest_is_learned(spark):
    docs, labels = labelled(spark, 60)
    more = docs.unionByName(docs.where("doc_id % 5 = 0").selectExpr("doc_id", "concat('zz ', text) text"))
    assert np.array_equal(toxicity.train(docs, labels).weights, toxicity.train(more, labels).weights)


# language model


def spelling_model(words, bits=16):
    code = context_mixing.Code(np.bincount(np.frombuffer(b" ".join(words) + b" ", np.uint8), minlength=256))
    counts = np.zeros((len(context_mixing.ORDERS), 2 << bits), np.int32)
    context_mixing.count(words, code, counts)
    return context_mixing.Model(code, context_mixing.scaled(counts.astype(np.int64)))


@pytest.mark.parametrize("n", [20_000, 1_000_000, 100_000_000])
def test_a_tree_makes_a_bounded_number_of_copies(n):
    """However many vectors there are; and a pair at the threshold still meets in some leaf."""
    rng = np.random.default_rng(3)
    unit = embedding_dedup.unit_rows(rng.standard_normal((8000, 64)))
    forest = embedding_dedup.Forest(unit[:4000], n, embedding_dedup.spill_of(0.95, 64), 0)
    homes = forest.place(unit)
    mean = sum(map(len, homes)) / len(homes) / embedding_dedup.TREES
    assert mean < 1.5 * embedding_dedup.COPIES
    near = rng.standard_normal((500, 64))
    near -= (near * unit[4000:4500]).sum(1, keepdims=True) * unit[4000:4500]
    near = 0.955 * unit[4000:4500] + np.sqrt(1 - 0.955**2) * embedding_dedup.unit_rows(near)
    met = [bool(set(a) & set(b)) for a, b in zip(homes[4000:4500], forest.place(near))]
    assert np.mean(met) >= 0.98


def test_spelling_learns_words_and_leaves_a_word_out_of_its_own_counts():
    words = [w.encode() for w in sorted(set(prose(1, 300).lower().split()))]
    model = spelling_model(words)
    assert sum(2.0 ** -model.code.length) == pytest.approx(1)
    never = np.zeros(1, bool)
    known, novel, noise = model.bits(words, np.zeros(len(words), bool)).mean(), model.bits([b"stonegarden"], never)[0], model.bits([b"zqxjkvwzqxj"], never)[0]
    assert known < novel < noise
    alone = spelling_model([w for w in words if w != b"stone"])
    alone.code, alone.counts = model.code, np.zeros_like(alone.counts)
    context_mixing.count([w for w in words if w != b"stone"], model.code, alone.counts)
    assert model.bits([b"stone"], np.ones(1, bool))[0] == pytest.approx(alone.bits([b"stone"], never)[0])


def test_large_spelling_counts_keep_their_odds():
    counts = np.array([[100_000, 1_000, 255, 3, 0, 300, 1 << 40, 1, 0, 0]], np.int64)
    assert context_mixing.scaled(counts).tolist() == [[255, 3, 255, 3, 0, 255, 255, 1, 0, 0]]


@pytest.mark.parametrize("common, other", [(3, 2), (200_000, 20_000), (200_000, 100_000), (3_000_000_000, 7), (10**12, 10**12 - 1), (10**12, 1)])
def test_both_branches_of_a_bit_make_one(common, other):
    """Two words after one context: the chance of the first, and of the second, add up to one whatever their counts."""
    wm = word_mixing
    code, context = np.array([0, 1 << 63], np.uint64), np.array([5, 5], np.uint64)
    levels, counts = wm.node_counts(context, code, np.array([common, other]))
    assert levels.tolist() == [2, 2] and counts.tolist() == [common + other, common, common + other, other]
    counts = language_model.opened_counts(language_model.squeezed_counts(counts))
    tables = wm.Tables(np.zeros((wm.TOPICS + 1, 1 << wm.DEPTH), np.int64), np.zeros((wm.PREVIOUS + 1, 1 << wm.PREVIOUS_DEPTH), np.int64))
    none = np.zeros(2, np.int64)
    paths = wm.Paths(code, np.array([1, 1]), none, none, np.zeros(2, np.float32), levels, np.array([0, 2]), np.append(counts, counts.dtype.type(0)), none, none, np.zeros(1, np.uint16))
    chance = [2.0 ** -wm.bits(wm.Paths(*(v[k : k + 1] if len(v) == 2 else v for v in vars(paths).values())), tables, np.array([1]))[0] for k in (0, 1)]
    assert sum(chance) == pytest.approx(1, abs=2e-6) and (chance[0] > chance[1] or common - other < common / 2)


def test_pairs_are_ordered_by_all_bits():
    wm = word_mixing
    for n, contexts, width in ((0, 1, 5), (1, 1, 5), (3000, 30, 48), (3000, 3, 40), (20_000, 5_000, 22)):
        context = wm.mixed(RNG.integers(0, contexts, n).astype(np.uint64)) >> np.uint64(16) << np.uint64(16)
        code = RNG.integers(0, 1 << min(width, 10), n).astype(np.uint64) << np.uint64(64 - width) | RNG.integers(0, 3, n).astype(np.uint64) << np.uint64(16)
        got, want = wm.ordered(context, code), np.lexsort((code, context))
        assert (np.sort(got) == np.arange(n)).all() and (context[got] == context[want]).all() and (code[got] == code[want]).all()


def test_wide_counts_that_single_precision_holds_are_not_doubled():
    none = np.zeros(0, np.int64)
    kinds = [word_mixing.Paths(*[none] * 7, np.array(c), none, none, none).kind for c in ([70_000], [1 << 24], [(1 << 24) + 1])]
    assert kinds == [np.float32, np.float32, np.float64]


def test_words_are_cut_and_numbered_as_bytes_are():
    rng = random.Random(3)
    alphabet = [chr(i) for i in range(40)] + list("abCDZ \t\n\x0b\x0c\r\x1c\x1f\x85\xa0é\u2003ÀΣß😀")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", " ", "\n a", "a "]
    sizes, words = language_model.words_of(language_model.pa.array(texts)[100:])
    want = [[*t.encode().lower().split(), language_model.END] for t in texts[100:]]
    assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
    numbers, flat = language_model.Numbering(), words.to_pylist()
    got = np.concatenate([numbers.of(words[:300]), numbers.of(words[300:])])
    assert [numbers.words[i].as_py() for i in got.tolist()] == flat and len(numbers.words) == len(set(flat))


def test_topic_counts_beyond_32_bits():
    leaves = np.zeros((1, 4), np.int64)
    leaves[0] = [1 << 31, 4, 1 << 33, 0]
    assert word_mixing.with_inner_nodes(leaves)[0].tolist() == [0, (5 << 31) + 4, (1 << 31) + 4, 1 << 33, 1 << 31, 4, 1 << 33, 0]


def test_a_context_of_very_many_texts_stays_a_distribution(spark):
    """160,000 texts of one of five words, equally likely: at best log2(5) bits each, however many texts there are."""
    n = 160_000
    docs = spark.range(n, numPartitions=4).selectExpr("id doc_id", "concat('word', char(97 + pmod(xxhash64(id), 5))) text")
    words = language_model.score(docs).where("held_out").join(docs, "doc_id").groupBy("text").agg({"score": "min", "*": "count"}).collect()
    chance = [10 ** r["min(score)"] for r in words]
    assert len(chance) == 5 and 0.97 < sum(chance) < 1.001
    mean = sum(-r["min(score)"] * math.log2(10) * r["count(1)"] for r in words) / sum(r["count(1)"] for r in words)
    assert 2.31 < mean < 2.36


def test_spelling_is_a_distribution():
    """Over all first bytes: the words of one byte, and what goes on, make one."""
    model = spelling_model([b"ab", b"ac", b"b", b"cab"])
    singles = [bytes([b]) for b in range(256) if b != context_mixing.CLOSE]
    ends = 2.0 ** -model.bits(singles, np.zeros(len(singles), bool))
    log = -model.event_bits(singles, np.zeros(len(singles), bool))[1] * np.log(2)
    first, at = [], 0
    for s in singles:
        first.append(np.exp(log[at : at + model.code.length[s[0]]].sum()))
        at += model.code.length[s[0]] + model.code.length[context_mixing.CLOSE]
    assert 0 < 1 - sum(first) < 1 and all(e <= f for e, f in zip(ends, first))


def slow_scores(spark, texts, held):
    """The scores again, bit by bit with dictionaries over strings of bits."""
    import xxhash

    wm = word_mixing
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    n, within = {}, {}
    for i, w in enumerate(tokens):
        if not held[i]:
            for x in w:
                n[x] = n.get(x, 0) + 1
            for x in set(w):
                within[x] = within.get(x, 0) + 1
    rare = sum(c for w, c in n.items() if w is not None and within[w] < 2)
    weight = {w: c for w, c in n.items() if w is not None and within[w] >= 2}
    total = sum(weight.values()) + max(1, rare) + max(1, n.get(None, 0))
    length = lambda c: int(min(wm.MAX_LENGTH, max(1, math.ceil(math.log2(total / max(c, 1)) - 1e-9))))
    symbols = [(length(n.get(None, 0)), 0, 0, None), (length(rare), 1, 0, "escape")] + [(length(c), 2, xxhash.xxh64(w, seed=42).intdigest(), w) for w, c in weight.items()]
    code, at = {}, 0
    for k, _, _, symbol in sorted(symbols, key=lambda s: s[:3]):
        code[symbol] = format(at >> (64 - k), f"0{k}b")
        at += 1 << (64 - k)
    rank = {w: k for k, (_, w) in enumerate(sorted((-c, w) for w, c in weight.items())[: wm.PREVIOUS])}
    coded = [[code[x if x is None or x in weight else "escape"] for x in w] for w in tokens]

    def contexts(i, k):
        ranks = [rank.get(x, wm.PREVIOUS) for x in tokens[i][:k]]
        topic = min([wm.TOPICS, *ranks[-wm.WINDOW :]])
        before = ranks[-1] if ranks else wm.PREVIOUS
        return ("t", topic), ("b", before), ("p", tuple(coded[i][max(0, k - 2) : k]))

    counts, own = {}, [{} for _ in texts]
    for i, path in enumerate(coded):
        for k, bits in enumerate(path):
            for c in contexts(i, k):
                for j in range(len(bits) + 1):
                    key = c, bits[:j]
                    if not held[i]:
                        counts[key] = counts.get(key, 0) + 1
                        own[i][key] = own[i].get(key, 0) + 1

    def stretch(n0, n1, delta=wm.DELTA, unsure=wm.UNSURE):
        return math.log((n1 + delta) / (n0 + delta)) * (n0 + n1) / (n0 + n1 + unsure)

    squash = lambda z: 1 / (1 + math.exp(-z))
    out = []
    for i, path in enumerate(coded):
        change = [0.0] * wm.PREDICTORS
        came = [wm.MAP_WEIGHT * squash((b + 0.5) * 24 / wm.BUCKETS - 12) for b in range(wm.BUCKETS)]
        total_bits, at, width = 0.0, 0, wm.FIRST_BLOCK
        while at < len(path):
            gradient, seen, learned = [0.0] * wm.PREDICTORS, 0, []
            for k in range(at, min(len(path), at + width)):
                bits = path[k]
                topic, before, pair = contexts(i, k)
                for j, bit in enumerate(bits):
                    x = [0.0] * wm.PREDICTORS
                    for q, (c, depth) in enumerate(((topic, wm.DEPTH), (before, wm.PREVIOUS_DEPTH))):
                        if j < depth:
                            m = [counts.get((c, bits[:j] + s), 0) - (not held[i] and s == bit) for s in "01"]
                            x[q] = stretch(*(max(v, 0) for v in m))
                    m = [counts.get((pair, bits[:j] + s), 0) - own[i].get((pair, bits[:j] + s), 0) for s in "01"]
                    x[2] = stretch(*m, wm.PAIR_DELTA, wm.PAIR_UNSURE)
                    if j >= wm.DEPTH and not sum(m):
                        total_bits += 1
                        continue
                    gate = min(math.ceil(math.log2(sum(m) + 1)), wm.GATES - 1)
                    z = sum((wm.WEIGHTS[gate][q] + change[q]) * x[q] for q in range(wm.PREDICTORS))
                    b, one = int(max(0, min(wm.BUCKETS - 1, (z + 12) * wm.BUCKETS / 24))), bit == "1"
                    mapped = came[b] / (came[b] + came[wm.BUCKETS - 1 - b])
                    refined = 0.5 * squash(z) + 0.5 * mapped
                    total_bits -= math.log2(max(1e-6, refined if one else 1 - refined))
                    for q in range(wm.PREDICTORS):
                        gradient[q] += (one - squash(z)) * x[q]
                    seen += 1
                    learned.append((b, one))
            change = [c + wm.RATE * g / (seen + 200) for c, g in zip(change, gradient)]
            for b, one in learned:
                came[b if one else wm.BUCKETS - 1 - b] += 1
            at, width = at + width, width * 2 if at else width
        escaped = [x for x in tokens[i] if x is not None and x not in weight]
        out.append((total_bits, escaped, [x in n for x in escaped]))
    return out


def test_scores_equal_a_second_computation(spark):
    import zlib

    texts = [prose(s % 37, 10 + s % 50) + f" rare{s % 29}" for s in range(90)] + ["", None, "New words ÉTÉ", prose(3, 400), prose(3, 400) + " once", "a b a b a b a b c"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    marked = docs.select("doc_id", language_model.F.coalesce("text", language_model.F.lit("")).alias("text"), (language_model.id_remainder(7) == 2).alias("held_out"))
    lexicon = language_model.lexicon_of(language_model.chunked(marked))
    model = language_model.fit_bits(lexicon, language_model.facts_of(lexicon).distinct)
    for i, (bits, escaped, counted) in enumerate(slow_scores(spark, texts, held)):
        bits += model.bits(escaped, np.array(counted, bool)).sum() if escaped else 0
        assert got[i]["score"] == pytest.approx(-bits * math.log10(2), rel=2e-3), i
        if texts[i]:
            assert got[i]["bits_per_byte"] == pytest.approx(bits / len(texts[i].encode()), rel=2e-3)


@pytest.mark.parametrize("small", [False, True])
def test_base_scores_and_counts(spark, monkeypatch, small):
    if small:  # many chunks and blocks
        monkeypatch.setattr(language_model, "CHUNK_TOKENS", 400)
        monkeypatch.setattr(language_model, "BLOCK_WORDS", 10)
        monkeypatch.setattr(language_model, "SCORE_TOKENS", 300)
    texts = [prose(s, 20 + s % 50) for s in range(120)] + ["", None, "New words ÉTÉ", prose(3, 5000)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    count = {}
    for i, w in tokens.items():
        if not held[i]:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in count for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and (r["bits_per_byte"] is None) == (not texts[i])


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    texts = [prose(s % 50, 30 + s) for s in range(80)] + ["", None]
    runs = []
    for parts, shuffle, tokens in ((2, "4", 5_000_000), (9, "16", 700)):
        monkeypatch.setattr(language_model, "CHUNK_TOKENS", tokens)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            runs.append({r["doc_id"]: r["score"] for r in language_model.score(documents(spark, texts, parts)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0].keys() == runs[1].keys() and all(runs[0][i] == pytest.approx(runs[1][i], rel=1e-6) for i in runs[0])


def test_a_text_that_another_repeats_is_cheap_and_one_alone_is_not_known_from_itself(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    fresh = lambda: " ".join(rng.choice(words) for _ in range(200))
    texts = [fresh() for _ in range(60)]
    texts += [texts[5], texts[6]]
    got = {r["doc_id"]: r for r in language_model.score(documents(spark, texts)).collect()}
    usual = np.median([r["bits_per_byte"] for r in got.values()])
    twice = [i for i in (5, 6, 60, 61) if not got[{5: 60, 6: 61, 60: 5, 61: 6}[i]]["held_out"]]
    assert twice and all(got[i]["bits_per_byte"] < 0.5 * usual for i in twice)
    assert all(got[i]["bits_per_byte"] > 0.9 * usual for i in range(60) if i not in (5, 6))


def test_byte_planes():
    for dtype in (np.uint32, np.int64, np.float32, np.uint64, np.uint8):
        x = RNG.integers(0, 200, 77).astype(dtype)
        assert (language_model.opened(language_model.squeezed(x), dtype) == x).all()


def test_scores_of_awkward_rows(spark):
    got = language_model.score(odd_documents(spark)).collect()
    assert len(got) == len(odd_rows()) and sum(r["doc_id"] is None for r in got) == 1
    assert language_model.score(no_documents(spark)).count() == 0


def test_text_of_over_a_million_distinct_words(spark):
    n = (1 << 20) + 5000
    docs = spark.createDataFrame([(0, " ".join(f"{i:x}" for i in range(n))), (1, "stone river"), (3, "stone river 1f")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    assert got[0]["n_tokens"] == n + 1 and got[0]["score"] < 0 and got[1]["n_known"] == 3


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 120)
    extra = [(200, prose(1, 40)), (201, varied(1, 40, 12)), (202, "my password = hunter2222 " + prose(300, 30)), (203, None), (204, "")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + extra
    whole = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    step, seen = whole, {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        seen[name] = step.collect()
        if name != "packing":
            assert step.columns == whole.columns
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    assert ids["toxicity"] == {i for i, _ in rows if i >= 200 or i % 5}
    assert ids["near_dedup"] == ids["toxicity"] - {200}
    secret = next(r for r in seen["secret_scan"] if r["doc_id"] == 202)
    assert "hunter" not in secret["text"] and secret["n_chars"] == len(secret["text"])
    assert ids["packing"] == ids["secret_scan"] == ids["near_dedup"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["packing"]
