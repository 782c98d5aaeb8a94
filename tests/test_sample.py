import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from log_templates.operators import sample


def lines_of(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for cluster, n in enumerate(sizes):
        for _ in range(n):
            text = " ".join(rng.choice(words, size=int(rng.integers(2, 7))))
            rows.append((len(rows), text, cluster))
    return spark.createDataFrame(rows, "line_id bigint, content string, cluster_id bigint")


def greedy(texts, k):
    """Brute force: the determinant of every candidate set."""
    docs = [t.split() for t in texts]
    vocab = sorted({w for d in docs for w in d})
    tf = np.array([[d.count(w) for w in vocab] for d in docs], dtype=float)
    idf = np.log((1 + len(docs)) / (1 + (tf > 0).sum(0))) + 1
    m = tf * idf
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    chosen = []
    for _ in range(k):
        best, best_det = -1, -1.0
        for i in range(len(docs)):
            if i not in chosen:
                pick = chosen + [i]
                det = np.linalg.det(s[np.ix_(pick, pick)])
                if det > best_det + 1e-9:
                    best, best_det = i, det
        chosen.append(best)
    return sorted(chosen)


def ids(df):
    return sorted((r["cluster_id"], r["line_id"]) for r in df.collect())


def distinct_first(df):
    firsts = df.groupBy("cluster_id", "content").agg(F.min("line_id").alias("line_id"))
    return {
        c: [(r["line_id"], r["content"]) for r in sorted(firsts.collect(), key=lambda r: r["line_id"]) if r["cluster_id"] == c]
        for c in range(3)
    }


def test_diverse_equals_greedy_determinant_in_both_plans(spark):
    lines = lines_of(spark, [30, 25, 3])
    small = sample.sample_batches(lines, 5, "diverse")
    large = sample.sample_batches(lines, 5, "diverse", group_rows=0)
    want = []
    for cluster, rows in distinct_first(lines).items():
        picked = range(len(rows)) if len(rows) <= 5 else greedy([t for _, t in rows], 5)
        want += [(cluster, rows[i][0]) for i in picked]
    assert ids(small) == sorted(want)
    assert ids(large) == sorted(want)


def test_rounds_of_a_large_cluster_sum_per_line_in_place(spark, monkeypatch):
    steps, save = {}, sample.Scratch.save

    def seen(self, df, label="step", **kw):
        if label.startswith("volume-"):
            steps[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return save(self, df, label, **kw)

    monkeypatch.setattr(sample.Scratch, "save", seen)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert sample.sample_batches(lines_of(spark, [30]), 3, "diverse", group_rows=0).count() == 3
    assert set(steps) == {"volume-0", "volume-1", "volume-2"}
    assert all("InMemoryRelation" in plan for plan in steps.values())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_diverse_with_lines_without_words(spark):
    rows = [(i, t, 0) for i, t in enumerate(["-", "+", "ab cd", "ab ef", "ab cd ef"])]
    lines = spark.createDataFrame(rows, "line_id bigint, content string, cluster_id bigint")
    small = sample.sample_batches(lines, 4, "diverse")
    large = sample.sample_batches(lines, 4, "diverse", group_rows=0)
    assert ids(small) == ids(large) == [(0, 0), (0, 2), (0, 3), (0, 4)]


@pytest.mark.parametrize("method", ["random", "diverse", "similar"])
def test_batches_are_bounded_distinct_and_ordered(spark, method):
    lines = lines_of(spark, [40, 2, 11])
    got = sample.sample_batches(lines, 6, method)
    per = {}
    for r in got.collect():
        per.setdefault(r["cluster_id"], []).append((r["pos"], r["line_id"], r["content"]))
    for cluster, rows in per.items():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows)))
        assert [i for _, i, _ in rows] == sorted(i for _, i, _ in rows)
        assert len({c for _, _, c in rows}) == len(rows)
    assert {c: len(r) for c, r in per.items()} == {0: 6, 1: 2, 2: 6}


def test_same_sample_for_any_partitioning(spark):
    lines = lines_of(spark, [60])
    for method in ("random", "diverse", "similar"):
        one = sample.sample_batches(lines.coalesce(1), 7, method)
        many = sample.sample_batches(lines.repartition(8), 7, method)
        assert ids(one) == ids(many)


def test_labelled_pairs_cover_templates_first(spark):
    rows = [(i, f"line {i}", i % 3, f"t{i % 3}") for i in range(60)]
    lines = spark.createDataFrame(rows, "line_id bigint, content string, cluster_id bigint, truth_template string")
    got = sample.pick_labelled_pairs(lines, 7).orderBy("pair_id").collect()
    assert [r["template"] for r in got] == ["t0", "t1", "t2", "t0", "t1", "t2", "t0"]
    assert len({r["log"] for r in got}) == 7


def test_balanced_groups_fill_no_group_beyond_capacity(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(53)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sample.balanced_groups(df, 10)
    assert got.count() == 53
    assert got.select("vec_id").distinct().count() == 53
    assert got.groupBy("group_id").count().agg(F.max("count")).first()[0] <= 10


def plain_groups(points, capacity, rounds=10):
    """Brute force of balanced k-means, row by row."""
    cos = lambda a, b: 0.0 if not any(b) else round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(y * y for y in b)), 9)
    n, count = len(points), -(-len(points) // capacity)
    centres = [points[j * n // count] for j in range(count)]
    best = lambda p: min(range(count), key=lambda g: (-cos(p, centres[g]), g))
    for _ in range(rounds):
        label = [best(p) for p in points]
        for g in range(count):
            mine = [p for p, x in zip(points, label, strict=True) if x == g]
            if mine:
                centres[g] = [sum(c) / len(mine) for c in zip(*mine, strict=True)]
    groups = [[i for i in range(n) if best(points[i]) == g] for g in range(count)]
    for g in range(count):
        ordered = sorted(groups[g], key=lambda i: (-cos(points[i], centres[g]), i))
        if len(ordered) > capacity:
            groups[g] = ordered[:capacity]
            for i in ordered[capacity:]:
                for h in sorted(range(count), key=lambda h: (-cos(points[i], centres[h]), h)):
                    if len(groups[h]) < capacity:
                        groups[h].append(i)
                        break
    return [next(g for g in range(count) if i in groups[g]) for i in range(n)]


@pytest.mark.parametrize("n,capacity", [(1, 3), (7, 3), (40, 4), (60, 7), (33, 33)])
def test_balanced_kmeans_equals_brute_force(n, capacity):
    rng = np.random.default_rng(n)
    points = rng.choice([0.0, 1.0, 2.0], size=(n, 5), p=[0.5, 0.3, 0.2])
    length = np.linalg.norm(points, axis=1, keepdims=True)
    points = np.divide(points, length, out=np.zeros_like(points), where=length > 0)
    got = sample.balanced_kmeans(points, capacity).tolist()
    assert got == plain_groups(points.tolist(), capacity)
    assert max(np.bincount(got)) <= capacity


def test_cells_are_bounded_and_groups_stay_inside(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)] + [(300 + k, [1.0] * 6) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sample.balanced_groups(df, 10, cell_rows=64).collect()
    sizes = Counter(r["group_id"] for r in got)
    assert len(got) == 500 and max(sizes.values()) <= 10 and sorted(sizes) == list(range(len(sizes)))
    assert len(sizes) <= 50 + 32


def test_similar_sample_is_the_group_of_the_first_line(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rng = np.random.default_rng(8)
    rows = [(c * 100 + k, c, " ".join(rng.choice(words, size=4)) + f" u{c}x{k}") for c in range(3) for k in range(25)]
    df = spark.createDataFrame(rows, "line_id bigint, cluster_id bigint, content string")
    got = {c: [] for c in range(3)}
    for r in sample.sample_batches(df, 6, "similar").collect():
        got[r["cluster_id"]].append(r["line_id"])
    for c in range(3):
        lines = [(i, t.split()) for i, g, t in rows if g == c]
        df_of = Counter(w for _, t in lines for w in set(t))
        vocabulary = sorted(df_of)
        points = []
        for _, t in lines:
            w = [t.count(x) * (math.log((1 + len(lines)) / (1 + df_of[x])) + 1) for x in vocabulary]
            length = math.sqrt(sum(x * x for x in w))
            points.append([x / length for x in w])
        label = plain_groups(points, 6)
        assert sorted(got[c]) == [i for (i, _), g in zip(lines, label, strict=True) if g == label[0]]


def test_the_cell_of_the_first_point_is_that_of_all_cells(spark):
    """Followed alone, the first point's cell is the same, in each of several keys."""
    rng = np.random.default_rng(4)
    rows = [
        (key, i, [(str(t), float(w)) for t, w in enumerate(rng.standard_normal(4))])
        for key in (0, 1) for i in range(90)
    ]
    points = spark.createDataFrame(rows, "key int, id long, items array<struct<term:string,weight:double>>").cache()
    run = lambda **more: {
        (r["key"], r["id"]): (r["cell"], r["group"])
        for r in sample.balanced_cells(points, ["key"], 5, "id", "items", cell_rows=20, **more).collect()
    }
    every, first = run(), run(of_first=True)
    assert len(every) == len(rows)
    cells = {(key, every[key, 0][0]) for key in (0, 1)}
    assert first == {k: v for k, v in every.items() if (k[0], v[0]) in cells}
