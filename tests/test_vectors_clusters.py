import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from log_templates.operators import cluster, mean_shift, vectors
from log_templates.operators.components import connected_components
from log_templates.tables import Scratch, number_in_order


def brute_tfidf(docs):
    df = Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in Counter(d).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def docs_of(seed, n, length, vocab=12):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocab + 1)
    return [
        [f"t{j}" for j in rng.choice(vocab, size=int(rng.integers(*length)), p=p / p.sum())] for _ in range(n)
    ]


@pytest.mark.parametrize("eps,hot,length", [(0.1, 1000, (2, 9)), (0.3, 5, (2, 9)), (0.6, 2, (2, 9)), (0.3, 3, (60, 90))])
def test_similar_pairs_equal_brute_force(spark, eps, hot, length):
    docs = docs_of(7, 120, length)
    df = spark.createDataFrame(list(enumerate(docs)), "line_id bigint, tokens array<string>")
    got = vectors.similar_pairs(vectors.tfidf(df), eps, hot_term=hot).collect()
    brute = brute_tfidf(docs)
    want = {}
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            cos = sum(w * brute[b].get(t, 0) for t, w in brute[a].items())
            if cos >= 1 - eps * eps / 2 - 1e-9:
                want[(a, b)] = cos
    assert {(r["a"], r["b"]) for r in got} == set(want)
    for r in got:
        assert r["cos"] == pytest.approx(want[(r["a"], r["b"])], abs=1e-9)


def test_vectors_of_frequent_terms_rarely_meet(spark):
    """a term in a tenth of all vectors does not bring them together."""
    docs = docs_of(3, 300, (28, 33), vocab=200)
    df = spark.createDataFrame(list(enumerate(docs)), "line_id bigint, tokens array<string>")
    packs = vectors.packed_vectors(df)
    keys = packs.select(
        "line_id", F.explode(vectors._pair_keys(vectors._prefix(F.col("ranked"), 1 - 0.3**2 / 2))).alias("k")
    ).select("line_id", "k.key")
    met = keys.groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met < 0.02 * 300 * 299 / 2


def test_density_keeps_no_tokens(spark, tmp_path, monkeypatch):
    """bags, term counts and copies of the vectors are gone once the clusters are known."""
    monkeypatch.setattr("log_templates.tables.scratch_root", lambda _: str(tmp_path))
    lines = [(i, f"alpha beta {'gamma delta'.split()[i % 2]} word{chr(97 + i % 7)}") for i in range(60)]
    df = spark.createDataFrame(lines, "line_id bigint, content string")
    got = cluster.density_clusters(df, 0.3, 2)
    assert got.count() == 60
    left = {p.parent.name.split("-", 1)[1] for p in tmp_path.rglob("*.parquet") if p.is_file()}
    left |= {p.name.split("-", 1)[1] for p in tmp_path.glob("*/*/*")}
    assert "packed" in left
    assert not left & {"bags", "bags-of-terms", "vocabulary", "heads", "asked", "candidates"}


def test_tfidf_counts_copies(spark):
    docs = [["a", "b"], ["a", "c", "c"], ["a", "b"]]
    every = spark.createDataFrame(list(enumerate(docs)), "line_id bigint, tokens array<string>")
    packed = spark.createDataFrame([(0, docs[0], 2), (1, docs[1], 1)], "line_id bigint, tokens array<string>, copies int")
    one = {(r["line_id"], r["term"]): r["weight"] for r in vectors.tfidf(every).collect()}
    two = {(r["line_id"], r["term"]): r["weight"] for r in vectors.tfidf(packed, copies_col="copies").collect()}
    for key, w in two.items():
        assert w == pytest.approx(one[key])
    for i, doc in enumerate(brute_tfidf(docs)):
        for t, w in doc.items():
            assert one[(i, t)] == pytest.approx(w)


def test_terms_are_not_sorted_or_grouped_by_id(spark):
    """repeated and null ids count as one document each; the plan has no window over terms."""
    docs = [(1, ["a", "b", "b"]), (1, ["b", "c"]), (None, ["a"]), (None, ["d"]), (2, ["a", None]), (3, []), (4, None)]
    df = spark.createDataFrame(docs, "line_id bigint, tokens array<string>")
    found = vectors.tfidf(df)
    got = {(r["line_id"], r["term"]): r["weight"] for r in found.collect()}
    merged = {1: {"a": 1, "b": 3, "c": 1}, None: {"a": 1, "d": 1}, 2: {"a": 1}}
    count = Counter(t for bag in merged.values() for t in bag)
    for i, bag in merged.items():
        raw = {t: n * (math.log((1 + len(docs)) / (1 + count[t])) + 1) for t, n in bag.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        for t, x in raw.items():
            assert got.pop((i, t)) == pytest.approx(x / length)
    assert not got
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_pairs_without_shared_words(spark):
    logs = spark.createDataFrame([(1, "alpha beta"), (2, "zeta")], "line_id bigint, content string")
    pairs = spark.createDataFrame(
        [(1, "gamma", "g"), (2, "alpha", "a"), (3, "beta alpha", "b")], "pair_id int, log string, template string"
    )
    got = vectors.nearest_pairs(logs, pairs, 2).orderBy("line_id", "rank").collect()
    assert [(r["line_id"], r["pair_id"]) for r in got] == [(1, 3), (1, 2), (2, 1), (2, 2)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}
    assert connected_components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_numbers_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 101) for i in range(300)], "g int, v int").distinct()
    got = number_in_order(df, [F.col("v").desc()], "n", Scratch(spark, "t"), ["g"]).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["n"], r["v"]))
    for rows in groups.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(len(rows)))
        assert [v for _, v in rows] == sorted((v for _, v in rows), reverse=True)


def brute_density(docs, eps, min_samples):
    v = brute_tfidf(docs)
    n = len(docs)
    near = [
        [j for j in range(n) if i == j or sum(w * v[j].get(t, 0) for t, w in v[i].items()) >= 1 - eps * eps / 2 - 1e-9]
        for i in range(n)
    ]
    core = [len(x) >= min_samples for x in near]
    label, current = [-1] * n, 0
    for i in range(n):
        if label[i] != -1 or not core[i]:
            continue
        todo, label[i] = [i], current
        while todo:
            for j in near[todo.pop()]:
                if label[j] == -1:
                    label[j] = current
                    if core[j]:
                        todo.append(j)
        current += 1
    return label


@pytest.mark.parametrize("eps,min_samples", [(0.1, 5), (0.4, 5), (0.6, 5), (0.6, 9), (0.9, 12)])
def test_density_clusters_equal_brute_force(spark, eps, min_samples):
    docs = [[t.replace("t", "w") for t in d] for d in docs_of(11, 150, (2, 5), 8)]
    words = {f"w{i}": chr(97 + i) * 3 for i in range(8)}
    docs = [[words[t] for t in d] for d in docs]
    lines = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "line_id bigint, content string")
    got = cluster.density_clusters(lines, eps, min_samples).collect()
    assert [r["cluster_id"] for r in sorted(got, key=lambda r: r["line_id"])] == brute_density(docs, eps, min_samples)


def test_noise_is_regrouped_by_token_sequence(spark):
    rows = [(0, "b a"), (1, "a b"), (2, "b a"), *[(i, "x y z") for i in range(3, 9)], (9, "q")]
    lines = spark.createDataFrame(rows, "line_id bigint, content string")
    got = {r["line_id"]: r["cluster_id"] for r in cluster.cluster_logs(lines).collect()}
    assert got == {0: 1, 2: 1, 1: 2, **{i: 0 for i in range(3, 9)}, 9: 3}


def test_token_key_noise_and_keys(spark):
    rows = [(0, "disk full now 12"), (1, "17"), (2, "disk full now 99"), (3, "disk full, now"), (4, "word")]
    lines = spark.createDataFrame(rows, "line_id bigint, content string")
    coarse = {r["line_id"]: r["cluster_id"] for r in cluster.token_key_clusters(lines).collect()}
    fine = {r["line_id"]: r["cluster_id"] for r in cluster.token_key_clusters(lines, "fine").collect()}
    assert coarse == {0: 0, 2: 0, 3: 0, 1: -1, 4: -1} and fine == coarse
    with pytest.raises(ValueError):
        cluster.token_keys(lines, "finest")


def brute_mean_shift(docs, width):
    vocab = sorted({t for d in docs for t in d})
    x = np.array([[w.get(t, 0.0) for t in vocab] for w in brute_tfidf(docs)])
    found = {}
    for i in range(len(x)):
        mean = x[i]
        while True:
            inside = np.linalg.norm(x - mean, axis=1) <= width + 1e-9
            new = x[inside].mean(0)
            moved, mean = np.linalg.norm(new - mean), new
            if moved <= 1e-3 * width:
                break
        found[tuple(np.round(mean, 9))] = int(inside.sum())
    kept = []
    for centre, _ in sorted(found.items(), key=lambda c: -c[1]):
        if all(np.linalg.norm(np.array(centre) - np.array(k)) > width for k in kept):
            kept.append(centre)
    d = np.linalg.norm(x[:, None, :] - np.array(kept)[None], axis=2)
    return d.argmin(1)


def test_mean_shift_finds_the_same_groups(spark):
    base = ["alpha beta gamma delta", "one two three four", "red green blue white"]
    extra = ["", " extra", " more", " last"]
    texts = [base[i % 3] + extra[i % 4] for i in range(24)] + ["solo words here"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, content string")
    got = mean_shift.mean_shift_clusters(lines).collect()
    ours = [r["cluster_id"] for r in sorted(got, key=lambda r: r["line_id"])]
    brute = brute_mean_shift([t.split() for t in texts], 0.5)
    same = lambda labels: {tuple(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert same(ours) == same(list(brute))


def near_equal_lines(n, seed=3):
    """Lines of five heavy words, each with a subset of common words that hardly weighs, among other lines."""
    rng = np.random.default_rng(seed)
    common = [f"com{chr(97 + k)}" for k in range(12)]
    rare = ["kernel", "watchdog", "deadline", "scheduler", "overrun"]
    dense = [" ".join(rare * 3 + [w for w in common if rng.random() < 0.5]) for _ in range(n)]
    other = [" ".join([f"x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}"] * 2 + common) for k in range(6 * n)]
    lines = dense + other
    rng.shuffle(lines)
    return lines


def written_rows(spark, scratch, label):
    import glob

    folders = glob.glob(f"{scratch.path.removeprefix('file:')}/*-{label}")
    return sum(spark.read.parquet(f).count() for f in folders)


@pytest.mark.parametrize("eps", [0.2, 0.35])
def test_density_of_a_dense_region(spark, eps):
    lines = near_equal_lines(80)
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, content string")
    got = sorted(cluster.density_clusters(df, eps, 5).collect(), key=lambda r: r["line_id"])
    assert [r["cluster_id"] for r in got] == brute_density([sorted(x.split()) for x in lines], eps, 5)


def test_pairs_of_a_dense_region_are_not_listed(spark):
    written = {}
    for n in (100, 400):
        lines = near_equal_lines(n)
        df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, content string")
        scratch = Scratch(spark, "dense")
        cluster.density_clusters(df, 0.35, 5, scratch=scratch).count()
        written[n] = sum(
            written_rows(spark, scratch, x) for x in ("candidates", "inside", "leader-pairs", "member-pairs", "opened", "found")
        )
    assert written[400] <= 5 * written[100] and written[400] < 400 * 400 / 8


def test_a_large_vocabulary_is_split_by_heat(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_VOCABULARY", 3)
    monkeypatch.setattr(vectors, "HOT_TERMS", 8)
    docs = [["every", *d] for d in docs_of(5, 60, (1, 9), 30)]
    df = spark.createDataFrame(list(enumerate(docs)), "line_id bigint, tokens array<string>")
    got = {(r["line_id"], r["term"]): r["weight"] for r in vectors.tfidf(df).collect()}
    want = {(i, t): w for i, d in enumerate(brute_tfidf(docs)) for t, w in d.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("frequent", [2, 20, 100_000])
def test_top_words_however_many_are_frequent(spark, monkeypatch, frequent):
    """Lines whose answer is among the frequent words, partly among them, and not at all; also two systems."""
    monkeypatch.setattr(cluster, "FREQUENT_WORDS", frequent)
    texts = ["alpha beta gamma delta one", "alpha beta zulu", "zulu yankee xray", "alpha beta gamma", "to it", "single", "alpha beta gamma"]
    rows = [(s, i, t) for s in ("x", "y") for i, t in enumerate(texts[: 7 if s == "x" else 3])] + [("x", 9, None)]
    lines = spark.createDataFrame(rows, "system string, line_id long, content string")
    got = {(r["system"], r["line_id"]): r["token_key"] for r in cluster.token_keys(lines, by=["system"]).collect()}
    for s in ("x", "y"):
        kept = {i: [w for w in t.split() if len(w) > 2] for x, i, t in rows if x == s and t}
        counts = Counter(w for words in kept.values() if len(words) for w in words if words != ["single"])
        for i, words in kept.items():
            want = sorted(sorted(set(words), key=lambda w: (-counts[w], w))[:3])
            assert got[s, i] == (None if i == 5 else want)
    assert got["x", 9] is None
