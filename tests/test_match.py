import random
import re

from pyspark.sql import functions as F

from log_templates.operators import match
from log_templates.operators.template_index import Known, TemplateIndex, constant_words, filled
from log_templates.tables import Scratch

TEMPLATES = [
    (1, "a <*> b", "a 1 b", 3),
    (2, "a <*>", "a zz", 5),
    (3, "<*> b (<*>)", "x b (1)", 0),
    (4, "<*> b ()", "x b ()", 0),
    (5, "lone <*><*> end", "lone 1 end", 9),
]
LINES = [
    (1, "a 1 b"), (2, "a q"), (3, "x b ()"), (4, "x b (2)"), (5, "zz"), (6, "lone  7 end"), (7, "a 1 2 3 4 5 b"),
]


def tables(spark):
    templates = spark.createDataFrame(
        TEMPLATES, "template_id bigint, event_template string, reference_log string, hits bigint"
    )
    return spark.createDataFrame(LINES, "line_id bigint, content string"), templates


def test_lookup_and_shuffle_agree(spark):
    lines, templates = tables(spark)
    want = {1: "a <*>", 2: "a <*>", 3: "<*> b ()", 4: "<*> b (<*>)", 5: None, 6: None, 7: None}
    for bound in (100, 0):
        got = match.match_templates(lines, templates, max_lookup_rows=bound).collect()
        assert {r["line_id"]: r["event_template"] for r in got} == want


def many(seed=2, n=400):
    rng = random.Random(seed)
    words = ["a", "b", "cc", "dd", "e=1", "<*>", "<*>:", "x<*>", "<*><*>"]
    templates = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)})
    lines = [re.sub(r"<\*>", lambda _: rng.choice(["", "1", "b", "q r"]), rng.choice(templates)) for _ in range(n)]
    lines = [" ".join(x.split()) for x in lines] + ["", "b"]
    known = [(i, t, rng.choice(lines), rng.randint(0, 3)) for i, t in enumerate(templates)]
    return list(enumerate(lines)), known


def fitted(line, template):
    """Brute force: an anchored lazy pattern, and the placeholders that took something."""
    found = re.fullmatch("(.*?)".join(re.escape(p) for p in template.split("<*>")), line, re.S)
    if found is None:
        return None
    parts = template.split("<*>")
    return parts[0] + "".join(("<*>" if v else "") + p for v, p in zip(found.groups(), parts[1:], strict=True))


def test_every_path_equals_brute_force(spark):
    lines, known = many()
    texts = {t for _, t, _, _ in known}
    want = {}
    for i, line in lines:
        n, hits = len(line.split()), []
        for tid, template, reference, h in known:
            hit = fitted(line, template)
            if abs(len(reference.split()) - n) <= 1 and hit is not None and hit in texts:
                hits.append((-h, tid, hit))
        want[i] = min(hits)[2] if hits else None
    frame = spark.createDataFrame(lines, "line_id bigint, content string")
    templates = spark.createDataFrame(known, "template_id bigint, event_template string, reference_log string, hits bigint")
    for options in ({}, {"max_lookup_rows": 0}, {"max_lookup_rows": 0, "aggregate": False}):
        got = match.match_templates(frame, templates, **options).collect()
        assert {r["line_id"]: r["event_template"] for r in got} == want


def test_index_tries_few_of_many_templates():
    known = [Known(0, k, f"job <*> of host{k} ended with code <*>", (), 8) for k in range(50_000)]
    known.append(Known(0, 50_001, "<*> ended", (), 8))
    index = TemplateIndex(known)
    for k in range(0, 50_000, 500):
        assert index.find(f"job 7 of host{k} ended with code 3", ()) == known[k].template
    assert index.tried <= 2 * 100
    assert constant_words("a <*> b=<*> c") == {"a", "c"}
    assert filled("a  b", ["a ", " b"]) == "a  b" and filled("ab", ["a", "c"]) is None


def test_lines_are_not_shuffled_by_the_lookup(spark):
    lines, templates = tables(spark)
    plan = match.match_templates(lines, templates)._jdf.queryExecution().executedPlan().toString()
    spine = [row for row in plan.splitlines() if "content" in row and "reference_log" not in row]
    assert spine and not any("Exchange" in row for row in spine)


def test_without_length_gate(spark):
    lines, templates = tables(spark)
    got = match.match_templates(lines, templates, length_gate=False).where("line_id = 7").first()
    assert got["event_template"] == "a <*>"


def test_keys_keep_systems_apart(spark):
    lines, templates = tables(spark)
    both = lines.withColumn("dataset", F.lit("x")).union(lines.withColumn("dataset", F.lit("y")))
    got = match.match_templates(both, templates.withColumn("dataset", F.lit("x")), ["dataset"])
    assert got.where("dataset = 'y' and event_template is not null").count() == 0
    assert got.where("dataset = 'x' and event_template is not null").count() == 4


def test_prune_halves_partition_the_clusters(spark):
    clusters = spark.createDataFrame(
        [(1, "a 1", 0), (2, "b 1", 0), (3, "c", 1), (4, "a 2", 0)], "line_id bigint, content string, cluster_id bigint"
    )
    found = spark.createDataFrame([(0, "a <*>")], "cluster_id bigint, event_template string")
    got = match.prune_clusters(clusters, found)
    assert {r["line_id"] for r in got.where("matched").collect()} == {1, 4}
    assert {r["line_id"] for r in got.where("not matched").collect()} == {2, 3}


def test_reuse_and_filter(spark):
    lines, templates = tables(spark)
    clusters = lines.withColumn("cluster_id", F.col("line_id") % 2)
    got = {r["cluster_id"]: r["event_template"] for r in match.reuse_templates(clusters, templates).collect()}
    assert got == {0: "a <*>", 1: "a <*>"}
    kept = match.filter_templates(templates, templates.where("template_id = 1").select("event_template"))
    assert [r["template_id"] for r in kept.collect()] == [1]


def test_subsumption(spark):
    df = spark.createDataFrame([("a <*> c",), ("a b c",), ("<*> b c",), ("a  b c",), (r"a \E c",)], "event_template string")
    got = {(r["general"], r["special"]) for r in match.subsumption_pairs(df).collect()}
    assert got == {
        ("a <*> c", "a b c"), ("a <*> c", "a  b c"), ("a <*> c", r"a \E c"), ("<*> b c", "a b c"),
        ("<*> b c", "a  b c"), ("a b c", "a  b c"),
    }


def test_a_line_is_not_shuffled_for_words_that_are_no_anchor(spark):
    """Anchors of checked size are met before the join, and the result is that of the lookup."""
    lines = spark.createDataFrame(
        [(1, "user 7 came in " + "w " * 3), (2, "disk full"), (3, "nothing known"), (4, "")], "line_id long, content string"
    )
    templates = spark.createDataFrame(
        [(1, "user <*> came in w w w", "user 7 came in w w w", 3), (2, "disk <*>", "disk full", 2), (3, "<*>", "x", 1)],
        "template_id long, event_template string, reference_log string, hits long",
    )
    shuffled = match.match_templates(lines, templates, max_lookup_rows=0)
    plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
    looked_up = match.match_templates(lines, templates)
    assert sorted(shuffled.collect()) == sorted(looked_up.collect())


def test_no_table_of_templates_beyond_the_lookup_is_sent(spark, monkeypatch):
    """Even where Spark takes its file for small: what is exploded from it is not."""
    lines, templates = tables(spark)
    monkeypatch.setattr(match, "fits_broadcast", lambda *_: False)
    found = match.match_templates(lines, Scratch(spark, "t").save(templates))  # of a file Spark knows the size
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["line_id"] for r in found.where("event_template is not null").collect()} == {1, 2, 3, 4}
