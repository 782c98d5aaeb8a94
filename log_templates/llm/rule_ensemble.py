"""Quality classifier: a sparse ensemble of rules read off trees.

A forest of shallow trees is grown on statistics of the labelled texts.  Every path from
a root to a node is a conjunctive rule; a logistic regression with a lasso penalty over
all rules keeps few of them, and those become one Spark column expression that scores
every text.  Fitting and scoring are Spark ML and Spark SQL throughout: all labelled
rows are used, and only the trees and weights reach the driver.

Defined results.  A null or empty text has statistics of 0 and a score like any other.
Labels that are neither 0 nor 1, or whose id has no text, are ignored.  With no labels,
or labels of one kind only, every score is the smoothed share of good labels.  Ids may be
null or repeat: each row gets its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.llm.common import Scratch
from log_templates.llm.quality_rules import measure

TREES, DEPTH = 16, 3
PENALTY = 0.001
ITERATIONS = 60
SEED = 17

Condition = tuple[int, str, float]  # feature, "<=" or ">", threshold


def features(s: Column) -> dict[str, Column]:
    """Statistics of a text, as ratios of its counts."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    lines = F.greatest(s["n_lines"], F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(s["n_words"].cast("double")),
        "word_length": s["word_chars"] / n,
        "symbols": s["n_symbols"] / n,
        "same_lines": s["n_dup_lines"] / lines,
        "repeated": s["n_repeat_words"] / n,
        "distinct": s["n_distinct_words"] / n,
        "plain": s["n_plain_words"] / n,
        "upper": s["n_upper"] / chars,
        "marks": s["n_marks"] / n,
        "ended": s["n_ended_lines"] / lines,
        "line_words": s["n_words"] / lines,
    }


def tree_rules(text: str) -> set[tuple[Condition, ...]]:
    """The paths to all nodes of one tree, from its printed form; bounds on a feature are merged."""
    path: list[Condition] = []
    rules = set()
    for line in text.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (int(found[2]), found[3], float(found[4]))))
            tight: dict[tuple[int, str], float] = {}
            for _, (feature, way, bound) in path:
                old = tight.get((feature, way), bound)
                tight[feature, way] = min(old, bound) if way == "<=" else max(old, bound)
            rules.add(tuple(sorted((f, w, b) for (f, w), b in tight.items())))
    return rules


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules over named statistics."""

    names: tuple[str, ...]
    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def holds(self, rule: tuple[Condition, ...], of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for feature, way, bound in rule:
            value = of[self.names[feature]]
            out = out & ((value <= F.lit(bound)) if way == "<=" else (value > F.lit(bound)))
        return out

    def score(self, of: dict[str, Column]) -> Column:
        """Probability that a text is good, as a column expression."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(self.holds(rule, of), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules as text, the heaviest first."""
        ordered = sorted(self.rules, key=lambda x: -abs(x[1]))
        return [f"{w:+.3f}  " + " and ".join(f"{self.names[f]} {o} {b:g}" for f, o, b in r) for r, w in ordered]


def fit_rule_ensemble(labelled: DataFrame, names: list[str], scratch: Scratch, label_col: str = "label") -> RuleEnsemble:
    """Fit to a table of statistics (doubles) with a 0/1 label."""
    import math

    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    start = math.log((good + 1) / (bad + 1))
    if not good or not bad:
        return RuleEnsemble(tuple(names), (), start)
    plain = labelled.select(F.col(label_col).cast("double").alias("label"), *names)
    table = scratch.save(plain.withColumn("features", array_to_vector(F.array(*names))), "labelled")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.8
    ).fit(table.select("label", "features"))
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        return RuleEnsemble(tuple(names), (), start)
    draft = RuleEnsemble(tuple(names), (), 0.0)
    columns = {n: F.col(n) for n in names}
    hits = F.array(*[F.when(draft.holds(r, columns), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules])
    weighed = scratch.save(table.select("label", array_to_vector(hits).alias("features")), "rules")
    lasso = LogisticRegression(
        regParam=PENALTY, elasticNetParam=1.0, maxIter=ITERATIONS, standardization=False
    ).fit(weighed)
    weights = [float(w) for w in lasso.coefficients]
    return RuleEnsemble(
        tuple(names), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept)
    )


def classify_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every document.

    ``learn`` is a condition on `doc_id` that says whose labels may be used.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = scratch.save(measure(rows).select("doc_id", "_stats"), "counted")
    of = features(F.col("_stats"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(
        F.col("label").isin(0, 1) & learn
    )
    labelled = counted.join(known, "doc_id").select("label", *[c.alias(n) for n, c in of.items()])
    model = fit_rule_ensemble(labelled, list(of), scratch)
    score = model.score(of)
    return counted.select("doc_id", (~learn).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
