"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule says good (1), bad (-1) or nothing (0).  The rules' accuracies and the share
of good documents are estimated from all votes together, without labels, and a
document is kept if its posterior probability of being good reaches a threshold.  All
text work and all counting is Spark SQL; what reaches the driver is one row per
distinct vote pattern, at most 3 to the power of the number of rules.

Defined results.  A null or empty text has no words: its counts are 0 and
`base_failed` is true.  Null ids, repeated rows and extra columns pass through
unchanged; every input row gives one row.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.llm.common import SPACE_CHARS, Scratch, free_name, word_list

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"  # fixed value of the base counts
ROUNDS = 50
PRIOR_BOUNDS = (0.5, 0.98)  # good documents are taken to be the majority
SMOOTH = 1.0  # added to each count of votes


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside 5-word windows that occur at least twice.

    Windows of equal hash are only a reason to look: then the windows themselves are
    sorted, equal neighbours found, and the covered positions counted from the starts.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.array_sort(
        F.transform(
            starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i"))
        )
    )

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        return F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))

    found = F.get(F.transform(F.array(windows), twice), F.lit(0))
    places = F.array_sort(F.transform(found, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")
        ),
        lambda a: a["n"],
    )
    return (
        F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered)
        .otherwise(F.lit(0))
        .cast("long")
    )


def measure(docs: DataFrame, text_col: str = "text", out: str = "_stats") -> DataFrame:
    """Add one struct column of counts per text; the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = free_name(docs, "_words")
    cut = docs.withColumn(raw, word_list(F.col(text_col)))
    hashes = free_name(cut, "_hashes")
    words = F.col(raw)
    window_hash = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    cut = cut.withColumn(
        hashes,
        F.when(
            F.size(words) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window_hash),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    ends = F.filter(lines, lambda x: F.rtrim(x).rlike("[.!?\"'»”…]$"))
    return cut.withColumn(
        out,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(ends).cast("long").alias("n_ended_lines"),
            _repeat_words(words, F.col(hashes)).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            F.size(F.filter(words, lambda w: ~w.rlike("\\p{L}"))).cast("long").alias("n_plain_words"),
            F.length(F.regexp_replace(text, "\\P{Lu}+", "")).cast("long").alias("n_upper"),
            (F.length(text) - F.length(F.translate(text, "!?", ""))).cast("long").alias("n_marks"),
        ),
    ).drop(raw, hashes)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def votes(s: Column) -> dict[str, Column]:
    """The rules: each a column of 1, -1 or 0 over the counts of a text."""
    n = F.greatest(s["n_words"], F.lit(1))
    chars = F.greatest(s["word_chars"], F.lit(1))
    lines = F.greatest(s["n_lines"], F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = chars / n
    return {
        "length": rule(s["n_words"] >= 20, s["n_words"] < 5),
        "word_length": rule((mean >= 3.5) & (mean <= 8), (mean < 2.5) | (mean > 12)),
        "symbols": rule(100 * s["n_symbols"] <= 1 * n, 100 * s["n_symbols"] > 10 * n),
        "symbol_words": rule(s["n_symbols"] == 0, 4 * s["n_symbols"] > n),
        "symbol_chars": rule(1000 * s["n_symbols"] <= chars, 20 * s["n_symbols"] > chars),
        "upper": rule(100 * s["n_upper"] <= 10 * chars, 100 * s["n_upper"] > 30 * chars),
        "marks": rule(100 * s["n_marks"] <= 2 * n, 100 * s["n_marks"] > 20 * n),
        "letters": rule(100 * s["n_plain_words"] <= 5 * n, 100 * s["n_plain_words"] > 35 * n),
        "line_ends": rule(2 * s["n_ended_lines"] >= lines, 10 * s["n_ended_lines"] < lines),
        "same_lines": rule(s["n_dup_lines"] == 0, 2 * s["n_dup_lines"] > lines),
        "same_words": rule(
            10 * s["n_distinct_words"] >= 3 * n,
            (10 * s["n_distinct_words"] < n) | ((s["n_words"] >= 20) & (5 * s["n_distinct_words"] < n)),
        ),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, per rule, what a good and a bad vote weigh (log odds)."""

    prior: float
    weights: dict[str, tuple[float, float]]

    def posterior(self, vote: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (good, bad) in self.weights.items():
            odds = odds + F.when(vote[name] == 1, F.lit(good)).when(vote[name] == -1, F.lit(bad)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def expectation_maximisation(
    names: list[str], patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS
) -> LabelModel:
    """Fit the prior and the rules' accuracies on good and on bad documents to counted vote patterns.

    A rule has one accuracy per class, because an alarm that is rare among good documents
    says much although its silence says little; abstaining says nothing.  It starts from
    "a document with a bad vote is probably bad", and no vote may come to count against
    its own meaning.
    """
    total = sum(count for _, count in patterns)
    post = [0.1 if -1 in vote else 0.95 for vote, _ in patterns]
    prior, weights = 0.9, [(0.0, 0.0)] * len(names)
    for _ in range(rounds if total else 0):
        prior = sum(p * c for p, (_, c) in zip(post, patterns, strict=True)) / total
        prior = min(max(prior, PRIOR_BOUNDS[0]), PRIOR_BOUNDS[1])
        weights = []
        for j in range(len(names)):
            seen = {(y, v): SMOOTH for y in (0, 1) for v in (-1, 1)}
            for p, (vote, count) in zip(post, patterns, strict=True):
                if vote[j]:
                    seen[1, vote[j]] += p * count
                    seen[0, vote[j]] += (1 - p) * count
            on_good = seen[1, 1] / (seen[1, 1] + seen[1, -1])
            on_bad = seen[0, -1] / (seen[0, 1] + seen[0, -1])
            weights.append(
                (max(0.0, math.log(on_good / (1 - on_bad))), min(0.0, math.log((1 - on_good) / on_bad)))
            )
        for k, (vote, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior))
            odds += sum(w[v < 0] for v, w in zip(vote, weights, strict=True) if v)
            post[k] = 1 / (1 + math.exp(-odds))
    return LabelModel(prior, dict(zip(names, weights, strict=True)))


def fit(measured: DataFrame, stats: str = "_stats") -> LabelModel:
    """Count the vote patterns of all documents and run the maximisation on the counts."""
    rules = votes(F.col(stats))
    counted = (
        measured.select(*[v.alias(k) for k, v in rules.items()]).groupBy(*rules).agg(F.count("*").alias("n"))
    )
    rows = sorted((tuple(r[k] for k in rules), r["n"]) for r in counted.collect())
    return expectation_maximisation(list(rules), rows)


def quality_rules(
    docs: DataFrame,
    scratch: Scratch,
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    threshold: float = 0.5,
    out: str = "_quality",
) -> DataFrame:
    """Columns ``keep`` (all by default) plus struct ``out``: counts, `base_failed`, `posterior`, `kept`.

    The counts are written once and both the fit and the verdict read them.  Also, a
    filter on the verdict then cannot be pushed below the counting, where Spark would
    repeat the text work for every use of a count.
    """
    stats = free_name(docs, "_stats")
    columns = list(docs.columns if keep is None else keep)
    measured = scratch.save(measure(docs, text_col, stats).select(*columns, stats), "measured")
    s = F.col(stats)
    posterior, failed = fit(measured, stats).posterior(votes(s)), base_failed(s)
    return measured.withColumn(
        out,
        F.struct(
            f"{stats}.*", failed.alias("base_failed"), posterior.alias("posterior"),
            (~failed & (posterior >= threshold)).alias("kept"),
        ),
    ).drop(stats)
