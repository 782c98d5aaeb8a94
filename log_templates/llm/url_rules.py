"""URL filters: hand-written host and path rules, then association rules mined from labels.

A labelled url is a transaction of its tokens plus its verdict.  FP-growth finds the
combinations of tokens that occur often; those whose presence makes `block` likely enough
become rules.  Urls are matched by an inverted index: each rule is filed under its rarest
token, a url looks up its own tokens, and a found rule fires if the url has all of its
tokens.  Urls are first reduced to the tokens that rules use, so each distinct
combination is looked up once.

Everything is Spark SQL and Spark ML.  The mined tables are bounded by their support: a
token that is in at least a share `s` of the transactions is one of at most
`tokens per url / s`.

Defined results.  A null url and one without `://` have an empty host and path and no
tokens; no rule fits, and the verdict is `allow`.  Ids may be null or repeat: every row
gives a row.  Without labels nothing is mined and every url without a rule is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.llm.common import Scratch, ascii_lower, free_name
from log_templates.tables import fits_broadcast

MIN_SUPPORT, MIN_COUNT = 0.002, 20  # share and number of the labelled urls that have the combination
MIN_CONFIDENCE = 0.7
BLOCK, ALLOW = "=block", "=allow"

Rule = tuple[str, str, str]  # host, path, verdict


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels and their pairs, path segments with numbers as #, query names."""
    host, path = parts_of(url)
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    words = F.filter(F.split(host, "[.-]"), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "[?]([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    scheme = F.filter(F.array(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)), lambda x: (x != "") & (host != ""))
    tag = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(
        F.concat(
            tag("scheme:", scheme), tag("host:", labels), tag("word:", words),
            tag("path:", F.transform(segments, lambda x: F.regexp_replace(x, "[0-9]+", "#"))), tag("query:", names),
        )
    )


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; a rule fits its host and all subdomains."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))

    def choose(value) -> Column:
        out = None
        for h, p, v in ordered:
            fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            out = F.when(fits, F.lit(value(h, p, v))) if out is None else out.when(fits, F.lit(value(h, p, v)))
        return out

    return choose(lambda h, p, v: h + p), choose(lambda h, p, v: v)


def mine(
    labelled: DataFrame, url_col: str = "url", block_col: str = "block", min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """`tokens, confidence, index_token` of the rules that say block."""
    verdict = F.when(F.col(block_col), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    baskets = labelled.where(F.col(block_col).isNotNull()).select(
        F.array_append(tokens_of(F.col(url_col)), verdict).alias("items")
    )
    support = max(min_support, MIN_COUNT / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == BLOCK).select(
        F.array_sort("antecedent").alias("tokens"), "confidence"
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    named = rules.withColumn("token", F.explode("tokens")).join(single, "token")
    return named.groupBy("tokens", "confidence").agg(F.min(F.struct("freq", "token")).alias("rare")).select(
        "tokens", "confidence", F.col("rare.token").alias("index_token")
    )


def filter_urls(
    pages: DataFrame, labelled: DataFrame, scratch: Scratch, rules: Sequence[Rule] = (), url_col: str = "url",
    out: str = "_url", **limits: float,
) -> DataFrame:
    """All columns of ``pages`` plus struct ``out``: `host, path, rule, verdict, confidence`."""
    index = scratch.save(mine(labelled, url_col, **limits), "rules")
    # the distinct tokens of the mined rules: few, because each has its support
    vocabulary = sorted(r[0] for r in index.select(F.explode("tokens")).distinct().collect())
    mark = free_name(pages, "_combination")
    used = F.array(*[F.lit(t) for t in vocabulary]).cast("array<string>")
    seen = pages.withColumn(mark, F.array_sort(F.array_intersect(tokens_of(F.col(url_col)), used)))
    combinations = seen.where(F.size(mark) > 0).select(F.col(mark).alias("tokens_seen")).distinct()
    found = (
        combinations.withColumn("index_token", F.explode("tokens_seen"))
        .join(index, "index_token")
        .where(F.size(F.array_except("tokens", "tokens_seen")) == 0)
        .groupBy("tokens_seen")
        .agg(F.max("confidence").alias("confidence"))
    )
    found = scratch.save(found, "found")
    small = F.broadcast(found) if fits_broadcast(found) else found
    conf, key = free_name(seen, "_confidence"), free_name(seen, "_seen")
    small = small.select(F.col("tokens_seen").alias(key), F.col("confidence").alias(conf))
    joined = seen.join(small, seen[mark] == small[key], "left")
    host, path = parts_of(F.col(url_col))
    rule, said = rule_of(host, path, rules)
    verdict = F.coalesce(said, F.when(F.col(conf).isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.withColumn(
        out,
        F.struct(
            host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"),
            F.col(conf).alias("confidence"),
        ),
    ).drop(mark, key, conf)
