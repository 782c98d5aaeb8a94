"""TF-IDF vectors as long tables, exact neighbour pairs, nearest labelled pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from log_templates.functions.text import bind, word_tokens
from log_templates.tables import Scratch, fits_broadcast

# A vector with more pairs of rare terms than this meets its neighbours at single terms.
HOT_TERM = 1_000
# A vocabulary of at most so many terms is sent to the tasks; of a larger one its hot terms are.
MAX_VOCABULARY = 1_000_000
HOT_TERMS = 10_000
# Tolerance at the similarity limit, so that rounding does not decide.
SLACK = 1e-9


def _bag(tokens: Column) -> Column:
    """``(term, tf)`` of the tokens of one row."""
    def counted(words: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
        )
        return bind(
            first,
            lambda places: F.transform(
                places,
                lambda i, n: F.struct(
                    F.get(words, i).alias("term"),
                    (F.coalesce(F.get(places, n + 1), F.size(words)) - i).cast("bigint").alias("tf"),
                ),
            ),
        )

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return bind(F.sort_array(F.array_compact(tokens)), lambda words: F.when(F.size(words) > 0, counted(words)).otherwise(none))


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, null as a value like others."""
    names = {key: f"_of{key}" for key in keys}
    same = F.lit(True)
    for key, name in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def _bags(docs: DataFrame, id_col: str, tokens_col: str, by: list[str], copies: Column, scratch: Scratch) -> DataFrame:
    """``id, _copies, _bag``: the term counts of every id, each term of an id in one row only.

    A row is counted where it is.  Only rows that share their id are shuffled, term by term.
    """
    keys = [*by, id_col]
    placed = docs.select(*keys, F.col(tokens_col).alias("_tokens"), copies.alias("_copies"))
    repeated = scratch.save(placed.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1").drop("_rows"), "repeated")
    counted = placed.withColumn("_bag", _bag(F.col("_tokens"))).drop("_tokens")
    if not repeated.isEmpty():
        shared = _join(counted, repeated, keys, "left_semi")
        merged = (
            shared.select(*keys, "_copies", F.explode("_bag").alias("_b"))
            .groupBy(*keys, F.col("_b.term").alias("_term"))
            .agg(F.first("_copies").alias("_copies"), F.sum("_b.tf").alias("_tf"))
            .select(*keys, "_copies", F.array(F.struct(F.col("_term").alias("term"), F.col("_tf").alias("tf"))).alias("_bag"))
        )
        counted = _join(counted, repeated, keys, "left_anti").unionByName(merged)
    return scratch.save(counted, "bags-of-terms", wide=True)


def _weighed(
    docs: DataFrame, id_col: str, tokens_col: str, by: list[str], copies_col: str | None, scratch: Scratch
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Term counts ``id, _bag`` and what turns such rows, with further columns, into ``id, term, df, _raw``.

    ``_raw`` is tf * (ln((1 + n) / (1 + df)) + 1).  The weight of a term comes to where the rows are; only
    rare terms of a vocabulary too large to be sent are met by a shuffle.
    """
    copies = F.col(copies_col).cast("bigint") if copies_col else F.lit(1).cast("bigint")
    bags = _bags(docs, id_col, tokens_col, by, copies, scratch)
    found = (
        bags.select(*by, "_copies", F.explode("_bag.term").alias("term"))
        .groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("_copies").alias("_df"))
    )
    total = docs.groupBy(*by).agg(F.sum(copies).alias("_n"))
    found = found.join(total, by) if by else found.withColumn("_n", total.scalar())
    idf = F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1
    vocabulary = scratch.save(found.select(*by, "term", "df", idf.alias("_idf")), "vocabulary")

    def weighed(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("_bag", "_copies")]
        tf = rows.select(*kept, F.explode("_bag").alias("_b")).select(*kept, "_b.term", F.col("_b.tf").alias("_tf"))
        return _with_idf(tf, vocabulary, by, scratch).select(
            *kept, "term", "df", (F.col("_tf") * F.col("_idf")).alias("_raw")
        )

    return bags, weighed


def packed_vectors(
    docs: DataFrame,
    id_col: str = "line_id",
    tokens_col: str = "tokens",
    by: Sequence[str] = (),
    copies_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: ``id, ranked, terms, total`` with ``ranked`` an array of ``(df, term, weight)``.

    The vectors are those of `tfidf`; ``ranked`` is sorted by the number of rows with the
    term, ``total`` is the sum of weights.
    """
    by = list(by)
    scratch = scratch or Scratch(docs.sparkSession, "vectors")
    bags, weighed = _weighed(docs, id_col, tokens_col, by, copies_col, scratch)
    packs = (
        weighed(bags.repartition(id_col))
        .groupBy(*by, id_col)
        .agg(
            F.sort_array(F.collect_list(F.struct("df", "term", F.col("_raw").alias("weight")))).alias("_items"),
            F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_length"),
            F.count("*").alias("terms"),
            F.sum("_raw").alias("_sum"),
        )
    )
    unit = lambda i: F.struct(
        i["df"].alias("df"), i["term"].alias("term"), (i["weight"] / F.col("_length")).alias("weight")
    )
    return packs.select(
        *by, id_col, F.transform("_items", unit).alias("ranked"), "terms", (F.col("_sum") / F.col("_length")).alias("total")
    )


def _with_idf(tf: DataFrame, vocabulary: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """Join term counts with the vocabulary where they are, if the vocabulary or its hot part fits.

    Beyond the bound the exact counts name the hot terms: those in more than one
    `HOT_TERMS`-th of all postings, so there are fewer than `HOT_TERMS` of them.  They are sent to the rows; the
    rows of all other terms are shuffled, where no term is larger than that share.
    """
    keys = [*by, "term"]
    if fits_broadcast(vocabulary, ["term"], MAX_VOCABULARY):
        return tf.join(F.broadcast(vocabulary), keys)
    postings = vocabulary.agg(F.sum("df")).first()[0]
    hot = F.col("df") > postings / HOT_TERMS
    counted = scratch.save(tf, "term-counts")
    cold = counted.join(vocabulary.where(~hot), keys)
    return counted.join(F.broadcast(vocabulary.where(hot)), keys).unionByName(cold)


def tfidf(
    docs: DataFrame,
    id_col: str = "line_id",
    tokens_col: str = "tokens",
    by: Sequence[str] = (),
    copies_col: str | None = None,
) -> DataFrame:
    """``id, term, weight``: tf * (ln((1 + n) / (1 + df)) + 1), unit length per document.

    ``copies_col`` lets one row stand for several equal documents.
    """
    by = list(by)
    bags, weighed = _weighed(docs, id_col, tokens_col, by, copies_col, Scratch(docs.sparkSession, "vectors"))
    # The lengths meet the counts of a row before its terms are rows, so nothing sorts or groups terms.
    squares = weighed(bags).groupBy(*by, id_col).agg(F.sum(F.col("_raw") * F.col("_raw")).alias("_squares"))
    known = _join(bags, squares, [*by, id_col]).withColumn("_length", F.sqrt("_squares"))
    return weighed(known).select(*by, id_col, "term", (F.col("_raw") / F.col("_length")).alias("weight"))


def pack(vectors: DataFrame, id_col: str = "line_id", by: Sequence[str] = ()) -> DataFrame:
    """Long vectors ``id, term, weight`` as `packed_vectors` gives them."""
    by = list(by)
    per_term = vectors.groupBy(*by, "term").agg(F.count("*").alias("df"))
    return (
        vectors.join(per_term, [*by, "term"])
        .groupBy(*by, id_col)
        .agg(
            F.sort_array(F.collect_list(F.struct("df", "term", "weight"))).alias("ranked"),
            F.count("*").alias("terms"),
            F.sum("weight").alias("total"),
        )
    )


def by_term(ranked: str) -> Column:
    """The ``(term, weight)`` of a packed vector."""
    return F.transform(ranked, lambda i: F.struct(i["term"].alias("term"), i["weight"].alias("weight")))


def dot(left: Column, right: Column) -> Column:
    """Dot product of two arrays of ``(term, weight)``.

    Both are merged in term order, where shared terms become neighbours.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("term"),
        F.lit(0.0).alias("weight"),
        F.lit(0.0).alias("total"),
    )

    def fold(state: Column, item: Column) -> Column:
        shared = F.when(state["term"] == item["term"], state["weight"] * item["weight"])
        return F.struct(
            item["term"].alias("term"),
            item["weight"].alias("weight"),
            (state["total"] + F.coalesce(shared, F.lit(0.0))).alias("total"),
        )

    return F.aggregate(
        F.sort_array(F.concat(left, right)), start, fold, lambda state: state["total"]
    )


def _prefix(items: Column, cos: float) -> Column:
    """The rarest terms of a vector, among them the two rarest that it shares with any neighbour.

    It ends where what is left and the heaviest term before are too short together to reach ``cos``.
    ``rest`` is the squared length after a term, which is known by its hash.
    """
    start = F.struct(
        F.array().cast("array<struct<term:bigint,weight:double,rest:double>>").alias("terms"),
        F.lit(1.0).alias("rest"),
        F.lit(0.0).alias("top"),
    )

    def further(state: Column, item: Column) -> Column:
        square = item["weight"] * item["weight"]
        rest = F.greatest(state["rest"] - square, F.lit(0.0))
        one = F.struct(F.xxhash64(item["term"]).alias("term"), item["weight"].alias("weight"), rest.alias("rest"))
        return F.when(state["rest"] + state["top"] < cos * cos * 0.9999, state).otherwise(
            F.struct(
                F.concat(state["terms"], F.array(one)).alias("terms"),
                rest.alias("rest"),
                F.greatest(state["top"], square).alias("top"),
            )
        )

    return F.aggregate(items, start, further, lambda state: state["terms"])


def _key(one: Column, two: Column | str, rest: Column) -> Column:
    """A blocking key of two terms, or of one and a name of the kind, with the weights a pair is judged by."""
    second, weight = (F.lit(two), F.lit(0.0)) if isinstance(two, str) else (two["term"], two["weight"])
    return F.struct(
        F.xxhash64(one["term"], second, F.lit(isinstance(two, str))).alias("key"),
        one["weight"].alias("one"),
        weight.alias("two"),
        rest.alias("rest"),
    )


def _pair_keys(prefix: Column) -> Column:
    """All pairs of terms of a prefix, the rarer one first."""
    return F.flatten(
        F.transform(
            prefix,
            lambda i, n: F.transform(F.slice(prefix, n + 2, F.size(prefix)), lambda j: _key(i, j, j["rest"])),
        )
    )


def _rarest(prefix: Column, cos: float) -> Column:
    """The part of a prefix that holds the rarest term shared with any neighbour."""
    return F.filter(prefix, lambda i: i["rest"] + i["weight"] * i["weight"] >= cos * cos * 0.9998)


def similar_pairs(
    vectors: DataFrame,
    eps: float = 0.1,
    id_col: str = "line_id",
    by: Sequence[str] = (),
    hot_term: int = HOT_TERM,
    scratch: Scratch | None = None,
    probe: str | None = None,
) -> DataFrame:
    """Every pair ``a < b`` of unit vectors within Euclidean distance ``eps``: ``a, b, cos``.

    ``vectors`` are long, or packed and written.  With ``probe``, a boolean column of packed vectors, only pairs
    with at least one vector that has it.

    Exact.  Neighbours meet at the two rarest terms that they share, which lie in the `_prefix` of both.  Two kinds
    of vectors look their neighbours up by one term instead: those that are little more than one term, by that term
    in vectors where it weighs enough, and those with more than ``hot_term`` pairs of terms, by the rarest
    shared term.  Where two vectors meet, the weights there and what is left after them must allow the
    similarity.  Keys travel with ids and weights; the vectors follow for the candidates that are left.
    """
    by = list(by)
    cos = 1 - eps * eps / 2
    scratch = scratch or Scratch(vectors.sparkSession, "pairs")
    packs = vectors if "ranked" in vectors.columns else scratch.save(pack(vectors, id_col, by), "packs")
    # A vector this near to one term has neighbours in which that term weighs at least `floor`.
    alone = (cos * cos * 0.9999 - 1e-9) ** 0.5
    floor = max(2 * cos * cos - 1 - 0.001, 0.0)
    facts = packs.select(
        *by,
        F.col(id_col).alias("id"),
        F.col("terms").alias("n"),
        F.col("total"),
        (F.expr(probe) if probe else F.lit(True)).alias("probe"),
        _prefix(F.col("ranked"), cos).alias("prefix"),
        F.transform(
            F.filter("ranked", lambda i: i["weight"] >= floor),
            lambda i: F.struct(
                F.xxhash64(i["term"]).alias("term"), i["weight"].alias("weight"), (1 - i["weight"] * i["weight"]).alias("rest")
            ),
        ).alias("heavy"),
        F.exists("ranked", lambda i: i["weight"] >= alone).alias("lone"),
    )
    facts_saved = scratch.save(facts, "prefixes")
    many = F.size("prefix") * (F.size("prefix") - 1) / 2 > hot_term
    facts = facts_saved.withColumn("long", ~F.col("lone") & many)

    def posted(some: DataFrame, keys: Column, asks: bool) -> DataFrame:
        return some.select(*by, "id", "n", "total", "probe", F.lit(asks).alias("asks"), F.explode(keys).alias("k")).select(
            *by, "k.*", "id", "n", "total", "probe", "asks"
        )

    lone_key = lambda i: _key(i, "lone", i["rest"])
    long_key = lambda i: _key(i, "long", i["rest"])
    rarest = _rarest(F.col("prefix"), cos)
    sought = F.filter("heavy", lambda i: i["weight"] >= alone) if floor > 0 else F.transform(
        rarest, lambda i: F.struct(i["term"], i["weight"], (1 - i["weight"] * i["weight"]).alias("rest"))
    )
    single = F.when(F.col("lone"), F.transform(sought, lone_key)).otherwise(F.transform(rarest, long_key))
    wanted = scratch.save(posted(facts.where("lone or long"), single, True), "singles")
    keys = wanted.select(*by, "key").distinct()
    if fits_broadcast(keys):
        keys = F.broadcast(keys)
    owned = F.concat(F.transform("heavy", lone_key), F.transform(rarest, long_key))
    posts = (
        posted(facts.where("not lone and not long"), _pair_keys(F.col("prefix")), True)
        .unionByName(wanted)
        .unionByName(posted(facts, owned, False).join(keys, [*by, "key"], "left_semi").select(*wanted.columns))
    )
    side = lambda name: posts.select(*by, "key", *(F.col(c).alias(f"{c}_{name}") for c in posts.columns if c not in (*by, "key")))
    # What the shared terms and the rest of both vectors can give at most.
    most = (
        F.col("one_a") * F.col("one_b")
        + F.col("two_a") * F.col("two_b")
        + F.sqrt(F.greatest(F.col("rest_a") * F.col("rest_b"), F.lit(0.0)))
    )
    # Weights that differ in sum by more than this cannot be within eps (Cauchy-Schwarz).
    gap = F.col("total_a") - F.col("total_b")
    same_length = gap * gap <= (eps * eps + 1e-6) * (F.col("n_a") + F.col("n_b"))
    candidates = scratch.save(
        side("a").join(side("b"), [*by, "key"])
        .where((F.col("id_a") < F.col("id_b")) & same_length & (most >= cos - 1e-6))
        .where((F.col("asks_a") | F.col("asks_b")) & (F.col("probe_a") | F.col("probe_b")))
        .select(*by, F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        .distinct(),
        "candidates", wide=True
    )
    scratch.free(facts_saved, wanted)
    items = packs.select(*by, F.col(id_col).alias("_id"), F.col("ranked").alias("_items"))
    left = items.withColumnsRenamed({"_id": "a", "_items": "_left"})
    right = items.withColumnsRenamed({"_id": "b", "_items": "_right"})
    return (
        candidates.join(left, [*by, "a"])
        .join(right, [*by, "b"])
        .select(*by, "a", "b", dot(by_term("_left"), by_term("_right")).alias("cos"))
        .where(F.col("cos") >= cos - SLACK)
    )


def nearest_pairs(
    logs: DataFrame,
    pairs: DataFrame,
    k: int,
    id_col: str = "line_id",
    content_col: str = "content",
    pair_id_col: str = "pair_id",
    decimals: int = 9,
) -> DataFrame:
    """The ``k`` labelled pairs nearest to each line by cosine, best first.

    ``pairs`` has ``pair_id, log, template``.  Document frequencies are taken
    once over the distinct lines and the pairs together.  Ranking rounds the
    cosine to ``decimals`` and breaks ties by pair id.  A line that shares no
    term with any pair gets the first pairs by id at cosine 0.
    """
    lines = logs.select(F.col(content_col).alias("_text")).distinct()
    docs = lines.select(F.lit(0).alias("_side"), F.col("_text").alias("_key")).unionByName(
        pairs.select(F.lit(1).alias("_side"), F.col(pair_id_col).cast("string").alias("_key"), "log"),
        allowMissingColumns=True,
    )
    docs = docs.select(
        F.struct("_side", "_key").alias("_doc"),
        word_tokens(F.coalesce("log", "_key")).alias("tokens"),
    )
    vectors = tfidf(docs, "_doc", "tokens")
    left = vectors.where(F.col("_doc._side") == 0).select(
        F.col("_doc._key").alias("_text"), "term", F.col("weight").alias("_wa")
    )
    right = Scratch(logs.sparkSession, "nearest").save(
        vectors.where(F.col("_doc._side") == 1).select(F.col("_doc._key").alias("_pid"), "term", F.col("weight").alias("_wb"))
    )
    if fits_broadcast(right, ["_pid", "term"]):
        right = F.broadcast(right)
    shared = (
        left.join(right, "term")
        .groupBy("_text", "_pid")
        .agg(F.round(F.sum(F.col("_wa") * F.col("_wb")), decimals).alias("cos"))
        .select("_text", F.col("_pid").cast(pairs.schema[pair_id_col].dataType).alias(pair_id_col), "cos")
    )
    # Pairs without a shared term have cosine 0; only the first k of them can rank.
    first = pairs.select(pair_id_col).orderBy(pair_id_col).limit(k)
    fillers = lines.select(
        "_text",
        F.explode(first.agg(F.collect_list(pair_id_col)).scalar()).alias(pair_id_col),
        F.lit(0.0).alias("cos"),
    )
    best = Window.partitionBy("_text").orderBy(F.col("cos").desc(), pair_id_col)
    ranked = (
        shared.unionByName(fillers)
        .groupBy("_text", pair_id_col)
        .agg(F.max("cos").alias("cos"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
    )
    return (
        logs.select(id_col, F.col(content_col).alias("_text"))
        .join(ranked, "_text")
        .join(pairs.select(pair_id_col, "log", "template"), pair_id_col)
        .select(id_col, "rank", pair_id_col, "log", "template", "cos")
    )
