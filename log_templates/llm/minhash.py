"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters the shingles over the
ring of 2^32 places, the second is read from a start that moves one place per
coordinate.  Bands of coordinates bucket the documents; the number of bands follows
from the threshold, so that a pair at the threshold is missed with a probability below
`MISS`.  Every link is confirmed on the full shingle sets.

Buckets of at most `SMALL_BUCKET` documents give their pairs, each compared once however many
buckets it is in.  Pairs of larger buckets are not listed.  Their documents are compared
with one leader, the one with most company over all buckets.  Buckets whose
documents then form one component are done.  In the others only documents outside the
largest component are compared with the rest, in blocks of bounded size
that return one link per newly joined pair of components.  So no link between candidates is lost,
no group is capped, and a group of thousands of near copies costs a few passes.

A pair is looked at in three steps of growing cost: numbers of shingles, then the share of
equal signature coordinates (one byte of each travels with a document), then the full
sets.  The second step drops only pairs whose share lies seven standard deviations below that of
a pair at the threshold.

Defined results.  A null or empty text has an empty set and no links.  A text with fewer
words than the shingle size is one shingle.  Equal sets are linked.  A row with a null id
cannot be linked: its `component_id` is null and it is kept.  Rows that repeat an id
each give a row; with different texts each has the links of its own text.  `first` marks
one text of each component: of its rows with the smallest id, those with the smallest text key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.llm.common import Scratch, slices
from log_templates.llm.shingles import WordHashes, overlap, shingle_set
from log_templates.operators.components import connected_components

MISS = 1e-6
SHINGLE, PERCENT = 5, 80
SMALL_BUCKET = 8
BLOCK_DOCS, BLOCK_SHINGLES = 400, 200_000  # of one side of a block
MEMBERS_PER_SALT = 100  # of one leader in one join key
SPREAD = 7  # standard deviations below the expected share of equal coordinates

_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the ring of 2^32 places."""
    x = (x ^ (x >> np.uint32(16))) * _M1
    x = (x ^ (x >> np.uint32(13))) * _M2
    return x ^ (x >> np.uint32(16))


def bands_for(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and coordinates per band: a pair at the threshold is missed less often than ``miss``."""
    t = percent / 100
    rows = max(1, min(6, math.floor(math.log(0.3) / math.log(t)) if t < 1 else 6))
    return math.ceil(math.log(miss) / math.log(1 - t**rows)) if t < 1 else 1, rows


def least_equal(percent: int, coordinates: int) -> int:
    """Equal coordinates below which a pair at the threshold practically never lies."""
    t = percent / 100
    return math.floor(coordinates * t - SPREAD * math.sqrt(coordinates * t * (1 - t)))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row per set."""
    start = np.cumsum([0] + [len(s) for s in sets])[:-1]
    ring = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    scattered = _permute(ring ^ np.uint32(0x5BD1E995))
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_permute(scattered - np.uint32(k)), start)
    return out


def _sign(size: int, bands: int, rows: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("text_key", pa.string()), ("n_shingles", pa.int64()), ("set_key", pa.string()),
            ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            sets = [shingle_set(t, size, hashes) for t in part.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            keys = iter(())
            if full:
                sig = signatures(full, bands * rows)
                keys = iter(
                    [
                        (
                            [xxhash.xxh3_64_intdigest(row[b * rows : (b + 1) * rows].tobytes(), seed=b) - 2**63 for b in range(bands)],
                            (row & np.uint32(255)).astype(np.uint8).tobytes(),
                        )
                        for row in sig
                    ]
                )
            digest = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            banded, sketch = zip(*(next(keys) if len(s) else ([], None) for s in sets), strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()), part.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.string()),
                    pa.array(banded, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
                ],
                schema=schema,
            )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(size: int, percent: int):
    """Keep the pairs (a, b) whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, last_set = WordHashes(), None, None
        for part in slices(batches):
            left, right = [], []
            for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if ta != last:
                    last, last_set = ta, shingle_set(ta, size, hashes)
                if _linked(last_set, shingle_set(tb, size, hashes), percent):
                    left.append(a)
                    right.append(b)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    return run


def _alike(least: int):
    """Keep the pairs (a, b) whose sketches agree in enough places."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                left, right = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    for c in ("sketch_a", "sketch_b")
                )
                keep = pa.array((left == right).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], schema=schema)

    return run


def _block_seekers(least: int):
    """Within one block, the nodes whose sketch is like that of a node of another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "seeks"])
        mine, all_ = pdf[pdf["seeks"]], pdf[~pdf["seeks"]]
        found: set[int] = set()
        if len(mine) and len(all_):
            table = np.vstack([np.frombuffer(x, np.uint8) for x in all_["sketch"]])
            nodes, comps = all_["node"].to_numpy(), all_["comp"].to_numpy()
            for node, comp, sketch in zip(mine["node"], mine["comp"], mine["sketch"], strict=True):
                hit = ((table == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= least) & (comps != comp)
                if hit.any():
                    found.add(node)
                    found.update(nodes[hit].tolist())
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "node": sorted(found)}).astype("int64")

    return run


def _block_links(size: int, percent: int):
    """Within one block, link components of seekers to components of others; few rows come out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, parent, out = WordHashes(), {}, []
        pdf = pdf.drop_duplicates(["node", "seeks"])
        sets = {d: shingle_set(t, size, hashes) for d, t in zip(pdf["node"], pdf["text"], strict=True)}
        comp = dict(zip(pdf["node"], pdf["comp"], strict=True))

        def root(c: int) -> int:
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        seekers = pdf.loc[pdf["seeks"], "node"].tolist()
        others = pdf.loc[~pdf["seeks"], "node"].tolist()
        if seekers and others:
            flat = np.concatenate([sets[d] for d in others])
            values, place = np.unique(flat, return_inverse=True)
            start = np.cumsum([0] + [len(sets[d]) for d in others])[:-1]
            sizes = np.array([len(sets[d]) for d in others])
            for d in seekers:
                mine = sets[d]
                at = np.searchsorted(values, mine)
                at[at == len(values)] = 0
                flag = np.zeros(len(values), np.int64)
                flag[at[values[at] == mine]] = 1
                both = np.add.reduceat(flag[place], start)
                for j in np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)):
                    x, y = root(comp[d]), root(comp[others[j]])
                    if x != y:
                        parent[x] = y
                        out.append((d, others[j]))
        return pd.DataFrame({"a": [x for x, _ in out], "b": [y for _, y in out]}, dtype="int64")

    return run


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Fetch a value of both nodes; a leader of many members is split over salted keys."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_PER_SALT).cast("int").alias("salts"))
    left = (
        values.withColumnsRenamed({"node": "a", name: f"{name}_a"})
        .join(load, "a")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    )
    right = pairs.join(load, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    right = right.drop("salts").join(values.withColumnsRenamed({"node": "b", name: f"{name}_b"}), "b")
    return right.join(left.drop("salts"), ["a", "salt"]).select("a", "b", f"{name}_a", f"{name}_b")


def minhash_components(
    docs: DataFrame,
    scratch: Scratch,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept, text_key, first`: one row per input row."""
    bands, rows = bands_for(percent)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "text_key", text_key("text")
    )
    signed = scratch.save(
        plain.mapInArrow(
            _sign(shingle, bands, rows),
            "doc_id long, text_key string, n_shingles long, set_key string, bands array<long>, sketch binary",
        ),
        "signed",
    )
    known = signed.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # one node for each distinct set, found by its smallest row
    sets = known.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("row"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"),
    )
    sets = scratch.save(
        sets.select(F.monotonically_increasing_id().alias("node"), "set_key", "row.*", "n_shingles", "bands", "sketch"),
        "sets",
    )
    band_rows = sets.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = band_rows.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    members = scratch.save(band_rows.join(shared, "bucket"), "members")
    large = members.where(F.col("held") > SMALL_BUCKET)
    sketches = sets.select("node", "sketch")
    least = least_equal(percent, bands * rows)

    pairs = _pairs_of_small(members.where(F.col("held") <= SMALL_BUCKET), percent).unionByName(
        _pairs_with_leaders(large, percent)
    )
    pairs = scratch.save(pairs.distinct(), "pairs")
    alike = scratch.save(_with_both(pairs, sketches, "sketch").mapInArrow(_alike(least), "a long, b long"), "alike")
    texts = _texts(plain, sets, alike.select(F.explode(F.array("a", "b")).alias("node")).distinct(), scratch)
    links = scratch.save(
        _with_both(alike, texts, "text").mapInArrow(_confirm(shingle, percent), "a long, b long"), "links"
    )
    scratch.free(pairs, alike)

    # of large buckets only the nodes stay that are like one of another component
    open_ = _open_buckets(large, connected_components(links, scratch), scratch)
    seekers = _blocks(_shaped(open_)).join(sketches, "node").groupBy("bucket", "i", "j")
    found = seekers.applyInPandas(_block_seekers(least), "bucket long, node long").distinct()
    left = scratch.save(open_.join(found, ["bucket", "node"], "left_semi"), "left")
    scratch.free(members, open_)
    blocks = scratch.save(_blocks(_shaped(left)), "blocks")
    missing = scratch.save(blocks.select("node").distinct().join(texts, "node", "left_anti"), "missing")
    if not missing.isEmpty():
        texts = texts.unionByName(_texts(plain, sets, missing, scratch))
    blocked = blocks.join(texts, "node").groupBy("bucket", "i", "j")
    blocked = blocked.applyInPandas(_block_links(shingle, percent), "a long, b long")
    links = scratch.save(links.unionByName(blocked), "all-links")
    comps = scratch.save(connected_components(links, scratch), "components")

    of_set = sets.join(comps, "node", "left").select(
        "set_key", "doc_id", "text_key", F.coalesce("component", "node").alias("component")
    )
    lowest = of_set.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("lowest"))
    of_set = of_set.join(lowest, "component").select("set_key", "lowest")
    linked = known.join(of_set, "set_key").select(
        "doc_id", "n_shingles", F.col("lowest.doc_id").alias("component_id"), "text_key",
        (F.struct("doc_id", "text_key") == F.col("lowest")).alias("first"),
    )
    alone = signed.where(F.col("doc_id").isNull() | F.col("set_key").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.lit(True).alias("first")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def text_key(text: str) -> Column:
    """A digest of a text, by which rows that repeat an id are told apart."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _close(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pairs_of_small(members: DataFrame, percent: int) -> DataFrame:
    one, two = (
        members.select("bucket", F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}")) for x in ("a", "b")
    )
    return one.join(two, "bucket").where((F.col("a") < F.col("b")) & _close("na", "nb", percent)).select("a", "b")


def _pairs_with_leaders(members: DataFrame, percent: int) -> DataFrame:
    company = members.groupBy("node").agg(F.sum("held").alias("company"))
    order = F.struct(-F.col("company"), F.col("node"), F.col("n_shingles"))
    first = members.join(company, "node").groupBy("bucket").agg(F.min(order).alias("x"))
    first = first.select("bucket", F.col("x.node").alias("a"), F.col("x.n_shingles").alias("na"))
    near = members.join(first, "bucket").where((F.col("node") != F.col("a")) & _close("n_shingles", "na", percent))
    return near.select("a", F.col("node").alias("b"))


def _texts(plain: DataFrame, sets: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Node and text of some nodes."""
    keys = sets.join(nodes, "node", "left_semi").select("node", "doc_id", "text_key")
    found = plain.join(keys, ["doc_id", "text_key"]).select("node", "text")
    return scratch.save(found.dropDuplicates(["node"]), "texts")


def _open_buckets(members: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    now = members.join(comps, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("comp"))
    now = scratch.save(now, "now")
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    open_ = scratch.save(now.join(mixed.select("bucket"), "bucket", "left_semi"), "open")
    scratch.free(now)
    return open_


def _shaped(open_: DataFrame) -> DataFrame:
    """Rows of open buckets with the largest component and the number of blocks of their bucket."""
    per_comp = open_.groupBy("bucket", "comp").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("load")
    )
    total = per_comp.groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("load").alias("load")
    )
    outer = per_comp.join(total.select("bucket", F.col("top.comp").alias("top")), "bucket").where("comp != top")
    outer = outer.groupBy("bucket").agg(F.sum("n").alias("out_n"), F.sum("load").alias("out_load"))

    def parts(n: str, load: str):
        return F.greatest(F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(load) / BLOCK_SHINGLES)).cast("int")

    shape = total.join(outer, "bucket").select(
        "bucket", "n", F.col("top.comp").alias("top"), parts("n", "load").alias("all_parts"),
        parts("out_n", "out_load").alias("out_parts"),
    )
    return open_.join(shape, "bucket")


def _blocks(rows: DataFrame) -> DataFrame:
    """Nodes outside the largest component against all of their bucket, in blocks of bounded size."""
    place = lambda m: F.pmod(F.xxhash64("node", F.lit("block")), F.col(m)).cast("int")
    seek = rows.where("comp != top").select(
        "bucket", "node", "comp", F.lit(True).alias("seeks"), place("out_parts").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("j"),
    )
    rest = rows.select(
        "bucket", "node", "comp", F.lit(False).alias("seeks"),
        F.explode(F.sequence(F.lit(0), F.col("out_parts") - 1)).alias("i"), place("all_parts").alias("j"),
    )
    return seek.unionByName(rest)
