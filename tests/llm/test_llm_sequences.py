"""Packing, fill-in-the-middle and source divergence: brute force and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("log_templates.llm")

from log_templates.llm.common import Scratch, table
from log_templates.llm.divergence import source_divergence
from log_templates.llm.fill_middle import ExceptionIndex, Rates, fill_in_middle, restored
from log_templates.llm.oracle import OP13
from log_templates.llm.packing import Limits, WordIds, encode_examples, pack, pack_examples
from log_templates.llm.queries import QUERIES, WORD_MODEL, model_bytes

SCHEMA = "doc_id long, text string, lang string, source string, _fim string, id int, copy string, digest int"


def rows():
    long = " ".join(f"wörd{k}, 日本" for k in range(30_000))
    base = [
        (1, "one two  three "), (2, None), (3, ""), (4, " \t\n"), (5, "é 𝄞 naïve"), (6, "has <S> inside"), (7, long),
        (None, "no id"), (None, None), (8, "x"), (9, "tie a b c"), (10, "tie a b c"),
    ]
    base += [(11, "again and again")] * 3 + [(11, "same id, other text")]
    return [(i, t, None if k % 5 == 0 else "en", f"s{k % 3}", "q", 1, "c", 2) for k, (i, t) in enumerate(base)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


# --- fill-in-the-middle ------------------------------------------------------------------


def arranged(doc_id, text, whole=True):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    parts = units if whole else list(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    p, m, s = ("".join(x) for x in (parts[:low], parts[low:high], parts[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("whole", [True, False])
def test_fill_in_middle_equals_a_plain_version(spark, docs, whole):
    rng = random.Random(5)
    more = [
        (k, "".join(rng.choices(" \t\nabé日𝄞<>PSM", k=rng.randint(0, 40))), "en", "s", "q", 1, "c", 2)
        for k in range(100, 500)
    ]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    made = fill_in_middle(both, rates=Rates(at_chars=not whole))
    assert made.columns == [*(c for c in docs.columns if c != "_fim"), "_fim"]
    found = made.select("*", restored(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    assert len(found) == len(rows()) + 400
    for r in found:
        f = r["_fim"]
        assert (f.n, f.form, f.prefix_chars, f.middle_chars, f.output) == arranged(r.doc_id, r.text, whole)
        assert r.back == (r.text or "")
        if f.form != "plain":
            raw = r.text.encode()
            assert raw[: f.prefix_bytes].decode() == r.text[: f.prefix_chars]
            assert len(raw[f.prefix_bytes : f.prefix_bytes + f.middle_bytes].decode()) == f.middle_chars
    assert {r["_fim"].form for r in found} == {"plain", "psm", "spm"}


def test_exception_index_goes_both_ways():
    text = "añb日c𝄞 plain é"
    index = ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    at = index.to_byte(chars)
    assert at.tolist() == [len(text[:k].encode()) for k in chars]
    assert index.to_char(at).tolist() == chars.tolist()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert fill_in_middle(none).count() == 0
    assert source_divergence(none, Scratch(spark, "t")).count() == 0
    limits = Limits()
    assert pack_examples(
        encode_examples(none, model_bytes(str(WORD_MODEL)), limits), Scratch(spark, "t"), limits
    ).count() == 0


# --- packing -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(WORD_MODEL))


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    letters = "ab1,.'…éÜ×÷İ ΣσΔ̸́<=\x85\xa0\x1c\x00日ŉǰ \n\tIßſK"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3_000)]
    texts += ["a<|endoftext|>'S x", "<|ENDOFTEXT|>", "x 's'll 're're", "", None, "***", "can't,'s"]
    made = WordIds(model_bytes(str(WORD_MODEL)))
    for _ in range(2):  # the second time from memory
        ids, ends = made.texts(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert not len(made.texts(pa.array([], pa.string()))[0])


def padding(fills, size):
    return sum(0 if f & (f - 1) == 0 else size - f for f in fills)


@pytest.mark.parametrize("limits", [Limits(64, 8, 64), Limits(64, 3, 40), Limits(64, 8, 64, cut=False), Limits(64, 3, 40, cut=False)])
def test_pack_keeps_every_limit_and_every_token(limits):
    rng = random.Random(3)
    pieces = []
    for k in range(400):
        n = rng.choice([1, 2, 5, 30, rng.randint(1, 40)])
        pieces.append((k, 0, n, rng.randint(0, n)))
    made = pack(pieces, limits)
    covered = defaultdict(list)
    for held in made:
        assert 0 < sum(p[2] for p in held) <= limits.tokens and len(held) <= limits.segments
        assert sum(p[2] - p[3] for p in held) <= limits.loss
        for row, start, length, free in held:
            covered[row] += [(start + k, k < free) for k in range(length)]
    for row, _, n, free in pieces:
        assert sorted(covered[row]) == [(k, k < free) for k in range(n)]
    fills = [sum(p[2] for p in held) for held in made]
    if limits.cut:
        assert padding(fills, limits.tokens) == 0
    else:
        assert all(len(covered[row]) == n for row, _, n, _ in pieces)
        assert sum(map(len, made)) == len(pieces)
    assert pack(pieces, limits) == made


def test_dot_product_pairs_examples_that_are_heavy_in_different_ways():
    # 30 tokens without loss and 30 with it: only a mixed pair fits both limits
    pieces = [(k, 0, 32, 32 if k % 2 else 0) for k in range(40)]
    made = pack(pieces, Limits(64, 8, 32, cut=False))
    assert len(made) == 20 and all(sorted(p[3] for p in held) == [0, 32] for held in made)


def test_packed_table_holds_every_id_once(spark, docs, library):
    limits = Limits(tokens=256, segments=8, loss=256)
    made = pack_examples(
        encode_examples(docs, model_bytes(str(WORD_MODEL)), limits), Scratch(spark, "t"), limits, cell_rows=4
    ).collect()
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows())
    # rows that share an id and a length are told apart by content only, so compare all their pieces
    pieces, wanted = Counter(), Counter()
    for r in made:
        pieces[r.id, r.doc_tokens] += r.length
    for (doc, ids), times in want.items():
        wanted[doc, len(ids)] += len(ids) * times
    assert pieces == wanted
    single = {d: ids for (d, ids), n in want.items() if d is not None and d != 11}
    for doc, ids in single.items():
        own = sorted((r for r in made if r.id == doc), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)]).tolist()[:-1]
    by_sequence = defaultdict(list)
    for r in made:
        by_sequence[r.sequence_id].append(r)
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0, *(r.length for r in held)]).tolist()[:-1]
        assert [r.segment for r in held] == list(range(len(held))) and len(held) <= 8
    assert padding([sum(r.length for r in h) for h in by_sequence.values()], 256) == 0


def test_prompts_bear_no_loss(spark, library):
    turns = spark.createDataFrame([(1, "say it twice", "yes yes"), (2, None, "only text"), (3, "only prompt", None)],
                                  "doc_id long, ask string, text string")
    limits = Limits(64, 8, 64, cut=False)
    made = pack_examples(
        encode_examples(turns, model_bytes(str(WORD_MODEL)), limits, prompt_col="ask"), Scratch(spark, "t"), limits
    )
    for r in made.collect():
        ask, text = {1: ("say it twice", "yes yes"), 2: ("", "only text"), 3: ("only prompt", "")}[r.id]
        a, t = (library.encode(x, add_special_tokens=False).ids for x in (ask, text))
        assert r.ids == np.array([*a, *t, 1], "<u4").tobytes() and r.loss_tokens == len(t) + 1


def test_registered_packing(spark, sf_dir, library):
    made = QUERIES["op11_packing"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    own = defaultdict(list)
    for r in made:
        own[r.doc_id].append(r)
    assert set(own) == set(docs)
    for doc, held in own.items():
        ids = np.array([*library.encode(docs[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(held, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)


# --- source divergence -------------------------------------------------------------------


def brute(rows, min_docs, top):
    """The same numbers with Python's own integers and every term of every pair."""
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(t.translate(low) for t in terms(text or ""))
        for t, k in found.items():
            n[lang, source, t] += k
            docs[lang, t] += 1
    out = set()
    for lang, source in groups:
        kept = sorted(t for (g, t), k in docs.items() if g == lang and k >= min_docs)
        others = sorted(s for g, s in groups if g == lang)

        def share(names):
            c = {t: sum(n[lang, s, t] for s in names) for t in kept}  # noqa: B023
            total = sum(c.values()) + 2 * len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}  # noqa: B023

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        own, all_ = share([source]), share(others)
        pairs = [(-sum(gap(own[t], q) for t, q in share([s]).items()), s.encode()) for s in others if s != source]
        mine = [(-gap(own[t], all_[t]), t.encode()) for t in kept if n[lang, source, t] and own[t] > all_[t]]
        for part, held in (("pair", sorted(pairs)), ("term", sorted(mine)[:top])):
            out |= {(lang, source, part, i.decode(), -v, k) for k, (v, i) in enumerate(held, 1)}
    return out


def found(df):
    made = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]
    assert len(made) == len(set(made))
    return set(made)


def test_divergence_equals_brute_force(spark, docs):
    rng = random.Random(9)
    words = ["Alpha", "beta", "ÉTÉ", "naïve", "日本", "gamma", "x", "don't", "a1b2", "zz"]
    texts = ["", None, "12 - 34", *(" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(60))]
    rows = [(t, rng.choice([None, "", "en", "fr"]), rng.choice([None, "s1", "s2", "é", "S2"]), 7) for t in texts * 3]
    rows += [("copied text of alpha", "en", "s1", 7)] * 40 + [("no kept terms", "xx", "a", 7), ("12", "xx", "b", 7)]
    rows += [("lonely", "yy", "a", 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "text string, lang string, source string, term int").repartition(7)
    for min_docs, top in ((10, 10), (3, 2)):
        got = found(source_divergence(df, Scratch(spark, "t"), min_docs, top))
        assert got == brute([r[:3] for r in rows], min_docs, top)
    assert found(source_divergence(docs, Scratch(spark, "t"))) == brute([(r[1], r[2], r[3]) for r in rows_of(docs)], 10, 10)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_divergence_collapses_copies(spark):
    from log_templates.llm.divergence import collapse

    df = spark.createDataFrame([("a b", "en", "s1")] * 5 + [("a b", "en", "s2"), ("a b", "fr", "s1")], "text string, lang string, source string")
    made = {(r.lang, r.text): sorted((h.source, h.copies) for h in r.held) for r in collapse(df).collect()}
    assert made == {("en", "a b"): [("s1", 5), ("s2", 1)], ("fr", "a b"): [("s1", 1)]}


def test_divergence_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({OP13})").fetchall()}
    assert found(QUERIES["op13_source_divergence"](spark, sf_dir)) == want


# --- rules of urls against plain counting ------------------------------------------------


def test_mined_url_rules_equal_plain_counting(spark):
    from itertools import combinations

    from log_templates.llm.url_rules import filter_urls, mine, tokens_of

    rng = random.Random(2)
    rows = []
    for k in range(450):
        host, folder = rng.choice(["a.org", "spam.biz", "b.net"]), rng.choice(["buy", "news", "x"])
        block = rng.random() < (0.95 if host == "spam.biz" and folder == "buy" else 0.2)
        rows.append((k, f"http://{host}/{folder}/{k}?{rng.choice('pq')}=1", block))
    df = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    baskets = [(set(r.t), r.block) for r in df.select(tokens_of(F.col("url")).alias("t"), "block").collect()]
    least = max(0.002 * len(baskets), 20)
    want = {}
    for size in range(1, 11):
        for tokens in {c for b, _ in baskets for c in combinations(sorted(b), size)}:
            held = [block for b, block in baskets if b >= set(tokens)]
            if sum(held) >= least and sum(held) / len(held) >= 0.7:
                want[tokens] = sum(held) / len(held)
    got = {tuple(sorted(r.tokens)): r.confidence for r in mine(df).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)
    verdicts = {r.page_id: r["_url"] for r in filter_urls(df, df, Scratch(spark, "t")).collect()}
    for (k, _, _), (tokens, _) in zip(rows, baskets, strict=True):
        best = max((c for t, c in want.items() if tokens >= set(t)), default=None)
        assert verdicts[k].verdict == ("allow" if best is None else "block")
        assert best is None or abs(verdicts[k].confidence - best) < 1e-9
