"""Operators on tables with nulls, empty and long texts, ties, repeats and clashing columns; brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("log_templates.llm")

import corpus_pipeline
from log_templates.llm import mixing
from log_templates.llm.common import Scratch, remainder, table
from log_templates.llm.exact_dedup import exact_dedup, keep_first
from log_templates.llm.language import identify_languages
from log_templates.llm.lm import fit_words, score_texts
from log_templates.llm.minhash import minhash_components
from log_templates.llm.pieces import decode_pieces, encode_pieces
from log_templates.llm.quality_rules import quality_rules
from log_templates.llm.queries import PIECE_MODEL, RANKS, model_bytes
from log_templates.llm.rule_ensemble import classify_quality
from log_templates.llm.url_rules import filter_urls
from log_templates.llm.warc import base32_sha1, round_trip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _quality string, salt int"
LINE = "the quick brown fox jumps over the lazy dog and runs far away from here. "


def rows():
    base = [
        (1, LINE * 3, "en"), (2, (LINE * 3).replace(" ", "\n"), "en"), (3, (LINE * 3) + " ", "en"), (4, None, None),
        (5, "", "en"), (6, " \t\n", "en"), (7, "a", None), (8, "###", "en"), (None, LINE, "en"), (None, None, None),
        (9, "le chat noir dort sur le tapis rouge de la maison avec un ami très vieux. " * 2, "fr"),
        (10, " ".join(f"word{k}" for k in range(20_000)) + ".", "en"), (11, "x y z " * 40, "de"),
    ]
    base.append(base[0])
    return [(i, t, lang, None if k % 4 == 0 else f"s{k % 3}", 0, None, "q", 1) for k, (i, t, lang) in enumerate(base)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text):
    """Brute force of the counts that the rules rest on."""
    w = words(text)
    seen, covered = defaultdict(list), set()
    for k in range(len(w) - 4):
        seen[tuple(w[k : k + 5])].append(k)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + j for p in places for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_equal_brute_force(spark, docs, empty):
    got = quality_rules(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows())
    for r in got:
        q = r["_quality"]
        mine = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"])
        assert mine == counts(r["text"])
        n, _, _, _, again = mine
        assert q["base_failed"] == (n < 10 or 100 * again > 20 * n) and not (q["base_failed"] and q["kept"])
    assert quality_rules(empty, Scratch(spark, "t")).count() == 0


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup(docs, Scratch(spark, "t")).collect()
    groups = Counter("".join(words(r[1])) for r in rows())
    assert sorted(r["group_size"] for r in got) == sorted(groups["".join(words(r[1]))] for r in rows())
    assert sum(r["kept"] for r in got) == len(groups)
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {3}  # the longest original
    assert {r["keep_id"] for r in got if r["doc_id"] in (4, 5)} == {6}
    stay = keep_first(docs, Scratch(spark, "t"))
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup(empty, Scratch(spark, "t")).count() == keep_first(empty, Scratch(spark, "t")).count() == 0


def components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if low[a] < low[b] and both and 100 * both >= percent * len(sets[a] | sets[b]):
                    low[b] = low[a]
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_minhash_equals_brute_force(spark, empty):
    base = [f"w{k}" for k in range(120)]
    texts = {100: "", 101: None, 102: "one two", 103: "ONE two", 104: "one three"}
    for k in range(40):  # edits of one text: near to it, some too far from each other
        edited = list(base)
        for j in range(1 + k % 7):
            edited[(k * 11 + j * 17) % 120] = f"e{k}x{j}"
        texts[k] = " ".join(edited)
    frame = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, "one two", 1)], "doc_id long, text string, comp int")
    got = {r["doc_id"]: r for r in minhash_components(frame, Scratch(spark, "t"), 3, 85).collect()}
    want = components(texts, 3, 85)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in texts} == want
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert minhash_components(empty, Scratch(spark, "t")).count() == 0


def test_temperature_mix(spark, docs, empty):
    frame = spark.createDataFrame([(k, "w " * 10, "big" if k < 80 else "small", 0) for k in range(100)], "doc_id long, text string, source string, weight int")
    got = mixing.temperature_mix(frame, Scratch(spark, "t"), repeat_limit=2.0).groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.max("_mix.copy").alias("c")
    )
    assert {r["source"]: (r["n"], r["d"], r["c"]) for r in got.collect()} == {"big": (80, 80, 0), "small": (40, 20, 1)}
    half = mixing.temperature_mix(frame, Scratch(spark, "t"), repeat_limit=None, budget=500.0)
    assert {r["source"]: r["count"] for r in half.groupBy("source").count().collect()} == {"big": 40, "small": 10}
    flat = mixing.temperature_mix(frame, Scratch(spark, "t"), repeat_limit=None, entropy=math.log(2))
    weights = {r[0] for r in flat.select(F.round("_mix.weight", 6)).distinct().collect()}
    assert weights <= {0.5, 0.499999, 0.500001}
    used = mixing.temperature_mix(docs, Scratch(spark, "t"))
    assert set(docs.columns) < set(used.columns) and used.count() >= len(rows())
    assert used.select("text").distinct().count() == docs.select("text").distinct().count()
    assert mixing.temperature_mix(empty, Scratch(spark, "t")).count() == 0


def test_pieces_on_tables(docs, empty):
    model = model_bytes(str(PIECE_MODEL))
    both = decode_pieces(encode_pieces(docs, model), model)
    assert set(both.columns) == set(docs.columns) | {"ids", "decoded"}
    assert both.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and both.count() == len(rows())
    assert encode_pieces(empty, model).count() == 0


def test_rule_ensemble(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 0), (11, 0, 0), (8, 0, 1), (7, None, 1), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, text int")
    got = classify_quality(docs, labels, F.lit(True), Scratch(spark, "t")).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = classify_quality(docs, labels.where("false"), F.lit(True), Scratch(spark, "t"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert classify_quality(empty, labels, F.lit(True), Scratch(spark, "t")).count() == 0


def test_language(spark, docs, empty):
    got = {r["doc_id"]: r for r in identify_languages(docs, F.lit(True), Scratch(spark, "t")).collect()}
    assert got[9]["lang_pred"] == "fr" and got[1]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 8))
    assert {r["lang_pred"] for r in identify_languages(docs, F.lit(False), Scratch(spark, "t")).collect()} == {"und"}
    assert identify_languages(empty, F.lit(True), Scratch(spark, "t")).count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    frame = table(spark, sf_dir, "documents")
    learn = remainder(F.col("doc_id"), 5) != 0
    got = identify_languages(frame, learn, Scratch(spark, "t")).join(frame.select("doc_id", "lang"), "doc_id").where(~learn)
    right = got.where((F.col("lang") == F.col("lang_pred")) | (F.col("lang_pred") == "und")).count()
    assert right >= 0.95 * got.count()


def test_language_model_base_equals_brute_force(spark, docs, empty):
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) != 9
    got = score_texts(docs, learn, model_bytes(str(RANKS)), Scratch(spark, "t")).collect()
    assert len(got) == len(rows())
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + [None]
    c = Counter(w for r in rows() if r[0] != 9 for w in lower(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(r[0]), len(lower(r[1])), sum(c[w] > 0 for w in lower(r[1])), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lower(r[1])), 6))
        for r in rows()
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["held_out"] == (r["doc_id"] == 9) and -1e9 < r["score"] < 0 for r in got)
    assert score_texts(empty, F.lit(True), model_bytes(str(RANKS)), Scratch(spark, "t")).count() == 0
    alone = score_texts(docs, F.lit(False), model_bytes(str(RANKS)), Scratch(spark, "t"))
    assert {(r["train_tokens"], r["n_known"], round(r["base_score"], 9)) for r in alone.collect()} == {(0, 0, 0.0)}


def test_language_model_scores_by_the_words_before(spark):
    """Words that follow from those before are nearly sure, whatever their share of all words."""
    text = " ".join(["one", "two", "three", "four"] * 100)
    docs = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string").coalesce(2)
    got = score_texts(docs, F.col("doc_id") % 5 != 0, model_bytes(str(RANKS)), Scratch(spark, "t")).collect()
    assert all(r["score"] > 0.3 * r["base_score"] for r in got)


def test_spelling_is_priced_once_for_each_word_of_all_texts(spark):
    """Also for words that only texts outside the training have; they count as not seen."""
    docs = spark.createDataFrame([(k, f"Both both only{k % 2}") for k in range(40)] + [(None, None)], "doc_id long, text string")
    model, words = fit_words(docs, F.col("doc_id") % 2 == 0, model_bytes(str(RANKS)), Scratch(spark, "t"))
    found = {r["word"]: r["n"] for r in words.collect()}
    assert found == {"both": 40, "only0": 20, "only1": 0} and words.count() == 3
    assert (model.total, model.distinct, model.ends) == (80, 3, 20) and set(model.hot) == {b"both", b"only0"}


URLS = ["http://A.Example.com/x/1?q=1#f", "https://spam.example.net/en/7", None, "no scheme", "ftp://example.org", "http://sub.example.org/es/1"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)] + [(None, URLS[0], "h")], "page_id long, url string, host string")
    labelled = spark.createDataFrame(
        [(f"https://spam.example.net/en/{k}", True) for k in range(30)] + [(f"http://fine{k % 9}.example.com/{k}", False) for k in range(90)] + [(None, None)],
        "url string, block boolean",
    )
    rules = (("org", "/", "allow"), ("example.org", "/es/", "block"))
    got = {r["page_id"]: r["_url"] for r in filter_urls(pages, labelled, Scratch(spark, "t"), rules).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("a.example.com", "/x/1", "allow")
    assert got[1]["verdict"] == "block" and got[1]["rule"] is None and got[1]["confidence"] == 1.0
    assert all((got[k]["host"], got[k]["path"], got[k]["verdict"]) == ("", "", "allow") for k in (2, 3))
    assert (got[4]["path"], got[4]["rule"]) == ("", None) and got[5]["rule"] == "example.org/es/" and got[5]["verdict"] == "block"
    assert got[None]["verdict"] == "allow"
    assert filter_urls(pages, labelled.where("false"), Scratch(spark, "t"), rules).count() == len(URLS) + 1
    assert filter_urls(pages.where("false"), labelled, Scratch(spark, "t"), rules).count() == 0


def test_url_rules_with_a_majority_of_blocked_urls(spark):
    """Also above a block share of 2/3, and of 1, rules of full confidence are mined."""
    bad = [(f"https://spam.example.net/en/{k}", True) for k in range(90)]
    good = [("http://fine.org/about", False)] * 30
    pages = spark.createDataFrame([(0, bad[0][0]), (1, good[0][0])], "page_id long, url string")
    for labels, want in ((bad + good, ["block", "allow"]), (bad, ["block", "allow"])):
        labelled = spark.createDataFrame(labels, "url string, block boolean")
        got = filter_urls(pages, labelled, Scratch(spark, "t")).orderBy("page_id").collect()
        assert [r["_url"]["verdict"] for r in got] == want and got[0]["_url"]["confidence"] == 1.0


def test_archives(spark):
    html = ["<p>a</p>", "<p>é</p>", None, "", "<p>a</p>", "x" * 100_000]
    frame = spark.createDataFrame([(k, "u", h, 1) for k, h in enumerate(html)] + [(None, None, "<p>a</p>", 1), (5, "u", html[5], 1)], "page_id long, url string, html string, volume int")
    got = round_trip(frame, Scratch(spark, "t")).collect()
    want = Counter()
    for k, h in [*enumerate(html), (None, html[0]), (5, html[5])]:
        first = html.index(h) if h else 2
        want[k, len((h or "").encode()), base32_sha1((h or "").encode()), None if k == first else first] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got) == want
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)
    assert all(bytes(r["payload"]).decode() == (html[r["page_id"]] or "") for r in got if r["record_type"] == "response")
    assert round_trip(frame.where("false"), Scratch(spark, "t")).count() == 0


def test_repeated_ids_keep_the_links_of_each_text(spark):
    words_ = [f"w{k}" for k in range(400)]
    one, two = " ".join(words_), " ".join(words_[200:] + [f"v{k}" for k in range(200)])
    rows = [(1, two), (2, one), (5, two + " word"), (5, one + " word"), (5, one + " word"), (None, one), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_components(frame, Scratch(spark, "t"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id) == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 2), (7, 7)]
    stay = corpus_pipeline.drop_near_copies(spark, frame, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in stay) == sorted([(1, two), (2, one), (0, one), (7, "")])


def test_buckets_of_many_sizes(spark):
    """Groups below and above the size at which pairs are listed, and unlike texts that share passages."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(30)]
    rows, n = [], 0
    for size in (2, 3, 8, 9, 40):
        body = [f"g{size}x{k}" for k in range(120)]
        for _ in range(size):
            text = body.copy()
            text[rng.randrange(120)] = f"r{n}"
            rows.append((n, " ".join(text)))
            n += 1
    for _ in range(30):
        rows.append((n, " ".join(shared + [f"u{n}y{k}" for k in range(6)])))
        n += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_components(frame, Scratch(spark, "t"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(dict(rows), 3, 85)


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Rules, copies and near copies by plain loops; the mix by its multiset; ids by the library."""
    sentencepiece = pytest.importorskip("sentencepiece")
    frame, kept = table(spark, sf_dir, "documents"), []
    staged = frame
    for _, stage in corpus_pipeline.STAGES:
        staged = Scratch(spark, "t").save(stage(spark, staged, sf_dir))
        kept.append(staged)
    for one in kept[:-1]:
        assert one.columns == frame.columns
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    judged = quality_rules(frame, Scratch(spark, "t")).collect()
    for r in judged:
        assert counts(r["text"]) == tuple(r["_quality"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    good = {r["doc_id"] for r in judged if r["_quality"]["kept"]}
    assert {r["doc_id"] for r in kept[0].collect()} == good
    best = {}
    for i in sorted(good, key=lambda i: (-len(texts[i]), i)):
        best.setdefault("".join(words(texts[i])), i)
    assert {r["doc_id"] for r in kept[1].collect()} == set(best.values())
    found = components({i: texts[i] for i in best.values()}, 5, 80)
    assert {r["doc_id"] for r in kept[2].collect()} == {i for i, (_, low) in found.items() if i == low}
    mixed = Counter(r["doc_id"] for r in kept[3].collect())
    assert set(mixed) == {r["doc_id"] for r in kept[2].collect()} and max(mixed.values()) <= 2
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(str(PIECE_MODEL)))
    last = kept[4].collect()
    assert Counter(r["doc_id"] for r in last) == mixed
    assert all(r["ids"] == theirs.encode(texts[r["doc_id"]]) for r in last)


def test_stages_take_edge_rows(spark, docs, empty, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() >= 1, name
        assert stage(spark, empty, sf_dir).count() == 0, name
