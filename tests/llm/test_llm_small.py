"""Numpy and pure Python parts: shingles, transducer, attention, WARC framing, fits."""

import gzip
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("log_templates.llm")

from log_templates.llm import attention, lm, pieces, warc
from log_templates.llm.language import words_of
from log_templates.llm.minhash import bands_for, signatures
from log_templates.llm.quality_rules import expectation_maximisation
from log_templates.llm.queries import PIECE_MODEL, RANKS, model_bytes
from log_templates.llm.rule_ensemble import tree_rules
from log_templates.llm.shingles import WordHashes, overlap, shingle_set


def test_shingle_sets_and_overlap():
    h = WordHashes()
    assert len(shingle_set(None, 3, h)) == len(shingle_set(" \t\n", 3, h)) == 0
    assert len(shingle_set("one two", 3, h)) == 1
    assert (shingle_set("A b\x0bC d", 3, h) == shingle_set("a B c D", 3, h)).all()
    a, b = shingle_set("a b c d e", 3, h), shingle_set("x b c d e", 3, h)
    assert len(a) == len(b) == 3 and overlap(a, b) == 2
    assert len(shingle_set("a b c a b c a b c", 3, h)) == 3


def test_equal_coordinates_estimate_jaccard():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 800, np.int64).astype(np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 2**63, 100, np.int64).astype(np.uint64)]) for _ in range(2)]
    sig = signatures(sets, 400)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.07
    bands, rows = bands_for(85)
    assert (1 - 0.85**rows) ** bands < 1e-6


def test_pieces_match_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(str(PIECE_MODEL)))
    mine = pieces.Transducer(pieces.read_model(model_bytes(str(PIECE_MODEL))))
    rng = random.Random(3)
    letters = "aaabbbc  thelongéß中文🙂\n\t_.,!!12345<s></s>"
    texts = ["", " ", "  two  spaces ", "aaaaaaaaaaaa", "<s>​"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice(mine.model.pieces)[0] for _ in range(6)) for _ in range(300)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == theirs.encode(t)
        if "▁" not in t:
            assert mine.decode(ids) == t
    assert mine.encode(None) == []


def test_unigram_path_is_the_least_of_all():
    vocabulary = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.2, 1), ("ab", -1.5, 1), ("ba", -1.6, 1), ("aba", -2.9, 1)]
    model = pieces.Model(vocabulary, merges=False, byte_fallback=False, unknown_id=0, dummy_prefix=False)
    made = pieces.Transducer(model)

    def least(text):
        if not text:
            return 0.0
        return min(
            -s + least(text[len(p) :]) for p, s, k in vocabulary if k == 1 and text.startswith(p)
        )

    for text in ("a", "ab", "abab", "aabba", "babaab"):
        weight = sum(-vocabulary[i][1] for i in made.encode(text))
        assert abs(weight - least(text)) < 1e-9
    assert made.encode("axb") == [1, 0, 2]


def test_normaliser_rules():
    model = pieces.Model([("<unk>", 0.0, 2), ("▁x", -1.0, 1)], False, False, 0, rules={"XY": "x", "X": "?"})
    assert pieces.Transducer(model).normalise("XY") == "▁x"


def test_attention_gradient_and_scores():
    shape = attention.Shape(12, 4, 8, 4)
    rng = np.random.default_rng(0)
    flat = shape.start(np.full(12, -2.5, np.float32)).astype(np.float64)
    flat += rng.standard_normal(len(flat)) * 0.5
    length = np.array([19, 1, 6])
    begin = np.cumsum(length) - length
    x, y = rng.integers(0, 12, length.sum()), rng.integers(0, 12, length.sum())
    text, place = shape.windows(length)
    rows, there, asked = shape.gather(begin[text], length[text], place)
    assert np.sort(rows[:, 4:][asked]).tolist() == list(range(length.sum()))  # each token once
    args = (x[rows], there, asked, y[rows[:, 4:]])
    loss, grad = attention.loss_and_gradient(shape, flat, *args)
    logs = attention.scorer(shape, flat)(x, y, begin, length)
    assert abs(loss + logs.mean()) < 1e-5
    for k in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (attention.loss_and_gradient(shape, up, *args)[0] - attention.loss_and_gradient(shape, down, *args)[0]) / 2e-5
        assert abs(slope - grad[k]) < 1e-6
    every = [attention.scorer(shape, flat)(x[:5], np.full(5, c), np.array([0]), np.array([5])) for c in range(12)]
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    later = x.copy()
    later[10:19] = 0  # what comes after a token does not change its score
    assert np.allclose(attention.scorer(shape, flat)(later, y, begin, length)[:10], logs[:10], atol=1e-5)


def test_training_learns_a_pattern():
    shape = attention.Shape(12, 4, 8, 4)
    y = np.tile(np.arange(1, 6), 400)
    x = np.r_[0, y[:-1]]
    trainer = attention.Trainer(shape, shape.start(np.zeros(12, np.float32)))
    for _ in range(6):
        trainer.learn(x, y, np.array([0]), np.array([len(y)]))
    assert attention.scorer(shape, trainer.flat)(x, y, np.array([0]), np.array([len(y)])).mean() > -0.3


def test_rounds_train_on_every_word_once():
    encoding = lm.tokenizer(model_bytes(str(RANKS)))
    n = encoding.n_vocab
    classes = [lm.make_classes(shape, np.zeros(n, np.int64), 1, np.zeros(n, np.int64)) for shape in (lm.OUTER, lm.INNER)]
    flat = tuple(shape.start(c.log_class) for shape, c in zip((lm.OUTER, lm.INNER), classes, strict=True))
    model = lm.LanguageModel(1, 1, 1, {}, *classes, flat)
    texts = [[], [b"one"], [b"w%d" % (k % 50) for k in range(3000)], [b"a", b"bc"] * 9]
    inside = sum(len(lm.encode_words(encoding, words)[0]) for words in texts)
    rounds = [lm.learn_texts(texts, model, encoding, nth) for nth in range(lm.ROUNDS)]
    assert sum(r[0] for r in rounds) == sum(len(words) + 1 for words in texts)  # with the end of each text
    assert sum(r[1] for r in rounds) == inside
    for length in (1, 8, 9, 700):
        parts = [range(length)[attention.stretch(length, nth, 3)] for nth in range(3)]
        assert [k for p in parts for k in p] == list(range(length))


def test_texts_are_cut_as_python_cuts_bytes():
    texts = ["  A b\tC\n", None, "", " \t\n", "É\u00a0x y \x1c z\x0b w", "one"]
    bounds, words = lm.word_lists(pa.array(texts))
    words = words.cast(pa.binary()).to_pylist()
    got = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [(t or "").encode().lower().split() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * lm.SLICE_BYTES, "a", None, "b"])], names=["text"])
    assert [p.num_rows for p in lm.of_size([batch])] == [1, 3]


def test_attention_between_words_has_all_ids_of_the_words_before():
    """The gradient by differences, with inputs of several pieces; and what an id inside a word before is worth."""
    shape = attention.Shape(12, 4, 8, 4, later=5)
    rng = np.random.default_rng(2)
    flat = shape.start(np.full(12, -2.5, np.float32)).astype(np.float64)
    flat += rng.standard_normal(len(flat)) * 0.5
    length = np.array([19, 1, 6])
    begin = np.cumsum(length) - length
    x, y = rng.integers(0, 12, length.sum()), rng.integers(0, 12, length.sum())
    count = rng.integers(0, 4, length.sum())
    more = rng.integers(12, 17, count.sum()), np.r_[0, np.cumsum(count)]
    text, place = shape.windows(length)
    rows, there, asked = shape.gather(begin[text], length[text], place)
    args = (x[rows], there, asked, y[rows[:, 4:]], None, None, attention._pieces_of(rows, there, *more))
    loss, grad = attention.loss_and_gradient(shape, flat, *args)
    assert abs(loss + attention.scorer(shape, flat)(x, y, begin, length, more).mean()) < 1e-5
    for k in rng.choice(len(flat), 100, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (attention.loss_and_gradient(shape, up, *args)[0] - attention.loss_and_gradient(shape, down, *args)[0]) / 2e-5
        assert abs(slope - grad[k]) < 1e-6

    encoding = lm.tokenizer(model_bytes(str(RANKS)))
    n = encoding.n_vocab
    outer, inner = (lm.make_classes(shape, n - np.arange(n), 1, np.zeros(n, np.int64)) for shape in (lm.OUTER, lm.INNER))
    flat = (rng.standard_normal(lm.OUTER.length).astype(np.float32), lm.INNER.start(inner.log_class))
    m = lm.LanguageModel(1, 1, 1, {}, outer, inner, flat)
    texts = [lm.pieces_of(m, *lm.encode_words(encoding, t)) for t in ([], [b"zzaz", b"and", b"so"], [b"zzbz", b"and", b"so"])]
    assert [t.first.tolist() for t in texts][1] == texts[2].first.tolist() and texts[1].later.tolist() != texts[2].later.tolist()
    inputs, targets, start, length, more = lm.sequences(texts)
    assert length.tolist() == [1, 4, 4] and len(more[0]) == sum((t.later > 0).sum() for t in texts)
    logs = attention.scorer(lm.OUTER, flat[0])(inputs, targets, start, length, more)
    assert logs[1] == logs[5] and (abs(logs[2:4] - logs[6:8]) > 1e-6).all()  # the first word, then those after it


def test_words_and_unseen_ones_share_a_class():
    counts = [7, 1, 1]
    by = lm.ClassWords(np.array([0, sum(counts)]), np.array([0, len(counts)]))
    slot, spelled = by.slot(), by.spelled()
    seen = 10 ** lm.either(np.array([*counts, 0]), slot[1], -np.inf)  # all by count, the last one unseen
    assert np.isclose(seen.sum() + 10 ** spelled[1], 1) and np.isclose(10 ** spelled[1], 4 / 14)
    assert np.isclose(10 ** slot[0] + 10 ** spelled[0], 1)  # a class without words
    assert np.isclose(lm.either(2, -3.0, -400.0), np.log10(0.003))


def test_weights_count_texts_as_often():
    shape = attention.Shape(12, 4, 8, 4)
    rng = np.random.default_rng(1)
    flat = shape.start(np.full(12, -2.5, np.float32)).astype(np.float64)
    length = np.array([3, 4, 4, 4])
    begin = np.cumsum(length) - length
    x, y = rng.integers(0, 12, 15), rng.integers(0, 12, 15)
    x[7:] = np.tile(x[3:7], 2)
    y[7:] = np.tile(y[3:7], 2)

    def run(texts, times):
        text, place = shape.windows(length[texts])
        rows, there, asked = shape.gather(begin[texts][text], length[texts][text], place)
        return attention.loss_and_gradient(shape, flat, x[rows], there, asked, y[rows[:, 4:]], times)

    (loss, grad), (want, want_grad) = run([0, 1], np.array([1, 3])), run([0, 1, 2, 3], None)
    assert abs(loss - want) < 1e-12 and np.allclose(grad, want_grad, atol=1e-12)


def test_records_round_trip_in_small_chunks():
    made = [
        warc.record(7, 0, "http://a/\nb", "hé".encode(), None, False),
        warc.record(9, 1, "http://a", "hé".encode(), 7, True),
        warc.record(None, 2, "", b"", None, False),
    ]
    archive = b"".join(warc.member(r) for r in made)
    assert gzip.decompress(archive) == b"".join(made)
    for size in (1, 7, 10_000):
        got = list(warc.read_records(archive[k : k + size] for k in range(0, len(archive), size)))
        assert [r.payload for r in got] == ["hé".encode(), b"", b""]
        assert got[1].fields["warc-refers-to"] == "<urn:page:7>" and got[1].http["content-length"] == "3"
    with pytest.raises(ValueError):
        list(warc.read_records([archive[:-9]]))
    with pytest.raises(ValueError):
        list(warc.read_records([warc.member(made[0].replace("hé".encode(), b"xyz"))]))


def test_long_record_is_followed_by_an_empty_member():
    big = warc.member(b"x" * (2**24 + 5))
    assert big[-1] == 1
    joined = big + warc.member(b"") + warc.member(b"y")
    assert [len(m) for m in warc.inflate(joined[k : k + 4096] for k in range(0, len(joined), 4096))] == [2**24 + 5, 0, 1]


def test_maximisation_finds_the_bad_documents():
    model = expectation_maximisation(["a", "b"], [((1, 1), 900), ((-1, 1), 40), ((1, -1), 30), ((-1, -1), 30)])
    assert model.weights["a"][1] < 0 < model.weights["a"][0] + 1e-9
    assert expectation_maximisation(["a"], []).prior == 0.9


def test_tree_paths_become_rules():
    text = "x\n  If (feature 0 <= 0.5)\n   If (feature 0 <= 0.25)\n    Predict: 0.0\n   Else (feature 0 > 0.25)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    assert tree_rules(text) == {
        ((0, "<=", 0.5),), ((0, "<=", 0.25),), ((0, "<=", 0.5), (0, ">", 0.25)), ((0, ">", 0.5),),
    }


def test_words_are_letters():
    assert words_of("Ab1c_d É") == ["ab", "c", "d", "é"] and words_of(None) == []
