import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from voxelloom.llm import langid


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a"]
    rng = np.random.default_rng(0)
    probs = rng.uniform(0.01, 0.2, (len(pieces) + 1, 2))
    model = langid.UnigramModel(["x", "y"], pieces, probs)
    p = dict(zip(pieces, probs[:-1], strict=True))
    for word in ("▁", "▁a", "▁abab", "▁bac", "abaaba", "c"):
        total = np.zeros(2)
        for cut in itertools.product((0, 1), repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate((*cut, 1)):
                if c:
                    parts.append(word[at : i + 1])
                    at = i + 1
            if all(s in p or len(s) == 1 for s in parts):
                total += math.prod((p.get(s, probs[-1]) for s in parts), start=np.ones(2))
        assert np.allclose(model.log_likelihood([word])[0], np.log(total))


def plain_log_likelihood(model, word):
    """The forward sums of one word and language in exact fractions."""
    from fractions import Fraction

    p = {s: [Fraction(float(x)) for x in row] for s, row in zip(model.pieces, model.probs, strict=False)}
    out = []
    for lang in range(len(model.langs)):
        alpha = [Fraction(1)]
        for end in range(1, len(word) + 1):
            total = Fraction(0)
            for k in range(1, end + 1):
                piece = word[end - k : end]
                if piece in p or k == 1:
                    total += alpha[end - k] * (p[piece][lang] if piece in p else Fraction(float(model.probs[-1, lang])))
            alpha.append(total)
        out.append(math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator))
    return np.array(out)


@pytest.mark.parametrize("length", [1, 15, 16, 17, 25, 33, 63, 64, 65, 150])
def test_whole_words_of_any_length_and_long_pieces(length):
    pieces = ["▁", "a", "b", "ab", "ba", "abbaabbaab", "babababababababab", "▁ab"]
    rng = np.random.default_rng(length)
    model = langid.UnigramModel(["x", "y"], pieces, rng.uniform(1e-9, 0.2, (len(pieces) + 1, 2)))
    words = ["".join(rng.choice(list("▁abc"), length)), ("abbaabbaab" * 20)[:length], ("▁" + "ba" * 80)[:length]]
    want = np.stack([plain_log_likelihood(model, w) for w in words])
    assert np.allclose(model.log_likelihood(words), want, rtol=1e-9)
    for step in (1, 7, 4096):
        assert np.allclose([model.long_word(w, step) for w in words], want, rtol=1e-9)


def test_expected_counts_are_the_shares_of_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a"]
    rng = np.random.default_rng(1)
    model = langid.UnigramModel(["x"], pieces, rng.uniform(0.01, 0.2, (len(pieces) + 1, 1)))
    p = {s: float(x[0]) for s, x in zip(model.pieces, model.probs, strict=False)}
    want = np.zeros(len(pieces) + 1)
    words, counts = ["▁ababa", "▁", "▁abcab", "ab" * 9], np.array([3.0, 1.0, 2.0, 1.5])
    for word, n in zip(words, counts, strict=True):
        found = []
        for cut in itertools.product((0, 1), repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate((*cut, 1)) if c]
            parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if all(s in p or len(s) == 1 for s in parts):
                found.append((math.prod(p.get(s, float(model.probs[-1, 0])) for s in parts), parts))
        total = sum(w for w, _ in found)
        for w, parts in found:
            for s in parts:
                want[model.pieces.index(s) if s in p else -1] += n * w / total
    assert np.allclose(model.expected_counts(words, counts, 0), want)


def test_scores_of_texts_are_sums_over_their_words():
    pieces = ["▁", "a", "b", "ab", "▁a", "ß"]
    model = langid.UnigramModel(["x", "y"], pieces, np.random.default_rng(2).uniform(0.01, 0.2, (len(pieces) + 1, 2)))
    texts = ["Ab ba  ab", "a" * 70 + " b", None, "12 ²Ⅷ", "ß" + " ab" * 3000, ""]
    preds, scores = model.score_texts(texts, most=2)
    for text, pred, score in zip(texts, preds, scores, strict=True):
        if text is None or not any(c.isalpha() for c in text):
            assert (pred, score) == ("und", 0.0)
            continue
        total = sum(plain_log_likelihood(model, "▁" + w) * n for w, n in Counter(text.lower().split()).items())
        share = np.exp(total - total.max())
        assert pred == model.langs[int(total.argmax())] and np.isclose(score, (share / share.sum()).max(), rtol=1e-6)
    runs = [(i, w) for group in langid.runs_of_words([(0, "aa b  cc " * 50), (1, "d" * 90), (2, " ")], 20) for i, ws in group for w in ws]
    assert runs == [(0, w) for w in ("aa b cc " * 50).split()] + [(1, "d" * 90)]


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9


def test_edge_table(docs, no_docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            t = text[r.doc_id]
            assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) and r.lang_pred in ("aa", "bb", "und")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert langid.identify(no_docs).collect() == [] and langid.keep_identified(no_docs).collect() == []


def test_nothing_labelled(docs):
    unlabelled = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("fit_docs", [3, 10])
def test_the_sample_is_the_smallest_hashes(spark, fit_docs):
    rows = [(k, f"w{k}", "aa" if k % 2 else "bb") for k in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_docs=fit_docs, rounds=1)
    assert model.langs == ["aa", "bb"]


def test_rows_that_share_an_id_still_give_a_sample(spark):
    rows = [(k % 3, f"wort{k} und mehr", "aa") for k in range(900)] + [(k, f"word{k} and more", "bb") for k in range(10, 400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_docs=20, rounds=1)
    assert model.langs == ["aa", "bb"]
