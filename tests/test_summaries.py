"""Summaries: the graph over rows against one text in memory, and that against whole matrices."""

import random

import numpy as np
import pytest

from lumenframe.operators import summaries as sm


def matrix_ranks(sentences):
    """The same ranks from a dense similarity matrix."""
    shares = [sm.term_shares(s) for s in sentences]
    terms, n = sorted({t for s in shares for t in s}), len(sentences)
    x = np.array([[s.get(t, 0.0) for t in terms] for s in shares])
    x *= np.log(n / (1 + (x > 0).sum(axis=0)))
    size = np.linalg.norm(x, axis=1)
    x /= np.where(size > 0, size, 1.0)[:, None]
    near = (x @ x.T > sm.SIMILAR).astype(float)
    step = near / np.maximum(1, near.sum(axis=1))[:, None]
    rank = np.full(n, 1 / n)
    for _ in range(100):
        fresh = rank @ step
        moved, rank = np.linalg.norm(fresh - rank), fresh
        if moved < sm.SETTLED:
            break
    return rank


def make_text(n, seed, words=60):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    return " ".join(" ".join(rng.choices(names, k=rng.randint(1, 9))).capitalize() + rng.choice(".!?") for _ in range(n))


def test_ranks_equal_the_dense_matrix():
    for seed in range(5):
        found = sm.split_sentences(make_text(5 + 20 * seed, seed))
        assert sm.ranks(found) == pytest.approx(matrix_ranks(found))


@pytest.mark.parametrize(("products", "pairs"), [(50, 10**9), (1000, 0), (1 << 18, 0)])
def test_ranks_from_blocks_of_bits(monkeypatch, products, pairs):
    monkeypatch.setattr(sm, "PRODUCTS", products)
    monkeypatch.setattr(sm, "PAIRS", pairs)
    for found in [sm.split_sentences(make_text(90, 4)), ["a b", "a b"], ["one"], ["a", "b c", "c d", "x y z"]]:
        assert sm.ranks(found) == pytest.approx(matrix_ranks(found))
    assert len(sm.ranks([])) == 0


def test_texts_of_some_thousand_sentences_need_no_joins(spark, monkeypatch):
    monkeypatch.setattr(sm, "long_summaries", None)  # their memory is bounded where they lie
    text = make_text(2500, 1, 3000)
    got = sm.summarize(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").first().summary
    assert len(sm.split_sentences(got)) == 3


def test_long_texts_equal_short_ones(spark):
    texts = {i: make_text(n, i, w) for i, (n, w) in enumerate([(4, 20), (12, 30), (60, 40), (150, 200), (3, 5), (40, 3)])}
    texts |= {90: "", 91: None, 92: "One only.", 93: "...!?", 94: "Same. Same. Same. Same.", 95: "é à. Über ß! 日本 語。"}
    df = spark.createDataFrame([*texts.items(), (4, texts[2]), (None, texts[1])], "k long, t string").repartition(3)
    plain = sorted(([k, sm.summary(sm.split_sentences(t), 3)] for k, t in [*texts.items(), (4, texts[2]), (None, texts[1])]), key=str)
    for long in (0, 2000, 30):
        assert sorted(([r.k, r.summary] for r in sm.summarize(df, "k", "t", 3, long=long).collect()), key=str) == plain


def test_similar_pairs_are_all_found(spark):
    found = sm.split_sentences(make_text(120, 7, 80))
    rows = sm._sentence_rows(spark.createDataFrame([(1, " ".join(found))], "id long, text string"))
    got = {(r.i, r.j) for r in sm.similar_sentences(rows).collect()}
    shares = [sm.term_shares(s) for s in found]
    held = {t: sum(t in s for s in shares) for s in shares for t in s}
    vectors = [{t: x * np.log(len(found) / (1 + held[t])) for t, x in s.items()} for s in shares]
    sizes = [np.sqrt(sum(x * x for x in v.values())) for v in vectors]
    dots = {(i, j): sum(x * b.get(t, 0.0) for t, x in a.items()) / (sizes[i] * sizes[j]) for i, a in enumerate(vectors) for j, b in enumerate(vectors) if sizes[i] * sizes[j] > 0}
    assert got == {k for k, d in dots.items() if d > sm.SIMILAR}
