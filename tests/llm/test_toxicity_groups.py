"""Terms and neighbours of many texts at once are those of each text alone."""

import random
from collections import Counter

import numpy as np
import pytest

from courtline.llm import toxicity

WORDS = ["of", "alpha", "alphabet", "Straße", "straw", "ﬁnal", "beta", "betamax", "x1", "É" * 6, "gamma-ray"]


def index_of(texts, labels):
    """The index over some texts, weights at random."""
    rnd, terms, rows = random.Random(5), {}, []
    for i, text in enumerate(texts):
        own = Counter()
        for word in toxicity.words_of(text):
            for term in (word, toxicity.prefix_term(word)) if len(word) > toxicity.PREFIX else (word,):
                own[terms.setdefault(term, len(terms))] += 1
        rows.append((i, labels[i], dict(own)))
    return toxicity.Index(terms, np.array([1 + rnd.random() for _ in terms]), rows), rows


def brute_counts(text, terms):
    every = [t for w in toxicity.words_of(text) for t in ((w, toxicity.prefix_term(w)) if len(w) > toxicity.PREFIX else (w,))]
    return sorted(Counter(terms[t] for t in every if t in terms).items())


def test_terms_of_many_texts_are_those_of_each():
    rnd = random.Random(1)
    index, _ = index_of([" ".join(WORDS).encode()], [1])
    new = [*WORDS, "alpine", "alphas", "strasse", "unknown", "Éa", "É" * 9, "beta2", "^beta"]
    texts = [" ".join(rnd.choices(new, k=rnd.randint(0, 40))).encode() for _ in range(2 * toxicity.TEXTS + 9)]
    texts[0] = texts[63] = texts[64] = None
    texts[-1], texts[70], texts[71] = b"", b"nothing known 7", "of ".encode() * 70_000
    got = index.words.counts_of(texts)
    assert len(got) == len(texts)
    for text, (term, count) in zip(texts, got, strict=True):
        assert list(zip(term.tolist(), count.tolist(), strict=True)) == brute_counts(text, index.words.terms)
        assert all(a.tolist() == b.tolist() for a, b in zip((term, count), index.words.counts(text), strict=True))
    assert index.words.counts_of([]) == []
    none = toxicity.Vocabulary({}).counts_of([b"a", None, b"alphabet"])
    assert [len(t) + len(c) for t, c in none] == [0, 0, 0]


@pytest.mark.parametrize("queries", [1, 7, 256])
def test_neighbours_of_many_queries_are_those_of_each(monkeypatch, queries):
    monkeypatch.setattr(toxicity, "QUERIES", queries)
    rnd = random.Random(4)
    vocabulary = [f"{rnd.choice('abcdefgh')}{k:03}{rnd.choice('xyz')}" for k in range(300)]

    def text(least):
        return " ".join(vocabulary[int(300 * rnd.random() ** 3)] for _ in range(rnd.randint(least, 25))).encode()

    index, rows = index_of([text(0) for _ in range(500)], [rnd.randint(0, 1) for _ in range(500)])
    assert 0 < index.search[1].shape[1] < len(index.idf)  # terms of either part
    asked = index.words.counts_of([*(text(1) for _ in range(40)), None, b"unknown"])
    got = index.nearest_of(asked)
    for (term, count), found in zip(asked, got, strict=True):
        own = dict(index.vector(dict(zip(term.tolist(), count.tolist(), strict=True))))
        want = sorted(((round(s, 9), i, y) for i, y, c in rows if (s := sum(w * own.get(t, 0) for t, w in index.vector(c))) > 0), key=lambda x: (-x[0], x[1]))[:16]
        assert [x[1:] for x in found] == [x[1:] for x in want]
        assert [x[0] for x in found] == pytest.approx([x[0] for x in want], abs=2e-9)
    assert index.nearest_of([asked[3]]) == [got[3]] and index.nearest_of([asked[-1]]) == [[]]
