import math
import random
import re
from collections import Counter

import pytest

from tailseries.llm import ngram_score as ng


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(corpus, rows, order):
    counts, total = Counter(), 0
    for _, t in corpus:
        w = words(t)
        total += len(w)
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for d, t in rows:
        w, score = words(t), 0.0
        for i in range(len(w)):
            n, factor = min(order, i + 1), 1.0
            while n and not counts[tuple(w[i - n + 1 : i + 1])]:
                n, factor = n - 1, factor * (0.4 if n > 1 else 1)
            top = counts[tuple(w[i - n + 1 : i + 1])] if n else 1
            score += math.log(factor * top / (counts[tuple(w[i - n + 1 : i])] if n > 1 else total))
        out.append((d, len(w), score))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[2], 6)))


@pytest.fixture
def corpus():
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "A"]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))) for i in range(60)]
    return rows + [(90, None), (None, "a w1 w2 w3"), (91, "solo"), (92, "a b"), (92, "a b"), (93, "w1 " * 3000)]


@pytest.mark.parametrize("partition,order", [(4_000_000, 3), (100, 3), (40, 2), (40, 1), (100, 4)])
def test_corpus_against_brute_force(docs, corpus, monkeypatch, partition, order):
    monkeypatch.setattr(ng, "PARTITION", partition)
    monkeypatch.setattr(ng, "DOCS", 300)
    got = in_order([(r.doc_id, r.n_words, r.log_score) for r in ng.score_corpus(docs(corpus), order=order).collect()])
    want = in_order(brute(corpus, corpus, order))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want))


def test_other_documents_back_off(docs, corpus):
    new = [(1, "w1 w2 zz w3 w4 w5 w1"), (2, "zz yy"), (3, "w1 W2"), (3, "w1 W2"), (3, "zz"), (4, None), (5, " "), (None, "w3 zz w3")]
    got = ng.score_documents(docs(new), ng.count_tables(docs(corpus)))
    got = in_order([(r.doc_id, r.n_words, r.log_score) for r in got.collect()])
    want = in_order(brute(corpus, new, 3))
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_ids_must_be_whole_numbers(docs):
    with pytest.raises(TypeError):
        ng.score_corpus(docs([(1, "a")]).selectExpr("concat('n', doc_id) AS doc_id", "text"))


def test_empty_table(docs):
    assert ng.score_corpus(docs([(1, "a")]).where("doc_id < 0")).collect() == []
