import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tailseries.llm import decontaminate as dc


def brute(docs, items, stride, share, overlap):
    """BM25 of every passage with every item, then the overlap of both parts."""
    words = [(q + " " + a).split() for _, q, a in items]
    df, mean = Counter(w for t in words for w in set(t)), sum(map(len, words)) / len(words)

    def weight(term, i):
        tf = words[i].count(term)
        idf = math.log(1 + (len(words) - df[term] + 0.5) / (df[term] + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))

    def contained(part, passage):
        part = part.split()
        n = min(3, len(part))
        grams = [{tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (part, passage)]
        return len(grams[0] & grams[1]) / len(grams[0]) if n else 1.0

    out = {}
    for r, d in enumerate(docs):
        w = re.findall(r"[a-z0-9]+", (d or "").lower())
        for at in range(0, max(stride, len(w) - stride), stride):
            passage = w[at : at + 2 * stride]
            for i, (_, q, a) in enumerate(items):
                score = sum(weight(t, i) for t in set(words[i]) & set(passage))
                enough = share * sum(weight(t, i) for t in set(words[i]))
                if score >= enough - 1e-6 and min(contained(q, passage), contained(a, passage)) >= overlap:
                    out[r, i] = max(out.get((r, i), 0), score)
    return out


@pytest.fixture
def case():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, *dc.parts(" ".join(rnd.choices(words, k=rnd.randint(1, 30))))) for i in range(40)]
    docs = [" ".join(rnd.choices(words, k=rnd.randint(0, 300))) for _ in range(40)] + [None, ""]
    for k in range(20):
        docs[k] += " " + items[k][1].upper() + "! " + items[k][2] + " " + " ".join(rnd.choices(words, k=100))
    return docs, items


def test_against_brute_force(case):
    docs, items = case
    index = dc.Index(items, 0.5)
    got = {(r, i): s for r, i, s, *_ in index.matches(pa.array(docs), 0.5)}
    want = brute(docs, items, index.stride, 0.5, 0.5)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert {(k, k) for k in range(20)} <= got.keys()


def test_many_indexes_give_the_same_pairs(spark, docs, case, monkeypatch):
    texts, items = case
    table = docs(list(enumerate(texts)))
    benchmark = spark.createDataFrame([(i, f"{q} {a}") for i, q, a in items] + [(None, None), (99, "")], "item_id long, text string")
    whole = {(r.doc_id, r.item_id): r.bm25 for r in dc.contaminated(table, benchmark).collect()}
    monkeypatch.setattr(dc, "ITEMS", 7)
    scored = {(r.doc_id, r.item_id): r.bm25 for r in dc.contaminated(table, benchmark).collect()}
    assert scored.keys() == whole.keys() and all(abs(scored[k] - whole[k]) < 1e-4 for k in whole)
    stride = max(dc.SHORTEST, *(len(f"{q} {a}".split()) for _, q, a in items))
    want = brute(texts, items, stride, 0.5, 0.5)
    assert scored.keys() == want.keys() and all(abs(scored[k] - want[k]) < 1e-4 for k in want)
    pairs = scored.keys()
    assert {(k, k) for k in range(20)} <= pairs
    clean = dc.decontaminate(table, benchmark)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in pairs}


def test_empty_tables(spark, docs):
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    table = docs([(1, "one two three four"), (1, "one two three four"), (None, "zero ONE, two three four.")])
    assert [tuple(r)[:2] for r in dc.contaminated(table, benchmark).orderBy("doc_id").collect()] == [(None, 1), (1, 1), (1, 1)]
    assert dc.contaminated(table.where("doc_id > 5"), benchmark).collect() == []
    assert dc.contaminated(table, benchmark.where("item_id > 5")).collect() == []
    assert dc.decontaminate(table, benchmark.where("item_id > 5")).count() == 3


def test_question_and_answer_columns(spark, docs):
    asked = spark.createDataFrame([(1, "who wrote the long book", "nobody knows it")], "item_id long, q string, a string")
    table = docs([(1, "who wrote the long book nobody knows it"), (2, "who wrote the long book")])
    got = dc.contaminated(table, asked, question_col="q", answer_col="a").collect()
    assert [r.doc_id for r in got] == [1]
