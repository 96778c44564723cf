import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailseries.llm.common import read
from tailseries.llm.queries import op11_quality
from tailseries.llm.quality import (
    STATISTICS,
    bin_edges,
    best_cuts,
    boost,
    fit,
    histograms,
    sample_ids,
    score_quality,
    statistics,
)

from .conftest import rows_of

BLANK = " \t\n\x0b\x0c\r"


def kind(b):
    c = chr(b)
    return b >= 128 and 6 or (c.isupper() and 1) or (c.islower() and 2) or (c.isdigit() and 3) or (c.isspace() and 5) or (
        c.isprintable() and 4
    )


def words_of(text):
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(text):
    """The statistics of one text, one after the other."""
    data = text.encode()
    words = [w.encode() for w in words_of(text)]
    lines = [w for w in (words_of(line) for line in text.split("\n")) if w]

    def share(part, whole):
        return part / whole if whole > 0 else 0

    def of(test):
        return share(sum(bool(test(w)) for w in words), len(words))

    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        share(sum(map(len, words)), len(words)),
        max(map(len, words), default=0),
        *[share(sum(kind(b) == k for b in data), len(data)) for k in (1, 2, 3, 4, 5, 6)],
        math.log1p(len(lines)),
        share(len(words), len(lines)),
        share(sum(len(line) < 4 for line in lines), len(lines)),
        share(len(lines) - len(set(map(tuple, lines))), len(lines)),
        share(len(set(words)), len(words)),
        share(max((words.count(w) for w in set(words)), default=0), len(words)),
        share(sum(a == b for a, b in pairs), len(words)),
        share(len(set(pairs)), len(words) - 1),
        share(sum(a == b for a, b in zip(data, data[1:])), len(data)),
        of(lambda w: kind(w[-1]) == 4),
        of(lambda w: all(kind(b) not in (1, 2, 6) for b in w)),
        of(lambda w: kind(w[0]) == 1),
        of(lambda w: sum(kind(b) == 1 for b in w) > 1 and all(kind(b) != 2 for b in w)),
        of(lambda w: w[-1] in b"!.?"),
    ]


def texts():
    rng = random.Random(2)
    out = ["", None, " ", "\n\n", "A", "aa\naa\n\naa", "a b\na b\nb", "ÉÉ éé 漢字 😀 ?!", "END\n", "\nEND", "x" * 5000]
    for _ in range(60):
        out.append("".join(rng.choice("abAB1. \n!é\t") for _ in range(rng.randint(1, 60))))
    return out + ["word " * 400_000 + "\nend"]


def test_statistics_equal_a_plain_computation():
    found = statistics(pa.array(texts()))
    assert found.shape[1] == len(STATISTICS)
    for text, row in zip(texts()[:-1], found):
        assert row.tolist() == pytest.approx(plain(text or ""), abs=1e-12), text
    assert statistics(pa.array(texts())[3:20]).tolist() == found[3:20].tolist()
    assert statistics(pa.array([], pa.string())).shape == (0, len(STATISTICS))
    assert (found[0] == 0).all() and (found[1] == 0).all()


def sample(n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = 7
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    return x, y


def test_best_cut_equals_trying_every_cut():
    x, y = sample(120)
    edges = bin_edges(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=len(x)), rng.uniform(0.1, 1, len(x))
    node = rng.integers(0, 2, len(x))
    bins = max(map(len, edges)) + 1
    f, b, gain = best_cuts(*histograms(binned, node, 2, bins, g, h), 1.0, 2.0)
    for k in range(2):
        best = 0
        for c in range(x.shape[1]):
            for cut in edges[c]:
                left, right = (node == k) & (x[:, c] <= cut), (node == k) & (x[:, c] > cut)
                if min(h[left].sum(), h[right].sum()) >= 2:
                    parts = [g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, right, node == k)]
                    best = max(best, parts[0] + parts[1] - parts[2])
        assert gain[k] == pytest.approx(best)
    assert (x[:, 0] <= edges[0][3]).tolist() == (binned[:, 0] <= 3).tolist()


def test_flat_trees_equal_walking_node_by_node():
    x, y = sample()
    model = boost(x, y, trees=7, depth=3)

    def walk(row):
        total = model.base
        for t in range(7):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.cut[t, node] else 1)
            total += model.leaf[t, node - 7]
        return 1 / (1 + math.exp(-total))

    assert model.score(x).tolist() == pytest.approx([walk(r) for r in x])
    assert ((boost(x, y).score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_nothing_or_one_label_to_learn_from():
    none = boost(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert none.score(np.ones((0, 3))).tolist() == []
    assert (boost(*sample()[:1], np.ones(300)).score(sample()[0]) > 0.9).all()


def test_sample_is_bounded_and_whole_when_it_fits(spark):
    rows = [(i % 900, i % 2) for i in range(1000)] + [(None, 1), (3, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    every = rows_of(sample_ids(labels, id_col="doc_id", label_col="quality", sample_docs=900))
    assert dict(every) == {i: float(i % 2) for i in range(900)}
    part = rows_of(sample_ids(labels, id_col="doc_id", label_col="quality", sample_docs=300))
    assert 250 < len(part) <= 300
    assert set(part) <= set(every)


def test_whole_run_with_nulls_text_ids_repeats_and_clashing_names(spark, docs):
    good = "The quiet river ran past the old mill, and nobody spoke of it. "
    rows = [(i, good * (1 + i % 5) if i % 3 else "BUY!! NOW!! " * (2 + i % 7)) for i in range(90)]
    rows += [(None, "BUY!! NOW!!"), (200, None), (201, ""), rows[1], (1, "another text under the same id")]
    table = docs(rows).withColumns({"score": F.lit("old"), "predicted": F.lit(9), "label": F.lit(1), "x": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)], "doc_id long, quality int")
    model = fit(table, labels, trees=20)
    got = score_quality(table, model).select("doc_id", "text", "score", "predicted", "_text").collect()
    assert len(got) == len(rows)
    assert sorted((r[0] is None, r[0], r[1] or "") for r in got) == sorted((i is None, i, t or "") for i, t in rows)
    for i, t, score, predicted, extra in got:
        assert 0 <= score <= 1 and predicted == (score >= 0.7) and extra == "x"
        if t and i != 1:
            assert predicted == (0 if t.startswith("BUY") else 1)
    empty = {r[2] for r in got if not r[1]}
    assert len(empty) == 1
    text_ids = table.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    named = labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert score_quality(text_ids, fit(text_ids, named, trees=2)).count() == len(rows)
    assert rows_of(score_quality(table.limit(0), fit(table.limit(0), labels))) == []


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    scored = op11_quality(spark, folder).join(read(spark, folder, "labels"), "doc_id")
    held = rows_of(scored.where("held_out").select("quality", "score", "predicted"))
    good, bad = [r[1] for r in held if r[0]], [r[1] for r in held if not r[0]]
    assert len(good) > 50 and len(bad) > 5
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / len(good) / len(bad)
    assert auc > 0.97
    assert sum(r[0] == r[2] for r in held) / len(held) > 0.95
