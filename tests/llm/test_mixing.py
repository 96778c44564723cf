import itertools
import random
import re

import numpy as np
import pytest

from tailseries.llm.mixing import fit, mix_to_targets, mixed


def targets(sizes):
    """Shares by weight 1, 2, 3; excess over three times a source's size is shared again until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        if not over:
            out.update({s: unit * weight[s] for s in open_})
            break
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_takes(spark):
    rnd = random.Random(5)
    rows = [
        (d, " ".join("w" * rnd.randint(0, 40)) if rnd.random() < 0.95 else None, rnd.choice(["a", "a", "a", "b", "é", "Z", None]))
        for d in range(600)
    ] + [(1000 + d, "one", "tiny") for d in range(3)] + [(5, "x y", "a"), (5, "x y", "a"), (None, "q", "void"), (9, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS _key", "3 AS copies")
    got = mix_to_targets(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(size)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]}
        assert all(abs(r.target - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(2, 0.01 * want[s])
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = mix_to_targets(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mix = mixed(docs)
    assert mix.columns == ["doc_id", "text", "source", "size", "_key", "copies"]
    assert sum(r.copies for r in mix.collect()) == sum(r.copies for r in got)
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "source")
    assert sum(r.taken for r in mix_to_targets(named).collect()) > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_to_targets(docs).collect() == [] and mixed(docs).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_fit_is_as_near_as_any_choice_of_lengths(seed):
    rnd = random.Random(seed)
    lengths = np.array(sorted(rnd.sample(range(1, 30), 4)))
    counts = np.array([rnd.randint(1, 3) for _ in lengths])
    budget = rnd.randint(0, int((lengths * counts).sum()))
    taken = fit(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    sums = {int((lengths * c).sum()) for c in itertools.product(*(range(c + 1) for c in counts))}
    assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("seed", range(12))
def test_long_documents_are_fitted_from_either_side(seed):
    rnd = random.Random(seed)
    lengths = np.array(sorted(rnd.sample(range(1, 10**rnd.randint(2, 6) + 20), 12)))
    budget = rnd.randint(0, int(lengths.sum()))
    sums = [sum(c) for n in range(13) for c in itertools.combinations(lengths.tolist(), n)]
    best = min(abs(s - budget) for s in sums)
    assert abs(int((fit(lengths, np.ones(12, int), budget) * lengths).sum()) - budget) == best


@pytest.mark.parametrize(
    "lengths, counts, budget, words",
    [
        ([40_000, 50_000, 70_000], [1, 1, 1], 110_000, 110_000),
        ([40_000, 50_000, 70_000], [1, 1, 1], 120_000, 120_000),
        ([9, 360_000], [1, 1], 346_673, 360_000),
        ([1, 360_000], [9, 1], 346_673, 360_000),
        ([10], [1000], 5005, 5000),
        ([7, 1_000_003], [50_000, 900], 123_456_789, 123_350_369),
    ],
)
def test_known_fits(lengths, counts, budget, words):
    lengths = np.array(lengths)
    assert abs(int((fit(lengths, np.array(counts), budget) * lengths).sum()) - budget) <= abs(words - budget)


def test_many_lengths_come_within_the_shortest_one():
    rnd = np.random.default_rng(4)
    lengths = np.unique(np.round(np.exp(rnd.normal(6, 1.6, 4000))).astype(int) + 20)
    counts = rnd.integers(1, 9, len(lengths))
    for share in (0.1, 0.37, 0.73, 0.99):
        budget = int((lengths * counts).sum() * share)
        assert abs(int((fit(lengths, counts, budget) * lengths).sum()) - budget) <= lengths[0] // 2


def test_fit_is_exact_with_many_short_documents():
    lengths, counts = np.arange(1, 200), np.full(199, 50)
    for budget in (1, 777, 123_456, 500_000):
        assert int((fit(lengths, counts, budget) * lengths).sum()) == budget
