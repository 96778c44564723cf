import random
import re
from collections import Counter

import pytest

from tailseries.llm import near_dedup as nd


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=75):
    sets, root, holders = [shingles(t) for _, t in rows], list(range(len(rows))), {}

    def find(a):
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for i, s in enumerate(sets):
        for j, n in Counter(j for h in s for j in holders.get(h, ())).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for h in s:
            holders.setdefault(h, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)}


def results(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(df, **options).collect()}


def test_group_of_near_copies_in_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(nd, "LIST_BLOCK", 64)
    monkeypatch.setattr(nd, "BLOCK", 16)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = rnd.choices(words, k=120)
    rows = []
    for d in range(250):
        copy = list(base)
        for _ in range(rnd.randint(0, 10)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        rows.append((d, " ".join(copy)))
    rows += [(d, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for d in range(400, 450)]
    rows += [(500, "a b"), (501, "A b"), (502, "c"), (503, None), (504, ""), (505, rows[7][1]), (506, "z " * 20000)]
    rnd.shuffle(rows)
    assert results(docs(rows)) == brute(rows)


def test_chain(docs):
    rnd = random.Random(2)
    text = rnd.choices([f"w{i}" for i in range(3000)], k=200)
    rows = [(1000 - d, " ".join(text[d * 4 : d * 4 + 100])) for d in range(25)]
    got = results(docs(rows))
    assert got == brute(rows)
    assert {v[1] for v in got.values()} == {976}


def test_nulls_and_repeated_rows(docs):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, None), (4, "x"), (4, "x"), (4, "y z")]
    got = sorted(map(tuple, nd.near_dedup(docs(rows)).collect()), key=str)
    assert got == sorted(
        [(None, 2, 3, False)] * 2 + [(3, 2, 3, True), (None, 0, None, True)] + [(4, 1, 4, True)] * 3, key=str
    )
    kept = nd.one_of_each(docs(rows))
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id IS NOT NULL").collect()) == [
        (3, "a b c d e f"), (4, "x"), (4, "y z"),
    ]
    assert kept.columns == docs(rows).columns


def test_empty_table(docs):
    assert nd.near_dedup(docs([(1, "a")]).where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root if find(a) != a}


@pytest.mark.parametrize("percent", [30, 50, 90, 100])
def test_other_thresholds_lose_no_link(docs, percent):
    rnd = random.Random(percent)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for d in range(300):
        if d % 3 and rnd.random() < 0.8:
            copy = rows[rnd.randrange(len(rows))][1].split()
            for _ in range(rnd.randint(0, 12)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
        else:
            copy = rnd.choices(words, k=rnd.randint(20, 90))
        rows.append((d, " ".join(copy)))
    assert results(docs(rows), percent=percent) == brute(rows, percent)


def test_matches_follow_from_the_threshold(docs):
    assert (nd.matches(75, 40), nd.matches(75, 256)) == (17, 160)
    assert nd.matches(100, 40) == 40 and 1 <= nd.matches(20, 40) < nd.matches(50, 40) < 17
    for percent in (0, 101):
        with pytest.raises(ValueError):
            nd.near_dedup(docs([(1, "a")]), percent=percent)


def test_words_of_two_letters_that_polynomials_confuse(docs):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(d, " ".join(f"{w}{i}" for i in range(9))) for d, w in ((1, word), (2, other))]
    assert results(docs(rows)) == {1: (5, 1, True), 2: (5, 2, True)}


def test_ids_of_any_type(docs):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z"), (None, "x y z")]
    named = docs(rows).withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    got = {r.doc_id: (r.component_id, r.kept) for r in nd.near_dedup(named).collect()}
    assert got == {"n1": ("n1", True), "n2": ("n1", False), "n3": ("n3", True), None: ("n3", False)}
    assert sorted(r.doc_id for r in nd.one_of_each(named).collect()) == ["n1", "n3"]
