import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tailseries.llm import spelling
from tailseries.llm.spelling import Reduction, damaged_runs, deal_letters, near_pairs, spelling_variants, vocabulary

from .conftest import rows_of


def edits(word, letters):
    """All words one edit away, written down directly."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def brute(counts, times=10):
    letters = set("".join(counts))
    near = {w: sorted(edits(w, letters) & set(counts)) for w in counts}
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def table(spark, counts):
    rows = [(w, n, "x", 1) for w, n in counts.items()]
    return spark.createDataFrame(rows, "word string, n long, key string, own long").repartition(3)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "aeéèxñÿ", "abΩ漢😀"])
def test_equals_brute_force(spark, letters):
    rng = random.Random(letters)
    counts = {}
    for _ in range(250):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        counts[w] = rng.choice([1, 2, 3, 20, 30, 300, 300, 4000, 50000])
    assert set(rows_of(spelling_variants(table(spark, counts)))) == brute(counts)


def test_chain_is_followed_to_its_end_and_ties_go_to_the_smaller_word(spark):
    chain = {"z" * i + "abcdefgq"[i:]: 2 * 10**i for i in range(6)}
    words = {**chain, "tie": 1, "tia": 10, "tib": 10}
    got = {r[0]: r for r in rows_of(spelling_variants(table(spark, words)))}
    assert set(got.values()) == brute(words)
    assert got["abcdefgq"][2] == list(chain)[-1]
    assert got["tie"][1] == "tia"


def test_crowded_alphabet_is_left_for_a_finer_one(spark, monkeypatch):
    # All letters of these words would share a symbol at first; a finer alphabet keeps groups small.
    rng = random.Random(5)
    counts = {"".join(rng.choice("abc") for _ in range(8)): rng.randint(1, 99) for _ in range(300)}
    sizes = []
    real = spelling.deal_letters
    monkeypatch.setattr(spelling, "SYMBOLS", (1, 2, 256))
    monkeypatch.setattr(spelling, "CROWD", 1)
    monkeypatch.setattr(spelling, "deal_letters", lambda found, n: sizes.append(n) or real(found, n))
    assert set(rows_of(spelling_variants(table(spark, counts)))) == brute(counts)
    assert sizes == [1, 2, 256]


def test_key_collisions_lose_nothing(spark, monkeypatch):
    real = Reduction._key
    monkeypatch.setattr(Reduction, "_key", lambda self, total, n: real(self, total, n) & 7)
    monkeypatch.setattr(spelling, "CROWD", 10**9)
    counts = {w: 3 for w in ("abcd", "abce", "abcde", "bcde", "xyz", "xyzz", "q", "qq")}
    assert set(rows_of(spelling_variants(table(spark, counts)))) == brute(counts)


def test_neighbourhood_covers_every_edit():
    letters = [("a", 5), ("b", 4), ("c", 3), ("d", 1), ("e", 1)]
    reduction = Reduction(deal_letters(letters, 3), 3)
    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
        for b in edits(a, "abcde"):
            found = [set(k for keys, _ in reduction.neighbours([w]) for k in keys.tolist()) for w in (a, b)]
            own = [int(reduction.keys([w])[0]) for w in (a, b)]
            assert own[1] in found[0] or own[0] in found[1], (a, b)


def test_empty_null_repeated_and_long(spark):
    assert rows_of(spelling_variants(table(spark, {}))) == []
    long = "ab" * 40_000
    counts = {long: 50, long + "c": 2, long[1:]: 3, "": 4, "a": 1}
    got = {r[0]: r[1:] for r in rows_of(spelling_variants(table(spark, counts).unionByName(
        spark.createDataFrame([(None, 5, "k", 1)], "word string, n long, key string, own long"))))}
    assert got[long + "c"] == (long, long, 2, 1, 50)
    assert got[long][3] == 2
    assert got["a"] == (None, "a", 1, 1, None)
    with pytest.raises(ValueError):
        spelling_variants(table(spark, {}), times=1)


def test_runs_are_damaged_by_the_checksum(spark, docs):
    rng = random.Random(3)
    texts = [
        (i, " ".join("".join(rng.choice("abéÀÿXYZ") for _ in range(rng.randint(1, 12))) for _ in range(80)))
        for i in range(12)
    ]
    texts += [(None, "Abcdefgh ABCDEFGH"), (3, None), (4, ""), (5, "mixed1234567letters漢字漢字漢字漢字"), texts[0]]
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = damaged_runs(docs(texts).withColumn("h", F.lit(1)).withColumn("run", F.lit("r")))
    assert Counter(r[0] for r in rows_of(got)) == want
    assert dict(rows_of(vocabulary(got))) == {w: n for w, n in want.items() if n >= 2}


def test_pairs_are_unordered_and_unique(spark):
    words = ["aab", "ab", "aabb", "abb", "bab"]
    got = [(r[0], r[2]) for r in rows_of(near_pairs(table(spark, dict.fromkeys(words, 1)).select("word", "n")))]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and b in edits(a, "ab")}
