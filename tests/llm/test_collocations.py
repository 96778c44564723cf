import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailseries.llm import collocations as C
from tailseries.llm.collocations import chunk_table, collocations, gram_counts

from .conftest import rows_of


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", text)]


def brute_counts(rows):
    out = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    out[lang or "und", tuple(w[i : i + n])] += 1
    return out


def brute(rows, least, percent, best):
    f = brute_counts(rows)
    words = Counter()
    for (lang, g), c in f.items():
        words[lang] += c if len(g) == 1 else 0
    found = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found[lang, g] = (a, f[lang, g[:k]], f[lang, g[k:]], score)
    hidden = set()
    for (lang, g), (a, *_) in found.items():
        if len(g) == 3:
            hidden |= {(lang, s) for s in (g[:2], g[1:]) if (lang, s) in found and 100 * a >= percent * found[lang, s][0]}
    out = set()
    for lang in words:
        kept = [(-v[3], -v[0], " ".join(g).encode(), v) for (x, g), v in found.items() if x == lang and (x, g) not in hidden]
        for rank, (_, _, phrase, v) in enumerate(sorted(kept)[:best], 1):
            out.add((lang, rank, phrase.decode(), v[0], v[1], v[2], words[lang], v[3]))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "rio", "grande", "são", "漢", "😀x", "b-c", "\xa0y"]
    rows = []
    for _ in range(n):
        text = "".join(
            rng.choices(words, [9, 3, 6, 5, 4, 4, 2, 2, 1, 1, 1])[0] + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n"])
            for _ in range(rng.randint(0, 40))
        )
        rows.append((rng.choice(["en", "en", "pt", None]), text))
    return rows + rows[:20] + [("en", None), ("en", ""), ("xx", " ... "), (None, "of the of the of the " * 300), ("pt", "a " * 2000)]


def table(spark, rows):
    df = spark.createDataFrame([(x, t, 1, "q") for x, t in rows], "lang string, text string, f int, gram string")
    return df.withColumns({"chunk": F.lit(1), "times": F.lit(2)}).repartition(5)


@pytest.mark.parametrize("period", [1, 2, 8, 10**9])
def test_counts_equal_brute_force_for_any_parse(spark, period):
    rows = corpus(period)
    got = gram_counts(chunk_table(table(spark, rows), period=period))
    want = brute_counts(rows)
    found = rows_of(got.select("lang", "gram", "f"))
    assert {(lang, tuple(g.split(" "))): f for lang, g, f in found if g} == want
    totals = {lang: f for lang, g, f in found if not g}
    assert totals == {x: sum(c for (y, g), c in want.items() if y == x and len(g) == 1) for x, _ in want}


def test_small_slices_give_the_same_counts(spark, monkeypatch):
    rows = corpus(11)
    monkeypatch.setattr(C, "SLICE", 64)
    got = gram_counts(chunk_table(table(spark, rows)))
    assert {(r[0], tuple(r[1].split(" "))): r[2] for r in rows_of(got) if r[1]} == brute_counts(rows)


def test_chunks_overlap_by_two_words_and_repeat_with_their_passage():
    text = " ".join(f"w{i}" for i in range(200))
    column = pa.array([text + ". " + text, "start " + text])
    data = np.frombuffer(column.buffers()[2], np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[:3].astype(np.int64)
    words, starts, ends, last, row = C.parse(data, offsets)
    chunks = [bytes(words[a:b]).decode().split(" ") for a, b in zip(starts, ends)]
    for a, b, whole in zip(chunks, chunks[1:], last):
        assert whole or a[-2:] == b[:2]
    first = [tuple(c) for c, r in zip(chunks, row) if r == 0]
    assert first[: len(first) // 2] == first[len(first) // 2 :]
    assert len({tuple(c) for c in chunks}) <= len(first) // 2 + 2
    owned = [w for c, e in zip(chunks, last) for w in (c if e else c[:-2])]
    assert owned == 2 * text.split(" ") + ["start"] + text.split(" ")


@pytest.mark.parametrize("seed, least, percent, best", [(1, 2, 50, 2000), (2, 10, 50, 7), (3, 2, 90, 30), (4, 1, 1, 2000)])
def test_equals_brute_force(spark, seed, least, percent, best):
    rows = corpus(seed)
    got = collocations(table(spark, rows), least=least, inside_percent=percent, best=best)
    assert set(rows_of(got)) == brute(rows, least, percent, best)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 28])
def test_a_full_filter_only_lets_more_pass(spark, monkeypatch, bits):
    rows = corpus(7)
    monkeypatch.setattr(C, "FILTER", bits)
    got = gram_counts(chunk_table(table(spark, rows)), least=3)
    found = {(r[0], tuple(r[1].split(" "))): r[2] for r in rows_of(got) if r[1]}
    assert found == {g: f for g, f in brute_counts(rows).items() if f >= 3}


def test_empty_table(spark):
    assert rows_of(collocations(table(spark, []))) == []
    assert rows_of(collocations(table(spark, [("en", None), (None, "")]))) == []


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    big = 3_000_000_019
    counts = [("en", "", 10 * big), ("en", "a", big + 7), ("en", "b", big + 1), ("en", "a b", big)]
    monkeypatch.setattr(C, "gram_counts", lambda *_, **__: spark.createDataFrame(counts, "lang string, gram string, f long"))
    ((*_, score),) = rows_of(collocations(table(spark, [("en", "a b")])))
    assert score == 10**6 * big * big // ((big + 7) * (big + 1))
