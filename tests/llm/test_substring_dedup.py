import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tailseries.llm import common, substring_dedup as sd


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {
            j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)
        }
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))


@pytest.fixture
def corpus():
    rnd = random.Random(3)
    base = [rnd.choice("abcdeé") for _ in range(300)]
    rows = []
    for d in range(50):
        w = []
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, 250)
            w += base[at : at + rnd.randint(1, 40)] if rnd.random() < 0.5 else rnd.choices("abcdefgh", k=rnd.randint(0, 30))
        rows.append((d, rnd.choice([" ", "\n", " \t"]).join(w)))
    return rows + [
        (None, None),
        (None, "a b c"),
        (7, ""),
        (3, rows[3][1]),
        (90, " ".join("a" * 50)),
        (91, " ".join("ab" * 40)),
        (92, "x" * 5000),
    ]


@pytest.mark.parametrize("width,hot", [(12, 1000), (12, 3), (35, 1000), (3, 3)])
def test_against_brute_force(docs, corpus, monkeypatch, width, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    got = [tuple(r) for r in sd.substring_dedup(docs(corpus), window=width).collect()]
    assert in_order(got) == in_order(brute(corpus, width))


def test_a_sketch_that_is_too_narrow_loses_nothing(docs, corpus, monkeypatch):
    monkeypatch.setattr(sd, "MIN_LOG", 4)
    got = [tuple(r) for r in sd.substring_dedup(docs(corpus), window=12, max_log=4).collect()]
    assert in_order(got) == in_order(brute(corpus, 12))


def test_empty_table(docs):
    assert sd.substring_dedup(docs([(1, "a")]).where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_words_from_arrow_buffers(size):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ab \n\t\r\x0b\x0cé", k=rnd.randint(0, 40))) for _ in range(300)] + [None, "", "  ", "a" * 99]
    column, names, got = pa.array(["skipped", *texts]).slice(1), {}, []
    for p in common.pieces(column, size=size):
        for r in range(p.hi - p.lo):
            span = range(p.first[r], p.first[r + 1])
            got.append([bytes(p.data[p.starts[i] : p.ends[i]]).decode() for i in span])
            for i, w in zip(span, got[-1]):
                assert names.setdefault(w, p.hashes[i]) == p.hashes[i]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert len(set(names.values())) == len(names)


def test_packing_round_trip():
    values = np.arange(10, dtype=np.uint32)
    column = common.packed(values, [3, 0, 7])
    assert [len(v.as_py()) for v in column] == [12, 0, 28]
    assert common.unpacked(column, np.uint32).tolist() == values.tolist()


def test_words_of_two_letters_that_polynomials_confuse(docs):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(set(common.hash_spans(*spans([word, other, word]))[[0, 1]])) == 2
    rows = [(d, " ".join(f"{w}" if i == 17 else f"v{i}" for i in range(35))) for d, w in ((1, word), (2, other))]
    assert {r.doc_id: r.n_removed for r in sd.substring_dedup(docs(rows)).collect()} == {1: 0, 2: 0}


def spans(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return data, ends - np.array([len(w) for w in words]), ends


def test_hash_does_not_depend_on_what_lies_around(monkeypatch):
    words = ["one", "", "two", "one", "x" * 700, "two", "eno", "owt"]
    whole = common.hash_spans(*spans(words))
    monkeypatch.setattr(common, "PIECE", 8)
    assert (common.hash_spans(*spans(words)) == whole).all()
    assert whole[0] == whole[3] and whole[2] == whole[5] and len(set(whole.tolist())) == 6


def test_ids_of_any_type(docs):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(40))
    named = docs([(1, text), (2, text + " end"), (None, "a")]).withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    got = {r.doc_id: r.n_removed for r in sd.substring_dedup(named).collect()}
    assert got == {"n1": 40, "n2": 40, None: 0}
