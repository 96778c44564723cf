import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tailseries.llm import fingerprint as fp


def edits(rows):
    ring = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(ring):
        t, after = t or "", ring[(i + 1) % len(ring)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 24, 400])
def test_edits_against_brute_force(docs, monkeypatch, part_bytes):
    monkeypatch.setattr(fp, "PART_BYTES", part_bytes)
    rnd = random.Random(part_bytes)
    ids = rnd.sample(range(-500, 5000), 60)
    rows = [(d, " ".join(rnd.choices(["é", "word", "x-y", "Zed"] + [f"v{i}" for i in range(50)], k=rnd.randint(0, 40)))) for d in ids]
    rows += [(None, None), (6001, ""), (6002, rows[0][1]), (6003, "long " * 4000)]
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fp.fingerprint_edits(docs(rows, 5)).collect()]
    assert sorted(got, key=str) == sorted(edits(rows), key=str)


def test_small_tables(docs):
    one = docs([(5, "a b c")])
    row = fp.fingerprint_edits(one).first()
    assert row.near_next == 1.0 and row.fingerprint == fp.fingerprint(one, fp.lexicon(one)).first().fingerprint
    assert fp.fingerprint_edits(one.where("doc_id < 0")).collect() == []
    assert len(fp.fingerprint_edits(docs([(5, "a b"), (5, "a b"), (5, "c")])).collect()) == 3


def test_likeness_follows_shared_terms(spark):
    rnd = random.Random(3)
    terms = [f"t{i}" for i in range(2000)]
    texts = [" ".join(rnd.choices(terms, k=150)) for _ in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = fp.lexicon(table, least=0.0, most=1.0)

    def prints(texts):
        return fp.fingerprints(pa.array(texts), words)

    own = prints(texts)
    assert (fp.likeness(own, prints([" ".join(reversed(t.upper().split())) for t in texts])) == 1).all()
    few = [" ".join(t.split()[:140] + rnd.choices(terms, k=10)) for t in texts]
    half = [" ".join(t.split()[:75] + rnd.choices(terms, k=75)) for t in texts]
    a, b, c = (fp.likeness(own, prints(x)).mean() for x in (few, half, texts[1:] + texts[:1]))
    assert a > 0.6 > 0.4 > b > 0.15 > 0.1 > c


def plain(text, lexicon):
    """The fingerprint written down by its definition: sorted distinct terms of each fixed sub-lexicon, hashed."""
    terms = fp._terms(pa.array([text]))
    _, _, h, _ = next(terms)
    every = sorted(int(x) for x in set(h.tolist()))
    out = [0] * fp.SUBSETS
    for s in range(fp.DRAWS):
        for halvings in range(fp.LEVELS):
            of = []
            for term in every:
                drawn = int(fp.mix(np.array([term], np.uint64) ^ fp._SEEDS[s])[0])
                if term in lexicon and drawn < 2 ** (64 - halvings):
                    of.append(drawn)
            total = sum(int(fp.mix(np.array([(d + i) % 2**64], np.uint64))[0]) for i, d in enumerate(of)) % 2**64
            if of:
                out[(fp.LEVELS - 1 - halvings) * fp.DRAWS + s] = max(int(fp.mix(np.array([total], np.uint64))[0]) >> 48, 2)
    return out if len(every) else [fp.NOTHING] * fp.SUBSETS


def test_fingerprints_and_likeness_against_brute_force(spark):
    rnd = random.Random(9)
    terms = [f"t{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(terms, k=rnd.choice([0, 1, 3, 40]))) for _ in range(60)] + ["zz only", "", texts_twice := "t1 t2 t3", texts_twice]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = fp.lexicon(table, least=0.02, most=0.3)
    lexicon = {int(h) for t in terms for h in next(fp._terms(pa.array([t])))[2] if words.find(np.array([h]))[0] >= 0}
    assert 20 < len(lexicon)
    got = fp.fingerprints(pa.array(texts), words)
    assert got.tolist() == [plain(t, lexicon) for t in texts]
    assert fp.fingerprints(pa.array([None] + texts[7:30]), words)[1:].tolist() == got[7:30].tolist()
    near = fp.likeness(got[:-1], got[1:])
    for a, b, value in zip(got[:-1].tolist(), got[1:].tolist(), near):
        places = [(x, y) for x, y in zip(a, b) if x or y][: fp.PLACES]
        assert value == pytest.approx(sum(x == y for x, y in places) / len(places) if places else 0)
    assert near[-1] == 1 and (got[-1] == got[-2]).all()
    assert (got[60] == 0).all() and fp.likeness(got[60:61], got[60:61]) == 0


def test_lexicon_is_the_band(spark):
    table = spark.createDataFrame([(i, "all " + ("some " if i < 3 else "") + f"only{i}") for i in range(10)], "doc_id long, text string")
    words = fp.lexicon(table, least=0.2, most=0.5)
    assert len(words.keys) == 1
    assert np.unique(fp.fingerprints(pa.array(["some", "some some x", "SOME all"]), words), axis=0).shape[0] == 1
