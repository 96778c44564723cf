import random

import numpy as np
import pytest

from tailseries.llm import language_id as li

SYLLABLES = {"xx": ["ba", "ko", "ti", "ru"], "yy": ["sch", "ein", "ung", "er"], "zz": ["ção", "que", "ão", "lh"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang, rnd.randint(3, 60)), lang) for i, lang in enumerate(rnd.choices(list(SYLLABLES), k=600))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return li.fit(labelled.where(li.fold() != 2))


def test_held_out_accuracy(labelled, model):
    got = li.identify(labelled.where(li.fold() == 2), model).select("_row.lang", "lang_pred", "score", "rejected").collect()
    assert len(got) > 30
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)


def test_probabilities_sum_to_one(model):
    symbols = np.unique(np.concatenate([[li.SPACE], li.symbols(["".join(sum(SYLLABLES.values(), []))])[0]]))
    context = li.grams(["schein"])[0][-1] & li.U64((1 << li.BITS * (li.ORDER - 1)) - 1)
    total = np.exp(model._log_p((context << li.U64(li.BITS)) | symbols.astype(li.U64), li.ORDER)).sum(axis=0)
    assert (total < 1.0001).all() and (total > 0.9).all()


def test_unknown_and_rejected(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "Scheinung ein"), (5, "wjqxv qqxzj vvkwq " * 20), (6, "kotiru " * 30000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS score", "'b' AS _row", "'c' AS lang_pred")
    got = {r.text: r for r in li.identify(table, model).selectExpr("_row.text", "lang_pred", "score", "rejected", "doc_id").collect()}
    assert all((got[t].lang_pred, got[t].score, got[t].rejected) == ("und", 0.0, True) for t in (None, "", "123 !!"))
    assert got["Scheinung ein"].lang_pred == "yy" and got["Scheinung ein"].doc_id is None
    assert got[rows[4][1]].rejected and got[rows[4][1]].lang_pred != "und"
    assert got[rows[5][1]].lang_pred == "xx"


def test_nothing_to_learn_from(labelled):
    assert li.fit(labelled.where("doc_id < 0")) is None
    assert {r.lang_pred for r in li.identify(labelled, None).collect()} == {"und"}
    assert li.identify(labelled.where("doc_id < 0"), None).collect() == []


def test_hash_array():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 60, 5000).astype(np.uint64))
    table = li.HashArray(keys[::2], np.arange(len(keys[::2])))
    at = table.find(keys)
    assert (at[1::2] == -1).all() and (table.values[at[::2]] == np.arange(len(keys[::2]))).all()
