"""Each stage of the pipeline, on the output of the one before, against what plain Python makes of it."""

import os

import pytest

import corpus_pipeline

from tests.llm import test_line_dedup, test_near_dedup

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns[: len(columns)] == columns
        assert n + 1 == len(corpus_pipeline.STAGES) or after.columns == columns
        seen[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()})
        docs = after

    before, after = seen["language_id"]
    assert after.keys() == {d for d, r in before.items() if any(c.isalpha() for c in r.text or "")}

    before, after = seen["line_dedup"]
    want = {d: t for d, n, gone, t in test_line_dedup.brute([(d, r.text) for d, r in before.items()], 10) if not gone or gone < n}
    assert {d: r.text for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())

    before, after = seen["near_dedup"]
    assert after.keys() == {d for d, r in test_near_dedup.brute([(d, r.text) for d, r in before.items()]).items() if r[2]}

    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert before.keys() - after.keys() == {d for d, r in before.items() if any(i in r.text for i in items)}

    before, after = seen["mixing"]
    assert after and after.keys() <= before.keys() and all(1 <= r.copies <= 3 for r in after.values())
    words = sum(len(r.text.split()) for r in before.values())
    assert abs(sum(len(r.text.split()) * r.copies for r in after.values()) - words) < 0.02 * words
