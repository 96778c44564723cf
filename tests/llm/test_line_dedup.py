import random
import re

import pytest
from pyspark.sql import functions as F

from tailseries.llm.line_dedup import line_dedup, suffix_ranks


def n_words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute(rows, least):
    """Every run of lines, in order of the documents, against all runs that began before it."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        full = [x for x in lines if n_words(x)]
        gone = set()
        for i in range(len(full)):
            runs = [tuple(full[i:j]) for j in range(i + 1, len(full) + 1)]
            for run in runs:
                if run in seen and sum(map(n_words, run)) >= least:
                    gone.update(range(i, i + len(run)))
            seen.update(runs)
        kept, i = [], -1
        for x in lines:
            i += bool(n_words(x))
            if not (n_words(x) and i in gone):
                kept.append(x)
        out.append((rows[k][0], len(full), len(gone), "\n".join(kept)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3], r[2]))


@pytest.mark.parametrize("least,longest", [(4, 2), (10, 3), (3, 1), (10, 12)])
def test_against_brute_force(docs, least, longest):
    rnd = random.Random(least)
    rows = []
    for d in range(40):
        lines = [
            rnd.choice("abcdefgh") + " x" * rnd.randint(0, longest - 1)
            if rnd.random() < 0.85
            else rnd.choice(["", " ", f"q{rnd.randint(0, 99)}"])
            for _ in range(rnd.randint(0, 12))
        ]
        rows.append((d, "\n".join(lines)))
    twice = "a b c d e\nf g h i j k l\n\nz"
    rows += [(50, rows[3][1]), (51, None), (52, ""), (None, rows[5][1]), (53, "\n".join("a x" * 9 for _ in range(7)))]
    rows += [(60, twice), (60, twice), (61, twice), (62, "y " * 3000)]
    cut = line_dedup(docs(rows), min_words=least)
    got = [(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in cut.collect()]
    assert in_order(got) == in_order(brute(rows, least))


def test_carries_columns_and_takes_empty_tables(docs):
    df = docs([(1, "a b")])
    assert line_dedup(df, carry=("words", "_id")).select("_row.words").first().words == "x"
    assert line_dedup(df.where("doc_id < 0")).collect() == []


def test_ranks_are_those_of_the_suffix_array(spark):
    text = "abracadabra" * 2
    lines = spark.createDataFrame(
        [(0, 0, i, 1, ord(c), 0) for i, c in enumerate(text)], "_k1 long, _k2 long, i long, words long, l1 long, l2 long"
    )
    deepest = suffix_ranks(lines, 32).orderBy(F.col("r5")).select("i").collect()
    # c and d occur twice, so all lines take part and the whole text is one string.
    assert [r.i for r in deepest] == sorted(range(len(text)), key=lambda i: text[i:])
