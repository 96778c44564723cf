"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band of inverse document frequency.
It is counted over all documents and has at most (distinct terms of a mean document) / ``least``
terms, whatever their number, which bounds what is broadcast. SUBSETS random sub-lexicons of it are drawn once, by DRAWS
seeded hashes of each term: every draw gives one with all terms, one with half of them, and so on down to one part
in 2 ** (LEVELS - 1), so that short and long documents alike meet sub-lexicons of which they have few terms.

A document's fingerprint has one hash for each sub-lexicon, the smallest first: that of its distinct terms in it, sorted.
Where it has none the place is empty (0). The likeness of two fingerprints is the share of equal hashes among the
first PLACES that at least one of them fills, which are those of few terms; with nothing to go by it is 0, unless
both texts have no words at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tailseries.llm.common import U64, mix, pieces, row_key, ship, text_bytes
from tailseries.llm.language_id import HashArray

DRAWS, LEVELS = 16, 12
SUBSETS = DRAWS * LEVELS
PLACES = 32
#: The fingerprint of a text without words.
NOTHING = 1
LEAST, MOST = 0.0005, 0.02
PART_BYTES = 16 << 20
#: A row's range is looked up in a list of this many bounds at most.
PARTS = 4096
_SEEDS = mix(np.arange(1, DRAWS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their distinct terms (rising within a row), and the row of each."""
    for p in pieces(pc.utf8_lower(column), bare=True):
        row = p.row_of_word
        order = np.lexsort((p.hashes, row))
        h, row = p.hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield p.lo, p.hi, h[new], row[new]


def _count(batches: Iterator[pa.RecordBatch]):
    held: list[np.ndarray] = []

    def counted():
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    size = 0
    for batch in batches:
        for _, _, h, _ in _terms(batch.column("_text")):
            held.append(h)
            size += len(h)
            if size > 8_000_000:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def lexicon(docs: DataFrame, *, text_col: str = "text", least: float = LEAST, most: float = MOST) -> HashArray:
    """Hashes of the terms that at least and at most these shares of all documents have."""
    ship(docs.sparkSession)
    n = docs.count()
    terms = (
        docs.select(F.col(text_col).alias("_text"))
        .mapInArrow(_count, "term long, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= least * n) & (F.col("n") <= max(1.0, most * n)))
        .select("term")
        .toArrow()
    )
    keys = terms.column("term").to_numpy().view(U64)
    return HashArray(keys, np.zeros(len(keys), np.int8))


def fingerprints(column: pa.Array, words: HashArray) -> np.ndarray:
    """A row of SUBSETS hashes for each text, 0 where it has no term of the sub-lexicon; NOTHING for one without words."""
    out = np.zeros((len(column), SUBSETS), np.uint16)
    for lo, hi, h, row in _terms(column):
        out[lo:hi][np.bincount(row, minlength=hi - lo) == 0] = NOTHING
        known = words.find(h) >= 0
        h, row = h[known], row[known]
        for s in range(DRAWS):
            drawn = mix(h ^ _SEEDS[s])
            for halvings in range(LEVELS):
                # Terms of a text come sorted by hash, so a sum with their places is a hash of the sorted sequence.
                inside = drawn >> U64(64 - halvings) == 0 if halvings else np.ones(len(h), bool)
                of, term = row[inside], drawn[inside]
                if not len(of):
                    break
                begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                place = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
                total = mix(np.add.reduceat(mix(term + place.astype(U64)), begins))
                at = (LEVELS - 1 - halvings) * DRAWS + s
                out[lo + of[begins], at] = np.maximum((total >> U64(48)).astype(np.uint16), 2)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the first PLACES that either fills, by row."""
    filled = (a != 0) | (b != 0)
    filled &= np.cumsum(filled, 1) <= PLACES
    return (filled & (a == b)).sum(1) / np.maximum(filled.sum(1), 1)


def _hex(prints: np.ndarray) -> pa.Array:
    text = prints.astype(">u2").tobytes().hex()
    return pa.array([text[i : i + 4 * SUBSETS] for i in range(0, len(text), 4 * SUBSETS)], pa.string())


def in_ring(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, _tail by rising id: within a partition each row is followed by the next of its part.

    Parts are ranges of ids. A part ends with a row that is a copy (_tail) of the next part's first row;
    the last part's is a copy of the first row of all. Only the first keys of parts come to the driver.
    """
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.select(k1, k2, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    n = min(PARTS, text_bytes(docs, text_col) // PART_BYTES + 1)
    cuts = keyed.select(F.col("_k1").cast("double").alias("k")).approxQuantile(
        "k", [i / n for i in range(1, n)], 1 / (4 * n)
    ) if n > 1 else []
    bounds = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>")
    keyed = keyed.withColumn("_part", F.size(F.filter(bounds, lambda b: b <= F.col("_k1").cast("double"))))
    firsts = sorted(
        keyed.groupBy("_part").agg(F.min(F.struct("_k1", "_k2")).alias("k")).collect(), key=lambda r: r["_part"]
    )
    follow = [(r["k"]["_k1"], r["k"]["_k2"], firsts[i - 1]["_part"]) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(follow, "_k1 long, _k2 long, _to int")
    tails = (
        keyed.join(F.broadcast(heads), ["_k1", "_k2"])
        .dropDuplicates(["_to"])
        .select("_k1", "_k2", "_id", "_text", F.col("_to").alias("_part"), F.lit(True).alias("_tail"))
    )
    return (
        keyed.withColumn("_tail", F.lit(False))
        .unionByName(tails)
        .repartition(n, "_part")
        .sortWithinPartitions("_part", "_tail", "_k1", "_k2")
        .select("_id", "_text", "_tail")
    )


def _with_next(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        words = shared.value
        # The last row of a batch waits for the first of the next.
        ids, texts, tails = [], [], []
        prints = np.zeros((0, SUBSETS), np.uint16)
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("_id").type
            column = batch.column("_text").fill_null("")
            ids = ids[-1:] + batch.column("_id").to_pylist()
            texts = texts[-1:] + column.to_pylist()
            tails = tails[-1:] + batch.column("_tail").to_pylist()
            prints = np.concatenate([prints[-1:], fingerprints(column, words)])
            at = [i for i in range(len(ids) - 1) if not tails[i]]
            if not at:
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
            after = fingerprints(pa.array(edited, pa.string()), words)
            own, following = prints[at], prints[[i + 1 for i in at]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in at], kind),
                    pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    _hex(own),
                    _hex(after),
                    pa.array(likeness(own, after)),
                    pa.array(likeness(own, following)),
                ],
                names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def _only(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), _hex(fingerprints(batch.column("_text"), shared.value))],
                names=["_id", "fingerprint"],
            )

    return run


def fingerprint(docs: DataFrame, words: HashArray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (SUBSETS groups of four hex digits) of every row.

    Texts without words, null ones too, share a fingerprint of their own; one without a term of the lexicon is
    all zeros and like no other. Rows do not depend on each other: equal texts have equal
    fingerprints, and repeated rows and null ids need no rule. Other columns are not read.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(words)
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .mapInArrow(_only(shared), f"_id {dict(docs.dtypes)[id_col]}, fingerprint string")
        .withColumnRenamed("_id", id_col)
    )


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and likenesses.

    An edited text has its last half (rounded down) replaced by as much of the beginning of the next text by
    id, then text hash; the first follows the last. id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. One row per input row; null texts are empty, null ids come
    first. A single row is followed by itself; an empty table gives no rows.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(lexicon(docs, text_col=text_col))
    return (
        in_ring(docs, id_col=id_col, text_col=text_col)
        .mapInArrow(
            _with_next(shared),
            f"_id {dict(docs.dtypes)[id_col]}, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
        .withColumnRenamed("_id", id_col)
    )
