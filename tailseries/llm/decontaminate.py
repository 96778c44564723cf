"""Benchmark decontamination: BM25 over test items with block-max bounds, then overlap of both parts.

Test items are the index, training passages the queries: passages are twice the longest item long and
overlap by half, so that every item fits whole into some passage. A term's weight in an item is divided by the item's threshold
(``share`` of the score that the item's own text has), so that a pair is retrieved at 1. Items lie in
blocks of BLOCK_ITEMS; the largest weight of each term in a block bounds what a passage can score
there, and only blocks whose bounds reach 1 are scored item by item. What is retrieved is confirmed:
``overlap`` of the word shingles of the item's question, and of its answer, must occur in the passage.

An index holds at most ITEMS items, so what is broadcast is bounded; more items take more passes. Document
frequencies, mean and longest length are of all items, so scores and passages do not depend on that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tailseries.llm.common import U64, Rolling, mix, pieces, scratch, ship

BLOCK_ITEMS = 8
ITEMS = 1024
SHORTEST = 64
SHINGLE = 3
K1, B = 1.2, 0.75
_WORDS = Rolling(0xB492B66FBE98F273)


def _hashes(text: str) -> np.ndarray:
    return next(pieces(pc.utf8_lower(pa.array([text or ""])), bare=True)).hashes


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, or of all of fewer."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, U64)
    prefix = _WORDS.prefix(mix(words))
    at = np.arange(len(words) - n + 1)
    return np.unique(_WORDS.ranges(prefix, at, at + n))


@dataclass
class Block:
    """Items first to first + width - 1: their terms, rising, and a row of weights for each."""

    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Statistics:
    """Of all items with words: how many, their mean and longest length, and in how many of them terms occur."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Statistics:
        lengths = [len(w) for w in words] or [0]
        terms, df = np.unique(np.concatenate([np.zeros(0, U64), *map(np.unique, words)]), return_counts=True)
        return cls(len(words), float(np.mean(lengths)), max(lengths), terms, df)


class Index:
    """BM25 weights of up to ITEMS items, by the statistics of all; items without words are left out."""

    def __init__(self, items: list[tuple[object, str, str]], share: float, of_all: Statistics | None = None):
        parts = [(i, _hashes(q), _hashes(a)) for i, q, a in items]
        parts = [p for p in parts if len(p[1]) + len(p[2])]
        self.ids = [p[0] for p in parts]
        self.questions, self.answers = (
            [(min(SHINGLE, len(p[k])), _shingles(p[k], SHINGLE)) for p in parts] for k in (1, 2)
        )
        words = [np.concatenate(p[1:]) for p in parts]
        lengths = np.array([len(w) for w in words])
        of_all = of_all or Statistics.of(words)
        self.stride = max(SHORTEST, of_all.longest)
        self.terms = np.unique(np.concatenate(words)) if words else np.zeros(0, U64)
        # Weighted one by one, then cut into blocks.
        counted = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for w in words]
        df = of_all.df[np.searchsorted(of_all.terms, self.terms)]
        idf = np.log1p((of_all.items - df + 0.5) / (df + 0.5))
        self.blocks: list[Block] = []
        self.threshold = np.zeros(len(words))
        self.bounds = np.zeros((len(self.terms), -(-len(words) // BLOCK_ITEMS)), np.float32)
        for lo in range(0, len(words), BLOCK_ITEMS):
            mine = counted[lo : lo + BLOCK_ITEMS]
            terms = np.unique(np.concatenate([t for t, _ in mine]))
            weights = np.zeros((len(terms), len(mine)), np.float32)
            for k, (t, tf) in enumerate(mine):
                norm = K1 * (1 - B + B * lengths[lo + k] / of_all.mean)
                w = idf[t] * tf * (K1 + 1) / (tf + norm)
                self.threshold[lo + k] = share * w.sum()
                weights[np.searchsorted(terms, t), k] = w / self.threshold[lo + k]
            self.blocks.append(Block(terms, weights))
            self.bounds[terms, len(self.blocks) - 1] = weights.max(axis=1)

    def matches(self, column: pa.Array, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(row, item number, score, question overlap, answer overlap) of the best passage of each pair."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(self.terms):
            return []
        for p in pieces(pc.utf8_lower(column), bare=True):
            if not len(p.hashes):
                continue
            term = np.minimum(np.searchsorted(self.terms, p.hashes), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[term] == p.hashes)
            if not len(known):
                continue
            # Passage j of a row holds its words from j * stride to (j + 2) * stride; the last may be shorter.
            row = p.row_of_word
            count = np.maximum(1, -(-np.diff(p.first) // self.stride) - 1)
            first_passage = np.cumsum(np.concatenate([[0], count]))
            step = (known - p.first[row[known]]) // self.stride
            at, top = first_passage[row[known]] + step, first_passage[row[known] + 1]
            passage = np.concatenate([at[at < top], at[step > 0] - 1])
            pair = passage * len(self.terms) + np.concatenate([term[known][at < top], term[known][step > 0]])
            pair.sort()
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
            of_passage, of_term = pair // len(self.terms), pair % len(self.terms)
            begins = np.flatnonzero(np.concatenate([[True], of_passage[1:] != of_passage[:-1]]))
            passages, sizes = of_passage[begins], np.diff(np.append(begins, len(pair)))
            bound = np.add.reduceat(self.bounds[of_term], begins, axis=0)
            for b, block in enumerate(self.blocks):
                open_ = np.flatnonzero(bound[:, b] >= 1 - 1e-4)
                if not len(open_):
                    continue
                n = sizes[open_]
                ends = np.cumsum(n)
                terms = of_term[np.arange(ends[-1]) + np.repeat(begins[open_] - (ends - n), n)]
                where = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
                weights = np.where((block.terms[where] == terms)[:, None], block.weights[where], np.float32(0))
                scores = np.add.reduceat(weights, ends - n, axis=0, dtype=np.float64)
                for o, k in np.argwhere(scores >= 1 - 1e-6):
                    number, item = passages[open_[o]], b * BLOCK_ITEMS + int(k)
                    r = int(np.searchsorted(first_passage, number, "right")) - 1
                    start = p.first[r] + (number - first_passage[r]) * self.stride
                    words = p.hashes[start : min(start + 2 * self.stride, p.first[r + 1])]
                    q, a = self._contained(self.questions[item], words), self._contained(self.answers[item], words)
                    if min(q, a) >= overlap:
                        key = (p.lo + r, item)
                        score = float(scores[o, k] * self.threshold[item])
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
        return [(*k, *v) for k, v in sorted(best.items())]

    @staticmethod
    def _contained(part: tuple[int, np.ndarray], words: np.ndarray) -> float:
        """Share of a part's shingles among these words; a part without words is contained."""
        n, wanted = part
        return float(np.isin(wanted, _shingles(words, n)).mean()) if n else 1.0


def parts(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that is one text: its last quarter of words, two at least, answers."""
    words = (text or "").split()
    cut = len(words) - max(2, len(words) // 4)
    return (" ".join(words[:cut]), " ".join(words[cut:])) if cut > 0 else (" ".join(words), "")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of every item, and as term null its length."""
    for batch in batches:
        terms, lengths = [], []
        for q, a in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist()):
            words = np.concatenate([_hashes(q), _hashes(a)])
            if len(words):
                found = np.unique(words).view(np.int64).tolist()
                terms += [None, *found]
                lengths += [len(words), *[None] * len(found)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(lengths, pa.int64())], names=["term", "length"])


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = [parts(t) for t in batch.column("q").to_pylist()]
        columns = [batch.column("i"), *(pa.array([c[k] for c in cut], pa.string()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "q", "a"])


def indexes(
    benchmark: DataFrame, *, item_col: str, text_col: str, question_col: str | None, answer_col: str | None, share: float
) -> Iterator[Index]:
    """Indexes of up to ITEMS items each; items, and the frequencies of their terms, come to the driver one index at a time."""
    item = F.col(item_col).alias("i")
    if question_col and answer_col:
        chosen = benchmark.select(item, F.coalesce(question_col, F.lit("")).alias("q"), F.coalesce(answer_col, F.lit("")).alias("a"))
    else:
        kind = benchmark.schema[item_col].dataType.simpleString()
        chosen = benchmark.select(item, F.col(text_col).alias("q")).mapInArrow(_split_items, f"i {kind}, q string, a string")
    counted = (
        chosen.select("q", "a")
        .mapInArrow(_item_terms, "term long, length long")
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.max("length").alias("longest"))
    )
    counted = scratch(counted, "item_terms")
    whole = counted.where("term IS NULL").first()
    if whole is None:
        return

    def index(held: list[tuple[object, str, str]]) -> Index:
        terms = np.unique(np.concatenate([_hashes(t) for _, q, a in held for t in (q, a)]))
        wanted = benchmark.sparkSession.createDataFrame(pa.table({"term": terms.view(np.int64)}), "term long")
        # Not more rows than an index has terms.
        df = counted.join(wanted, "term", "left_semi").select("term", "n").toArrow()
        at = np.argsort(df.column("term").to_numpy().view(U64))
        found = df.column("term").to_numpy().view(U64)[at], df.column("n").to_numpy()[at]
        return Index(held, share, Statistics(whole.n, whole.words / whole.n, whole.longest, *found))

    held: list[tuple[object, str, str]] = []
    for r in chosen.toLocalIterator():
        held.append((r.i, r.q, r.a))
        if len(held) == ITEMS:
            yield index(held)
            held = []
    if held:
        yield index(held)


def _pairs(shared, overlap: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]):
        index = shared.value
        for batch in batches:
            found = index.matches(batch.column("_text"), overlap)
            columns = list(zip(*found)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(columns[0], pa.int64())),
                    pa.array([index.ids[i] for i in columns[1]], item_type),
                    *(pa.array(c, pa.float64()) for c in columns[2:]),
                ],
                names=["_id", "_item", "bm25", "question_overlap", "answer_overlap"],
            )

    return run


def _clean(shared, overlap: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[m[0] for m in shared.value.matches(batch.column(text), overlap)]] = False
            yield batch.filter(pa.array(keep))

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    question_col: str | None = None,
    answer_col: str | None = None,
    share: float = 0.5,
    overlap: float = 0.5,
) -> DataFrame:
    """Every pair of a document and a test item that one of its passages holds.

    doc id, item id, bm25, question_overlap, answer_overlap (of the best passage). Words are letters and
    digits, lower-cased. Null and empty texts and items match nothing; each row is searched on its own, so
    repeated rows give repeated pairs and null ids stay null; an empty table gives no pairs. Without
    question and answer columns an item's last quarter of words is its answer.
    """
    spark = ship(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], benchmark.schema[item_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    schema = (
        f"_id {kind}, _item {item_kind.simpleString()}, bm25 double, question_overlap double, answer_overlap double"
    )
    for index in indexes(
        benchmark, item_col=item_col, text_col=item_text_col, question_col=question_col, answer_col=answer_col, share=share
    ):
        found = texts.mapInArrow(_pairs(spark.sparkContext.broadcast(index), overlap, to_arrow_type(item_kind)), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = 0.5,
    overlap: float = 0.5,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no passage holds a test item (see contaminated)."""
    spark = ship(docs.sparkSession)
    for index in indexes(
        benchmark, item_col=item_col, text_col=item_text_col, question_col=None, answer_col=None, share=share
    ):
        shared = spark.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_clean(shared, overlap, docs.columns.index(text_col)), docs.schema)
    return docs
