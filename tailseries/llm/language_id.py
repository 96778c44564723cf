"""Language identification with interpolated Kneser-Ney models over characters.

Texts are lower-cased; whatever is not a letter becomes one space. Each language has a model of order
ORDER, fitted on a bounded sample: at most ``sample_docs`` labelled documents of at most
``sample_chars`` code points per language, the smallest by a hash of id and text. The tables of all
languages are merged: for each order one sorted array of hashed n-grams and next to it one log
probability per language, so one look-up serves all languages, and only n-grams that no language
has seen back off. A text gets the language with the lowest cross-entropy per character, and is
rejected when even that lies far above what held-back sample documents of the language have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window as W, functions as F

from tailseries.llm.common import U64, mix, row_groups, ship

ORDER = 5
BITS = 12
#: Code points from here on share 1024 symbols.
FOLD = (1 << BITS) - 1024
SPACE = 32
UNKNOWN = "und"
#: Documents hold quotations, keys and foreign words: no language is taken for more even than this (nats).
LEAST_SPREAD = 0.125


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each text after ORDER - 1 spaces, and the number of symbols of each without those."""
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lowered)), lengths)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    points, row = points[keep], row[keep]
    folded = FOLD + (mix(points.astype(U64)) & U64(1023)).astype(np.uint32)
    codes = np.where(letter[keep], np.where(points < FOLD, points, folded), SPACE)
    out = np.full(len(codes) + (ORDER - 1) * len(lowered), SPACE, U64)
    out[np.arange(len(codes)) + (ORDER - 1) * (row + 1)] = codes
    return out, np.bincount(row, minlength=len(lowered))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each symbol, texts one after the other, and how many each text has."""
    s, n = symbols(texts)
    g = np.zeros(max(0, len(s) - ORDER + 1), U64)
    for k in range(ORDER):
        g = (g << U64(BITS)) | s[k : k + len(g)]
    starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return g[at], n


class HashArray:
    """Sorted hashed keys with rows of values; a table of 2**b starts leads into them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = mix(keys)
        order = np.argsort(hashed)
        self.keys, self.values = hashed[order], values[order]
        self.shift = 64 - max(1, (2 * len(keys)).bit_length())
        self.starts = np.searchsorted(self.keys >> U64(self.shift), np.arange((1 << (64 - self.shift)) + 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        hashed = mix(keys)
        slot = (hashed >> U64(self.shift)).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            a = at[open_]
            hit = self.keys[a] == hashed[open_]
            out[open_[hit]] = a[hit]
            at[open_] += 1
            open_ = open_[~hit & (a + 1 < end[open_])]
        return out


class Model:
    """Merged Kneser-Ney tables: ``full[n]`` log p of n-grams, ``rest[n]`` log weight of backing off from contexts."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.full: dict[int, HashArray] = {}
        self.rest: dict[int, HashArray] = {}
        per_language = [self._tables(g, c) for g, c in counts]
        # One alphabet for all: a language's own would leave more than 1 for the symbols of the others.
        self.floor = float(-np.log(len(np.unique(np.concatenate([t[1][0] for t in per_language]))) + 1))
        for n in range(1, ORDER + 1):
            contexts = np.unique(np.concatenate([t[n][2] for t in per_language]))
            rest = np.zeros((len(contexts), len(languages)))
            for k, t in enumerate(per_language):
                rest[np.searchsorted(contexts, t[n][2]), k] = t[n][3]
            self.rest[n] = HashArray(contexts, rest.astype(np.float32))
            keys = np.unique(np.concatenate([t[n][0] for t in per_language]))
            below = self._log_p(keys & U64((1 << BITS * (n - 1)) - 1), n - 1) if n > 1 else self.floor
            back = np.exp(below + self._rest(keys, n))
            for k, t in enumerate(per_language):
                back[np.searchsorted(keys, t[n][0]), k] += t[n][1]
            self.full[n] = HashArray(keys, np.log(back).astype(np.float32))
        self.mean = np.zeros(len(languages))
        self.spread = np.ones(len(languages))
        self.spread_symbol = np.ones(len(languages))

    @staticmethod
    def _tables(gram: np.ndarray, count: np.ndarray) -> dict[int, tuple]:
        """For each order: n-grams, their discounted probability, contexts and log backing-off weights."""
        out = {}
        for n in range(ORDER, 0, -1):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, where = np.unique(gram >> U64(BITS), return_inverse=True)
            total = np.bincount(where, weights=count)
            kinds = np.bincount(where)
            out[n] = gram, (count - discount) / total[where], contexts, np.log(discount * kinds / total)
            # Below, a count is the number of different symbols before the n-gram.
            gram, count = np.unique(gram & U64((1 << BITS * (n - 1)) - 1), return_counts=True)
        return out

    def _rest(self, keys: np.ndarray, n: int) -> np.ndarray:
        at = self.rest[n].find(keys >> U64(BITS))
        return np.where(at[:, None] >= 0, self.rest[n].values[at], np.float32(0))

    def _log_p(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log probability in every language of the last symbol of packed n-grams after the others."""
        at = self.full[n].find(keys)
        out = self.full[n].values[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            some = keys[missing]
            below = self._log_p(some & U64((1 << BITS * (n - 1)) - 1), n - 1) if n > 1 else self.floor
            out[missing] = below + self._rest(some, n)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, and the number of symbols (0: no letter)."""
        g, n = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(self._log_p(g, ORDER), (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n

    def calibrate(self, texts: list[str], labels: list[str]) -> None:
        """From held-back documents: how high a language's own cross-entropy lies, and how widely."""
        h, n = self.entropies(texts)
        own = np.array([self.languages.index(x) if x in self.languages else -1 for x in labels], int)
        for k in range(len(self.languages)):
            mine = (own == k) & (n >= 100)
            if mine.sum() >= 5:
                self.mean[k], self.spread[k] = np.median(h[mine, k]), max(h[mine, k].std(), LEAST_SPREAD)
            else:
                self.mean[k], self.spread[k] = 2.0, 0.5
        self.spread_symbol[:] = 2.0

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, rejected, cross-entropy."""
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        # Symbols of a text depend on each other: its evidence grows with the root of its length.
        z = (h - low[:, None]) * (3 * np.sqrt(n))[:, None]
        score = 1 / np.exp(-np.minimum(z, 500)).sum(axis=1)
        most = self.mean[best] + 8 * (self.spread[best] + self.spread_symbol[best] / np.sqrt(np.maximum(n, 1)) / 2)
        return best, np.where(n > 0, score, 0.0), (n == 0) | (low > most), low


def _count(batches: Iterator[pa.RecordBatch]):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        texts = np.array(batch.column("_text").to_pylist(), object)
        langs = np.array(batch.column("_lang").to_pylist(), object)
        for lang in set(langs):
            held.setdefault(lang, []).append(np.unique(grams(list(texts[langs == lang]))[0], return_counts=True))
    for lang, parts in held.items():
        g, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
        )


def fit(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 800,
    sample_chars: int = 50_000,
) -> Model | None:
    """A model of the languages of labelled documents; None if there are none with text and label.

    A ninth of each language's sample is held back for calibration. The tables come to the driver: they
    are bounded by the sample. With fewer than five held-back documents of 100 symbols of a language,
    nothing is known of how its entropies spread, and only texts far from every language are rejected.
    """
    spark = ship(labelled.sparkSession)
    usable = labelled.select(
        F.col(text_col).alias("_text"),
        F.col(lang_col).alias("_lang"),
        F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)).alias("_order"),
    ).where(F.col("_lang").isNotNull() & (F.length("_text") <= sample_chars) & F.col("_text").rlike(r"\p{L}"))
    rank = F.row_number().over(W.partitionBy("_lang").orderBy("_order", "_text"))
    sample = usable.withColumn("_rank", rank).where(F.col("_rank") <= sample_docs).cache()
    try:
        held_back = (F.col("_rank") % 9 == 0) & (F.col("_rank") > 9)
        counts = (
            sample.where(~held_back)
            .select("_text", "_lang")
            .repartition(max(4, spark.sparkContext.defaultParallelism))
            .mapInArrow(_count, "lang string, gram long, n long")
            .groupBy("lang", "gram")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )
        check = sample.where(held_back).select("_text", "_lang").toArrow().to_pydict()
    finally:
        sample.unpersist()
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(coded.dictionary.to_pylist())
    if not languages:
        return None
    lang = coded.indices.to_numpy()
    gram = counts.column("gram").to_numpy().view(U64)
    n = counts.column("n").to_numpy()
    tables = []
    for name in languages:
        mine = np.flatnonzero(lang == coded.dictionary.index(pa.scalar(name)).as_py())
        mine = mine[np.argsort(gram[mine])]
        tables.append((gram[mine], n[mine]))
    del counts, coded, lang, gram, n
    model = Model(languages, tables)
    model.calibrate(check["_text"], check["_lang"])
    return model


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        names = np.array([*(model.languages if model else []), UNKNOWN], object)
        for batch in batches:
            column = batch.column("_text")
            offsets = np.concatenate([[0], np.cumsum(pa.compute.binary_length(column).fill_null(0).to_numpy())])
            for lo, hi in row_groups(offsets):
                texts = column.slice(lo, hi - lo).to_pylist()
                if model:
                    best, score, rejected, low = model.predict(texts)
                    n = symbols(texts)[1] if rejected.any() else np.ones(len(texts))
                    best = np.where(n > 0, best, len(names) - 1)
                else:
                    best = np.zeros(len(texts), int)
                    score, rejected, low = np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(lo, hi - lo),
                        batch.column("_row").slice(lo, hi - lo),
                        pa.array(names[best], pa.string()),
                        pa.array(score.astype(np.float64)),
                        pa.array(rejected),
                        pa.array(low.astype(np.float64)),
                    ],
                    names=["_id", "_row", "lang_pred", "score", "rejected", "cross_entropy"],
                )

    return run


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Label every whole text: id, lang_pred, score, rejected, cross_entropy, and _row with all columns.

    One row per input row; every row is labelled on its own, so repeated rows, ties of ids and null ids
    need no rule. A text that is null or has no letter is ``und``, score 0, rejected. Equally likely
    languages go to the first by code point. Without a model (nothing to learn from) every text is
    ``und``. The table's columns are carried along as the struct _row, whatever their names.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kinds = dict(docs.dtypes)
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row.alias("_row"))
        .mapInArrow(
            _label(shared),
            f"_id {kinds[id_col]}, _row {docs.select(row.alias('r')).schema['r'].dataType.simpleString()}, "
            "lang_pred string, score double, rejected boolean, cross_entropy double",
        )
        .withColumnRenamed("_id", id_col)
    )


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; documents of fold 2 are not learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
