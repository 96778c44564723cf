"""Spelling variants: words one edit apart, found over a reduced alphabet and verified on the words themselves.

Letters are dealt to a few symbols of about equal use, so that a one-edit neighbourhood is small. From every
reduced word its one-edit neighbours are generated and joined to the reduced vocabulary; each unordered pair is
generated once, from the longer word by a deletion or from the smaller symbol by a replacement, and a reduced
word is its own neighbour for letters that share a symbol. Two words one edit apart are one edit apart or equal
when reduced, so none is lost; what the join finds is checked on the original words.

Neighbours are 64-bit keys from prefix sums of symbol values, so a word of a million letters costs a million keys
and no copies of itself. Keys that collide only cost a check.

The alphabet grows with the vocabulary: the first size of SYMBOLS is taken at which the words that share a reduced
word are few (sum of squared group sizes at most CROWD times the number of words). The last size keeps
all letters below U+0100 apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tailseries.llm.common import U64, mix, scratch, ship

SYMBOLS = (6, 10, 16, 32, 256)
CROWD = 4
#: Code points handled at a time; a longer word is handled alone.
SLICE = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = U64(pow(_BASE, -1, 1 << 64))
_LENGTH = U64(0xD1342543DE82EF95)


def damaged_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31
) -> DataFrame:
    """Runs of letters of at least ``least`` code points with a seeded slip of the pen in one of ``every``: column word.

    A run is maximal in ``[A-Za-z\\u00C0-\\u00FF]`` and A to Z are lower-cased. Where ``every`` divides the crc32 of
    ``<id>:<run>``, the code point at crc32 modulo length goes. A null text has no runs, a null id is written
    as nothing; repeated rows count again. Other columns are not read.
    """
    run = F.explode(F.regexp_extract_all(text_col, F.lit(f"[A-Za-z\u00C0-\u00FF]{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), run.alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("i", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(
        F.col("h") % every == 0,
        F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))),
    ).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(runs: DataFrame, *, least_count: int = 2) -> DataFrame:
    """Distinct words with their number of occurrences n, at least ``least_count``; nulls are left out."""
    counted = runs.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def deal_letters(letters: list[tuple[str, int]], symbols: int) -> np.ndarray:
    """Symbol of every code point below 256: the most used letters first, each to the least used symbol."""
    table = (mix(np.arange(256, dtype=U64)) % U64(symbols)).astype(np.int64)
    load = [0] * symbols
    for letter, uses in sorted(letters, key=lambda x: (-x[1], x[0])):
        if ord(letter) < 256:
            s = min(range(symbols), key=lambda k: (load[k], k))
            table[ord(letter)] = s
            load[s] += uses
    return table


class Reduction:
    """Keys of reduced words and of their one-edit neighbours."""

    def __init__(self, table: np.ndarray, symbols: int):
        self.table, self.symbols = table, symbols
        self.values = mix(np.arange(1, symbols + 1, dtype=U64) * _LENGTH)
        self.up = np.ones(1, U64)

    def _slices(self, words: list[str]) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < len(words):
            hi, size = lo + 1, len(words[lo])
            while hi < len(words) and size + len(words[hi]) <= SLICE:
                size += len(words[hi])
                hi += 1
            yield lo, hi
            lo = hi

    def _sums(self, words: list[str]):
        """Symbols, place in the word, row, sum before each place, weight of each place, and per row length and sum."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        far = (mix(points.astype(U64)) % U64(self.symbols)).astype(np.int64)
        digit = np.where(points < 256, self.table[np.minimum(points, 255)], far)
        row = np.repeat(np.arange(len(words)), n)
        first = np.cumsum(n) - n
        place = np.arange(len(digit)) - first[row]
        if len(self.up) < (n.max() if len(n) else 0) + 1:
            steps = np.full(int(n.max()) + 2, U64(_BASE), U64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
        weight = self.up[place]
        running = np.zeros(len(digit) + 1, U64)
        np.cumsum(self.values[digit] * weight, out=running[1:])
        total = running[first + n] - running[first]
        return digit, place, row, running[:-1] - running[first][row], weight, n, total

    def _key(self, total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(total + length.astype(U64) * _LENGTH).view(np.int64)

    def keys(self, words: list[str]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for lo, hi in self._slices(words):
            *_, n, total = self._sums(words[lo:hi])
            out.append(self._key(total, n))
        return np.concatenate(out)

    def neighbours(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of generated neighbours, and the word's own key with each: the word, deletions, greater symbols."""
        for lo, hi in self._slices(words):
            digit, place, row, before, weight, n, total = self._sums(words[lo:hi])
            own = self._key(total, n)
            yield own, own
            # Deleting any of several equal symbols in a row gives the same word.
            new = np.ones(len(digit), bool)
            new[1:] = (digit[1:] != digit[:-1]) | (row[1:] != row[:-1])
            r = row[new]
            after = total[r] - before[new] - self.values[digit[new]] * weight[new]
            yield self._key(before[new] + after * _INVERSE, n[r] - 1), own[r]
            for s in range(1, self.symbols):
                low = np.flatnonzero(digit < s)
                r = row[low]
                changed = total[r] + (self.values[s] - self.values[digit[low]]) * weight[low]
                yield self._key(changed, n[r]), own[r]


def _reduced(words: DataFrame, reduction: Reduction) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(reduction.keys(b.column(0).to_pylist()))], ["word", "n", "key"]
            )

    return words.select("word", "n").mapInArrow(each, "word string, n long, key long")


def _generated(words: DataFrame, reduction: Reduction) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, own in reduction.neighbours(b.column(0).to_pylist()):
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], ["key", "own"])

    return words.select("word").mapInArrow(each, "key long, own long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Unordered pairs of distinct words one insertion, deletion or replacement of a code point apart.

    ``words`` has unique ``word`` (not null) and ``n``. Columns a, n_a, b, n_b; each pair once.
    """
    ship(words.sparkSession)
    size = words.count()
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where(F.ascii("c") > 0)
    letters = [tuple(r) for r in letters.where(F.ascii("c") < 256).groupBy("c").count().collect()]
    for symbols in SYMBOLS:
        reduction = Reduction(deal_letters(letters, symbols), symbols)
        keyed = scratch(_reduced(words, reduction), "spelling-keys")
        crowd = keyed.groupBy("key").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
        if (crowd or 0) <= CROWD * size:
            break
    # One word stands for each reduced word; reduced words whose keys collide still generate each their own.
    known = "".join(c for c, _ in letters)
    reduced = F.translate("word", known, "".join(chr(0xE000 + int(reduction.table[ord(c)])) for c in known))
    heads = keyed.groupBy("key", reduced.alias("reduced")).agg(F.min("word").alias("word"))
    met = _generated(heads, reduction).join(keyed.select("key").distinct(), "key")
    a = keyed.select(F.col("key").alias("own"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    checked = (
        met.join(b, "key")
        .join(a, "own")
        .where((F.col("own") != F.col("key")) | (F.col("a") < F.col("b")))
        .where(F.levenshtein("a", "b", 1) == 1)
    )
    ordered = F.when(F.col("a") < F.col("b"), F.struct("a", "n_a", "b", "n_b")).otherwise(
        F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    )
    return checked.select(ordered.alias("p")).select("p.*").dropDuplicates(["a", "b"])


def _at_least(times: int) -> Column:
    return -F.col("best._1") >= F.col("n") * times


def spelling_variants(words: DataFrame, *, times: int = 10) -> DataFrame:
    """Every word with its form: the near word of largest n (ties: smallest by code points) if n is ``times`` its own.

    ``words``: columns word and n, one row a word; null words are left out and other columns not read. Returns word, form
    (null if none), root (the last word when forms are followed; the word itself if none), n, n_near, form_n.
    An empty table gives an empty table. Forms grow ``times``-fold, so chains are short and have no cycles.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    words = scratch(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long")), "spelling-words")
    pairs = near_pairs(words)
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("_1"), F.col("b").alias("_2")).alias("o")),
            F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("_1"), F.col("a").alias("_2")).alias("o")),
        )
    )
    met = pairs.select(both.alias("e")).select("e.word", "e.o").groupBy("word")
    met = met.agg(F.count("*").alias("n_near"), F.min("o").alias("best"))
    named = scratch(
        words.join(met, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(_at_least(times), F.col("best._2")).alias("form"),
            F.when(_at_least(times), -F.col("best._1")).alias("form_n"),
        ),
        "spelling-forms",
    )
    root = named.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    largest = named.agg(F.max("n")).first()[0] or 1
    hops = max(1.0, log10(max(largest, 2)) / log10(times))
    for _ in range(ceil(log2(hops)) if hops > 1 else 0):
        onward = root.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        root = scratch(
            root.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "spelling-roots"
        )
    return named.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
