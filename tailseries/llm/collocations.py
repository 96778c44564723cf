"""Phrase collocations by prefix-free parsing.

Texts are split into pieces at punctuation and pieces into words. A piece is parsed into chunks at content triggers:
a chunk starts at the piece's first word and wherever the hash of two words in a row is divisible by ``PERIOD``, and
reaches OVERLAP words into the next one. Equal passages thus give equal chunks wherever they lie, and the parse of the
corpus shrinks to a dictionary of distinct chunks with frequencies.

N-grams of up to OVERLAP + 1 words are counted inside the distinct chunks, each with the chunk's frequency. Those that
start in the overlap belong to the next chunk, so each occurrence counts once. Words are numbered inside a slice, so
equal n-grams of a slice are added up without comparing texts or hashes; Spark adds up the slices.

Lengths are counted one after the other. An n-gram can only be frequent if both its parts of n - 1 words are, so what
a bit filter over the frequent ones excludes is not counted. The filter never excludes a frequent part. It has at most
FILTER bits (32 MB are broadcast); beyond some 50 million frequent n-grams it lets more and more pass, and the shuffle
grows towards that of all n-grams, which is in proportion to the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tailseries.llm.common import U64, hash_spans, mix, row_groups, scratch, ship, text_buffers
from tailseries.operators.skew import spread_join

LONGEST, OVERLAP, PERIOD = 3, 2, 8
#: Bytes of chunks counted together.
SLICE = 1 << 23
#: Bits of the filter over frequent n-grams at most.
FILTER = 1 << 28
#: Groups into which a language's phrases are dealt before its best ones are found.
DEALT = 256
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = _BREAK.copy()
_BLANK[[9, 32]] = True


def spans_as_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans, which may overlap, as an array of texts."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    kind = np.int32 if len(data) + offsets[-1] < 1 << 31 else np.int64
    at = np.arange(offsets[-1], dtype=kind)
    at += np.repeat((starts - offsets[:-1]).astype(kind), sizes)
    return pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])]
    ).cast(pa.string())


def _words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows one after the other, each followed by one space: bytes, starts and ends in them, piece numbers."""
    ends = rows[1:] - rows[0] + np.arange(1, len(rows))
    padded = np.empty(int(rows[-1] - rows[0]) + len(ends), np.uint8)
    text = np.ones(len(padded), bool)
    text[ends - 1] = False
    padded[ends - 1] = 10
    padded[text] = _LOWER[data[rows[0] : rows[-1]]]
    word = ~_BLANK[padded]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    closes = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    begins = np.flatnonzero(begins)
    piece = np.cumsum(_BREAK[padded])[begins]
    row = np.searchsorted(ends, begins, "right")
    keep = word
    keep[closes] = True
    padded[closes] = 32
    sizes = closes - begins
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    return padded[keep], starts, starts + sizes, piece, row


def parse(data: np.ndarray, rows: np.ndarray, period: int = PERIOD):
    """Chunks of rows: text bytes, starts, ends, whether each ends its piece, and its row."""
    text, starts, ends, piece, row = _words(data, rows)
    n = len(starts)
    if not n:
        return text, starts, ends, np.zeros(0, bool), row
    head = np.ones(n, bool)
    head[1:] = piece[1:] != piece[:-1]
    h = hash_spans(text, starts, ends)
    trigger = np.zeros(n, bool)
    trigger[:-1] = (mix(h[:-1] + U64(3) * h[1:]) % U64(period) == 0) & ~head[1:]
    first = np.flatnonzero(head | trigger)
    following = np.append(first[1:], n)
    last = np.ones(len(first), bool)
    last[:-1] = head[following[:-1]]
    closing = np.where(last, following, following + OVERLAP)
    # A trigger has a second word in its piece, so two words of overlap are always there.
    return text, starts[first], ends[closing - 1], last, row[first]


def chunk_table(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", period: int = PERIOD) -> DataFrame:
    """The dictionary of the parse: lang, chunk, last (it ends its piece), times.

    A null language is ``und``, a null or empty text has no chunks, repeated rows count again and other columns
    are not read. A text that never triggers is one chunk as long as its longest piece.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for lo, hi in row_groups(offsets):
                text, starts, ends, last, row = parse(data, offsets[lo : hi + 1], period)
                if len(starts):
                    lang = b.column(0).slice(lo, hi - lo).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [lang, spans_as_text(text, starts, ends), pa.array(last)], ["lang", "chunk", "last"]
                    )

    parsed = rows.mapInArrow(each, "lang string, chunk string, last boolean")
    return parsed.groupBy("lang", "chunk", "last").agg(F.count("*").alias("times"))


@dataclass
class Words:
    """Words of texts that have one space between words: bytes, starts and ends in them, rows, numbers, distinct words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    number: np.ndarray
    distinct: pa.Array

    @classmethod
    def of(cls, texts: pa.Array) -> "Words":
        data, offsets = text_buffers(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        space = data == 32
        end = np.append(space, False)
        end[offsets[1:]] = True
        ends = np.flatnonzero(end)
        starts = np.append(0, ends[:-1])
        starts[1:] += space[starts[1:]]
        row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(ends, offsets, "right")))
        bounds = np.zeros(len(ends) + 1, np.int64)
        np.cumsum(ends - starts, out=bounds[1:])
        bare = pa.Array.from_buffers(
            pa.large_string(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data[~space])]
        )
        coded = bare.dictionary_encode()
        return cls(data, starts, ends, row, coded.indices.to_numpy().astype(np.int64), coded.dictionary)

    def hashes(self) -> np.ndarray:
        return _text_hashes(self.distinct)[self.number]


class GramFilter:
    """A set of n-grams as bits: whatever was put in is found, and little else."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, U64(8 * len(bits) - 1)

    @staticmethod
    def hashes(lang: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each word on (one less each time), with the language's hash."""
        h = mix(lang ^ words)
        for k in range(1, n):
            h = mix(h[:-1] + U64(0x9E3779B97F4A7C15) + words[k:])
        return h

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [h & self.mask, (h >> U64(32)) & self.mask]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h):
            found &= (self.bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return found


def gram_filter(grams: DataFrame, n: int, size: int) -> GramFilter:
    """The filter over ``size`` n-grams (lang, gram) of n words, put together from the bits that each task sets."""
    bits = min(FILTER, max(1 << 10, 1 << (16 * size - 1).bit_length()))
    empty = GramFilter(np.zeros(bits // 8, np.uint8))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = Words.of(b.column(1))
            h = GramFilter.hashes(_text_hashes(b.column(0))[words.row], words.hashes(), n)[::n]
            at = np.sort(np.concatenate([p & empty.mask for p in empty.places(h)]))
            word = at >> U64(6)
            new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            set_ = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[new].view(np.int64)), pa.array(set_.view(np.int64))], ["word", "bits"]
            )

    words = grams.select("lang", "gram").mapInArrow(each, "word long, bits long")
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return GramFilter(out.view(np.uint8))


def _text_hashes(texts: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(texts)
    return hash_spans(data, offsets[:-1], offsets[1:])


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal keys together, where each begins in it, and a number for each key."""
    order = np.argsort(key)
    new = np.diff(key[order], prepend=-1) != 0
    number = np.empty_like(key)
    number[order] = np.cumsum(new)
    return order, np.flatnonzero(new), number


def _count_slice(
    langs: pa.Array, chunks: pa.Array, last: np.ndarray, times: np.ndarray, n: int, allowed: GramFilter | None
) -> Iterator[pa.RecordBatch]:
    """N-grams of n words that start in their chunk, with the sum of the chunks' times; n = 1: '' with all words too."""
    words = Words.of(chunks)
    left = np.cumsum(np.bincount(words.row, minlength=len(last)))[words.row] - np.arange(len(words.row))
    start = (last[words.row] | (left > OVERLAP)) & (left >= n)
    coded = langs.dictionary_encode()
    lang = coded.indices.to_numpy().astype(np.int64)[words.row]
    if allowed is not None and n > 1:
        passed = allowed.has(GramFilter.hashes(_text_hashes(coded.dictionary)[lang], words.hashes(), n - 1))
        start[: len(passed) - 1] &= passed[:-1] & passed[1:]
    at = np.flatnonzero(start)
    if not len(at):
        return
    # Equal n-grams of a language get equal numbers: from those of their first words and of the last word.
    key = lang[at] * len(words.distinct) + words.number[at]
    for k in range(1, n):
        if k > 1 or len(coded.dictionary) * len(words.distinct) > 1 << 31:
            key = _numbered(key)[2]
        key = (key << 32) | words.number[at + k]
    order, new, _ = _numbered(key)
    seen = at[order[new]]
    weight = times[words.row[at]]
    parts = [(lang[seen], spans_as_text(words.data, words.starts[seen], words.ends[seen + n - 1]), np.add.reduceat(weight[order], new))]
    if n == 1:
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, lang[at], weight)
        parts.append((np.arange(len(total)), pa.array([""] * len(total)), total))
    for code, gram, f in parts:
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code)), gram, pa.array(f)], ["lang", "gram", "f"])


def _counted(chunks: DataFrame, n: int, allowed: GramFilter | None) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(allowed) if allowed is not None else None

    def slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        _, offsets = text_buffers(table["chunk"])
        for lo, hi in row_groups(offsets, SLICE):
            lang, chunk, last, times = (c.chunk(0) for c in table.slice(lo, hi - lo).combine_chunks().columns)
            known = shared.value if shared is not None else None
            yield from _count_slice(lang, chunk, last.to_numpy(zero_copy_only=False), times.to_numpy(), n, known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(1).nbytes
            if size >= SLICE:
                yield from slices(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from slices(pa.Table.from_batches(held))

    counted = chunks.select("lang", "chunk", "last", "times").mapInArrow(each, "lang string, gram string, f long")
    # Slices share words, but few longer n-grams: adding those up once more before the shuffle would find little.
    dealt = counted if n == 1 else counted.repartition("lang", "gram")
    return dealt.groupBy("lang", "gram").agg(F.sum("f").alias("f"))


def gram_counts(chunks: DataFrame, *, least: int = 1) -> DataFrame:
    """Counts of n-grams per language: lang, gram, f >= ``least``; the gram '' holds the language's number of words."""
    ship(chunks.sparkSession)
    frequent = (F.col("f") >= least) | (F.col("gram") == "")
    allowed, levels = None, []
    for n in range(1, LONGEST + 1):
        counted = scratch(_counted(chunks, n, allowed).where(frequent), f"collocations-{n}")
        levels.append(counted)
        if least > 1 and n < LONGEST:
            words = counted.where(F.col("gram") != "")
            allowed = gram_filter(words, n, words.count())
    return reduce(DataFrame.union, levels)


def _joined(words: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 10,
    inside_percent: int = 50,
    best: int = 2000,
) -> DataFrame:
    """The ``best`` phrases of two to LONGEST words of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count (``least`` at least), l and r those of the two parts of its lowest-scoring cut (ties: the
    first), score floor(1000000 a a / (l r)) in exact arithmetic, n the language's words. A phrase inside a longer
    one that has ``inside_percent`` of its count is left out. Order: score and a descending, phrase by bytes.
    ``best`` is the length of the report. Nulls and repeats: see ``chunk_table``; an empty table gives none.
    """
    chunks = scratch(chunk_table(docs, text_col=text_col, lang_col=lang_col), "collocations-chunks")
    counts = gram_counts(chunks, least=least)
    grams = counts.where(F.col("gram") != "")
    phrases = grams.withColumn("w", F.split("gram", " ")).where(F.size("w") > 1)
    cuts = phrases.select(
        "lang",
        F.col("gram").alias("phrase"),
        F.col("f").alias("a"),
        "w",
        F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"),
    )
    parts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), _joined(F.col("w"), F.lit(1), F.col("k")).alias("gram")),
                F.struct(F.lit(1).alias("side"), _joined(F.col("w"), F.col("k") + 1, F.size("w")).alias("gram")),
            )
        ).alias("p"),
    ).select("lang", "phrase", "a", "k", "p.side", "p.gram")
    # A frequent word is asked for by every phrase that holds it.
    met = spread_join(parts, grams, ["lang", "gram"], how="inner")
    sides = met.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))"
                   " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = sides.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # The longer phrases around each: every run of fewer words inside a phrase asks for it once.
    within = phrases.where(F.size("w") > 2).select(
        "lang",
        "f",
        "w",
        F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"),
    )
    within = within.select(
        "lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: _joined(F.col("w"), i, F.col("m")))).alias("phrase")
    )
    around = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent)
    )
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    dealt = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    ranked = dealt.where(F.col("rank") <= best).withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    )
    words = counts.where(F.col("gram") == "").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= best).join(words, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
