"""Quality scores of documents by histogram gradient-boosted trees over statistics of the text.

``statistics`` computes whole columns of document statistics with numpy, straight from the bytes of the texts. ``fit``
learns on at most ``sample_docs`` labelled documents: values are cut into at most BINS bins at quantiles, and each tree
grows level by level from histograms of gradients, all nodes and statistics of a level at once. The trees are
flattened into arrays in heap order, and a batch of documents walks down all its trees by array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tailseries.llm.common import U64, mix, pieces, ship

STATISTICS = (
    "chars words mean_word longest_word upper lower digits marks blanks beyond_ascii lines mean_line short_lines "
    "repeated_lines distinct_words commonest_word repeated_next distinct_pairs doubled_bytes ends_in_mark wordless "
    "capitals shouted sentence_ends"
).split()
BINS = 64
#: Sorting into this many groups decides which labelled documents make the sample.
DEALT = 4096
_KIND = np.zeros(256, np.int8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 mark, 5 blank, 6 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        6 if _b >= 128 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 5 if _c.isspace()
        else 4 if _c.isprintable() else 0
    )


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, how many distinct values there are and how often the commonest occurs; values by their upper bits."""
    bits = U64(max(1, n.bit_length()))
    key = np.sort((row.astype(U64) << (U64(64) - bits)) | (value >> bits))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    row = (key[new] >> (U64(64) - bits)).astype(np.int64)
    return np.bincount(row, minlength=n), _largest(times, np.searchsorted(row, np.arange(n + 1)))


def _largest(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest value of each of the consecutive groups that start at ``first``; 0 for an empty one."""
    out = np.zeros(len(first) - 1, np.int64)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.maximum.reduceat(values, first[:-1][full])
    return out


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each of ascending spans."""
    full = ends > starts
    out = np.zeros(len(starts), np.int64)
    if full.any():
        cuts = np.stack([starts[full], ends[full]], 1).reshape(-1)
        out[full] = np.add.reduceat(np.append(flags, False), cuts, dtype=np.int64)[::2]
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """STATISTICS of every text of a column, one row each; sizes of words are bytes.

    A null text is empty, and an empty text has zeros. Memory is a small multiple of the longest text.
    """
    out = np.zeros((len(column), len(STATISTICS)))
    for p in pieces(column):
        n, rows, data = p.hi - p.lo, p.offsets, p.data
        kind = _KIND[data]
        lo, hi = rows[:-1], rows[1:]
        size = hi - lo
        words = np.diff(p.first)
        of_word = p.row_of_word
        length = p.ends - p.starts
        upper, lower, beyond = (_count(kind == k, p.starts, p.ends) for k in (1, 2, 6))
        last = data[p.ends - 1]
        again = np.append(False, data[1:] == data[:-1])[: len(data)]
        again[lo[size > 0]] = False
        follows = of_word[1:] == of_word[:-1]
        pair = mix(p.hashes[:-1] + U64(3) * p.hashes[1:])[follows]
        distinct_words, commonest = _distinct(of_word, p.hashes, n)
        distinct_pairs, _ = _distinct(of_word[1:][follows], pair, n)

        # A line ends at a line feed or with its text; lines with words are told apart by their words' hashes in order.
        feed = np.flatnonzero(data == 10)
        end = np.concatenate([feed, hi])
        row = np.concatenate([np.searchsorted(rows, feed, "right") - 1, np.arange(n)])
        order = np.lexsort((end, row))
        end, row = end[order], row[order]
        words_before = np.searchsorted(p.starts, end)
        in_line = np.diff(words_before, prepend=0)
        row, first, in_line = row[in_line > 0], (words_before - in_line)[in_line > 0], in_line[in_line > 0]
        place = np.arange(len(of_word)) - np.repeat(first, in_line)
        told = mix(p.hashes + place.astype(U64))
        told = np.add.reduceat(told, first) if len(first) else told
        lines = np.bincount(row, minlength=n)

        def of_words(flags: np.ndarray) -> np.ndarray:
            return _share(np.bincount(of_word, flags, minlength=n), words)

        columns = [
            np.log1p(size - _count((data & 0xC0) == 0x80, lo, hi)),
            np.log1p(words),
            of_words(length),
            _largest(length, p.first),
            *[_share(_count(kind == k, lo, hi), size) for k in (1, 2, 3, 4, 5, 6)],
            np.log1p(lines),
            _share(words, lines),
            _share(np.bincount(row, in_line < 4, minlength=n), lines),
            _share(lines - _distinct(row, told, n)[0], lines),
            _share(distinct_words, words),
            _share(commonest, words),
            _share(np.bincount(of_word[1:], follows & (p.hashes[1:] == p.hashes[:-1]), minlength=n), words),
            _share(distinct_pairs, words - 1),
            _share(_count(again, lo, hi), size),
            of_words(_KIND[last] == 4),
            of_words(upper + lower + beyond == 0),
            of_words(_KIND[data[p.starts]] == 1),
            of_words((upper > 1) & (lower == 0)),
            of_words(np.isin(last, [33, 46, 63])),
        ]
        out[p.lo : p.hi] = np.stack(columns, 1)
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth in heap order: node k has the children 2k + 1 and 2k + 2.

    At an inner node documents with ``x[feature] > cut`` go right; a node that doesn't split has the cut infinity.
    ``leaf`` holds the values below the inner nodes, one row per tree.
    """

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        every = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cuts of each column, halfway between neighbouring values at quantiles; fewer than ``bins``."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def histograms(binned: np.ndarray, node: np.ndarray, nodes: int, bins: int, *weights: np.ndarray) -> list[np.ndarray]:
    """Sums of the weights by node, column and bin."""
    out = [np.empty((nodes, binned.shape[1], bins)) for _ in weights]
    for f in range(binned.shape[1]):
        at = node * bins + binned[:, f]
        for o, w in zip(out, weights):
            o[:, f] = np.bincount(at, w, minlength=nodes * bins).reshape(nodes, bins)
    return out


def best_cuts(g: np.ndarray, h: np.ndarray, weight: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, bin and gain of each node's best split: bins up to the one named go left. Ties: the first."""
    gl, hl = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    gt, ht = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + weight) + gr**2 / (hr + weight) - gt**2 / (ht + weight)
    gain = np.where((hl >= least) & (hr >= least), gain, 0).reshape(len(g), -1)
    best = gain.argmax(1)
    return best // gl.shape[2], best % gl.shape[2], gain[np.arange(len(g)), best]


def boost(
    x: np.ndarray,
    y: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    weight: float = 1.0,
    least: float = 2.0,
) -> Trees:
    """Boosted trees for the logarithmic loss; labels may lie between 0 and 1. Without rows the score is 0.5."""
    inner = (1 << depth) - 1
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if not len(x):
        return Trees(0.0, feature, cut, leaf)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    margin = np.full(len(x), base := float(np.log(mean / (1 - mean))))
    edges = bin_edges(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    bins = max(len(e) for e in edges) + 1
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            f, b, gain = best_cuts(*histograms(binned, node, nodes, bins, g, h), weight, least)
            for k in np.flatnonzero(gain > 1e-9):
                feature[t, first + k], cut[t, first + k] = f[k], edges[f[k]][b[k]]
            right = (binned[np.arange(len(x)), f[node]] > b[node]) & (gain[node] > 1e-9)
            node = 2 * node + right
        leaf[t] = rate * np.bincount(node, g, minlength=inner + 1) / (np.bincount(node, h, minlength=inner + 1) + weight)
        margin += leaf[t][node]
    return Trees(base, feature, cut, leaf)


def sample_ids(labels: DataFrame, *, id_col: str, label_col: str, sample_docs: int) -> DataFrame:
    """Ids and mean labels of at most ``sample_docs`` labelled documents, the first groups of ids by hash.

    Rows without id or label teach nothing; several labels of an id count as their mean. Where all fit,
    all are taken.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    each = known.groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
    each = each.withColumn("_group", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(DEALT)).cast("int"))
    sizes = sorted(tuple(r) for r in each.groupBy("_group").count().collect())
    taken, full = 0, -1
    for group, n in sizes:
        if taken + n > sample_docs:
            break
        taken, full = taken + n, group
    return each.where(F.col("_group") <= full).drop("_group")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = 20_000,
    **parameters,
) -> Trees:
    """Trees learnt from whole texts of at most ``sample_docs`` labelled documents.

    Documents that share an id count as one, the one whose text has the smallest hash. ``parameters`` go to ``boost``.
    Only ids and labels of the sample are broadcast, and only its statistics reach the driver: at most
    ``sample_docs`` rows of len(STATISTICS) numbers.
    """
    ship(docs.sparkSession)
    ids = sample_ids(labels, id_col=id_col, label_col=label_col, sample_docs=sample_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")
    texts = texts.select(F.col("_id").cast("string").alias("i"), "_label", F.xxhash64("_text").alias("h"), "_text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(b.column(3)).reshape(-1)), len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), x.cast(pa.list_(pa.float64()))], ["i", "label", "h", "x"]
            )

    rows = texts.mapInArrow(each, "i string, label double, h long, x array<double>")
    one = rows.groupBy("i").agg(F.min(F.struct("h", "label", "x")).alias("row")).select("i", "row.label", "row.x")
    got = one.toArrow().sort_by("i")
    x = got["x"].combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0)
    return boost(x.reshape(-1, len(STATISTICS)), got["label"].to_numpy(), **parameters)


def score_quality(docs: DataFrame, model: Trees, *, text_col: str = "text", at_least: float = 0.7) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= ``at_least``).

    Only the text goes through Python, whole. A null text scores like an empty one. Every row is kept, repeated ones
    too, and equal texts score alike; columns named score or predicted before are replaced.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(texts)))

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    scored = kept.withColumn("score", score(F.col(f"`{text_col}`")))
    return scored.withColumn("predicted", (F.col("score") >= at_least).cast("int"))
