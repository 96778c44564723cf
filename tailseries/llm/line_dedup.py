"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of its lines that have words; a line's id is its 128-bit hash. Only lines
that occur more than once take part, and a stretch of such lines is a string of its own. Suffix ranks
start from the order of the ids - a class's rank is the number of suffixes before it - and each round
doubles the compared length by ranking (rank, rank of the suffix 2**k lines on) within a class. All
suffixes of one rank after k rounds agree in 2**k lines: they are an interval of the suffix array whose
longest common prefix is at least that long.

A run of lines counts when it has ``min_words`` words. Every longer repeated run is a union of shortest
such runs, from its lines forwards or backwards, so rounds go on until they tell the longest of these
apart, which have ``min_words`` lines at most. A run of m lines is named by two ranks, those of its
first and of its last 2**k lines. All copies of a run but the first go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tailseries.llm.common import Piece, pieces, row_key, scratch, ship

MIN_WORDS = 10
_SPREAD = 64


def _spans(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of words of every line of a piece, and each row's first line."""
    breaks = np.flatnonzero(p.data == 10)
    starts = np.sort(np.concatenate([p.offsets[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(breaks, p.offsets) + np.arange(len(p.offsets))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = p.offsets[1:]
    return starts, ends, np.searchsorted(p.starts, ends) - np.searchsorted(p.starts, starts), first


def _lines(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for p in pieces(batch.column("_text"), hashed=False):
            starts, ends, words, first = _spans(p)
            full = np.flatnonzero(words)
            row = np.searchsorted(first, full, "right") - 1
            index = np.arange(len(full)) - np.searchsorted(full, first)[row]
            view = memoryview(np.ascontiguousarray(p.data))
            ids = np.frombuffer(
                b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts[full], ends[full])), np.int64
            ).reshape(-1, 2)
            keys = [batch.column(c).slice(p.lo, p.hi - p.lo).to_numpy()[row] for c in ("_k1", "_k2")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*keys, index, words[full], ids[:, 0], ids[:, 1])],
                names=["_k1", "_k2", "i", "words", "l1", "l2"],
            )


def _first_ranks(lines: DataFrame) -> DataFrame:
    """For ids that occur twice or more: rank (suffixes with a smaller id) and n, how often."""
    classes = (
        lines.groupBy("l1", "l2")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .repartitionByRange("l1", "l2")
        .withColumn("part", F.spark_partition_id())
    )
    classes = scratch(classes, "line-ids")
    before = W.partitionBy("part").orderBy("l1", "l2").rowsBetween(W.unboundedPreceding, -1)
    # One row for each partition of the line above, so the window over all of them is small.
    parts = (
        classes.groupBy("part")
        .agg(F.sum("n").alias("m"))
        .withColumn("base", F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    )
    zero = F.lit(0).cast("long")
    return classes.join(parts, "part").select(
        "l1", "l2", "n", (F.coalesce("base", zero) + F.coalesce(F.sum("n").over(before), zero)).alias("rank")
    )


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """Repeated lines with ``stretch`` and ``r0``, ``r1``, ...: ranks by 1, 2, 4, ... up to ``depth`` lines."""
    place = W.partitionBy("_k1", "_k2").orderBy("i")
    table = (
        lines.join(_first_ranks(lines), ["l1", "l2"])
        # Rows equal in id and text have the same lines: one of each.
        .withColumn("_last", F.lag("i").over(place))
        .where("_last IS NULL OR _last < i")
        .withColumn("stretch", F.col("i") - F.row_number().over(place))
        .select("_k1", "_k2", "stretch", "i", "words", "n", F.col("rank").alias("r0"))
    )
    k, along = 0, W.partitionBy("_k1", "_k2", "stretch").orderBy("i")
    while 1 << k < depth:
        old, new = f"r{k}", f"r{k + 1}"
        # A suffix that ends within the compared length comes first in its class and is final: such
        # rows only pass through, spread out. The others follow by the rank of what comes next.
        table = table.withColumn("next", F.lead(old, 1 << k).over(along)).withColumn(
            "side", F.when(F.col("next").isNull(), 1 + F.pmod(F.hash("_k1", "_k2", "i"), F.lit(_SPREAD))).otherwise(0)
        )
        group = W.partitionBy(old, "side")
        rank = F.col(old) + F.col("n") - F.count("*").over(group) + F.rank().over(group.orderBy("next")) - 1
        table = (
            table.withColumn(new, F.when(F.col("next").isNull(), F.col(old)).otherwise(rank))
            .withColumn("n", F.count("*").over(W.partitionBy(old, "side", "next")))
            .drop("next", "side")
        )
        k += 1
    return table


def _shortest_runs(table: DataFrame, depth: int, min_words: int) -> DataFrame:
    """Runs (start, end) with enough words that end, or begin, with the fewest lines; named by m, ra and rb."""
    along = W.partitionBy("_k1", "_k2", "stretch").orderBy("i")
    levels = [c for c in table.columns if c[0] == "r"]
    ahead, behind = along.rowsBetween(0, depth - 1), along.rowsBetween(1 - depth, 0)
    found = []
    for side, frame in (("f", ahead), ("b", behind)):
        words = F.collect_list("words").over(frame)
        if side == "b":
            words = F.reverse(words)
        sums = F.aggregate(
            words,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("m")),
            lambda a, w: F.when(a["sum"] >= min_words, a).otherwise(
                F.struct((a["sum"] + w).alias("sum"), (a["m"] + 1).alias("m"))
            ),
        )
        table = table.withColumn(f"_{side}", sums)
        table = table.withColumn(f"_{side}", F.when(F.col(f"_{side}.sum") >= min_words, F.col(f"_{side}.m")))
        for c in levels:
            table = table.withColumn(f"_{side}{c}", F.collect_list(c).over(frame))
    for side in "fb":
        m = F.col(f"_{side}")
        start = F.col("i") if side == "f" else F.col("i") - m + 1
        ra = rb = F.lit(None).cast("long")
        for k in reversed(range(len(levels))):
            ranks, size = F.col(f"_{side}r{k}"), 1 << k
            first = F.lit(1) if side == "f" else F.size(ranks) - m + 1
            fits = (m >= size) & (m < 2 * size) if k + 1 < len(levels) else m >= size
            ra = F.when(fits, F.try_element_at(ranks, first)).otherwise(ra)
            rb = F.when(fits, F.try_element_at(ranks, first + m - size)).otherwise(rb)
        found.append(
            table.where(m.isNotNull()).select(
                "_k1", "_k2", start.alias("start"), (start + m).alias("end"), m.alias("m"), ra.alias("ra"), rb.alias("rb")
            )
        )
    return found[0].union(found[1].where("m > 1"))


def repeated_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """_k1, _k2 (see row_key) and the runs (start, end: numbers of lines with words) to remove from that row."""
    ship(docs.sparkSession)
    lines = scratch(
        docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_text")).mapInArrow(
            _lines, "_k1 long, _k2 long, i long, words long, l1 long, l2 long"
        ),
        "lines",
    )
    # Lines with enough words of their own need no neighbours; short ones decide how far to look.
    short = lines.where(F.col("words") < min_words).agg(F.min("words")).first()[0]
    depth = 1 if short is None else -(-min_words // short)
    levels = scratch(suffix_ranks(lines, depth), "suffixes")
    runs = _shortest_runs(levels, depth, min_words)
    here = F.struct("_k1", "_k2", "start")
    first = runs.groupBy("m", "ra", "rb").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    return (
        runs.join(first.where("first < last").drop("last"), ["m", "ra", "rb"])
        .where(F.col("first") < here)
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("start", "end")).alias("_runs"))
    )


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            runs, copy = batch.column("_runs"), batch.column("_copy").to_numpy()
            for p in pieces(batch.column("_text"), hashed=False):
                starts, ends, words, first = _spans(p)
                rows = p.hi - p.lo
                full = np.flatnonzero(words)
                base = np.searchsorted(full, first)
                cover = np.zeros(len(full) + 1, np.int64)
                mine = runs.slice(p.lo, rows)
                total = np.diff(np.concatenate([[0], np.cumsum(words)])[first])
                for r in range(rows):
                    if copy[p.lo + r] > 1:
                        if total[r] >= min_words:
                            cover[base[r]] += 1
                            cover[base[r + 1]] -= 1
                    elif mine[r].is_valid:
                        for span in mine[r].as_py():
                            cover[base[r] + span["start"]] += 1
                            cover[base[r] + span["end"]] -= 1
                gone = np.zeros(len(starts), bool)
                gone[full[np.cumsum(cover[:-1]) > 0]] = True
                view = memoryview(np.ascontiguousarray(p.data))
                texts = []
                for r in range(rows):
                    lines = range(first[r], first[r + 1])
                    if gone[first[r] : first[r + 1]].any():
                        texts.append(b"\n".join(view[starts[i] : ends[i]] for i in lines if not gone[i]))
                    else:
                        texts.append(bytes(view[starts[lines[0]] : ends[lines[-1]]]))
                removed = np.add.reduceat(gone.astype(np.int64), first[:-1]) if rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(p.lo, rows),
                        batch.column("_row").slice(p.lo, rows),
                        pa.array(np.diff(base)),
                        pa.array(removed),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array([t.decode() for t in texts], pa.string()),
                    ],
                    names=["_id", "_row", "n_lines", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Delete every repeated run of lines of ``min_words`` words or more, except where it comes first.

    Lines are what lies between line feeds; lines without words belong to no run and stay. Order is by
    id, then text hash, then line; runs are judged on the input. One row per input row: id, n_lines (with
    words), n_removed, kept_text (what is left, joined by line feeds), kept_sha256, and the columns named
    in ``carry`` as the struct _row. Nulls and empty texts have no lines and stay empty; null ids come
    first. Of rows equal in id and text one is the first copy and the others lose all their lines if these
    have enough words.
    """
    runs = repeated_runs(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    k1, k2 = row_key(id_col, text_col)
    # Columns of the table itself may not be hidden by the names used here: it comes in renamed.
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), k1, k2, row.alias("_row"))
    kinds, carried = dict(docs.dtypes), texts.schema["_row"].dataType.simpleString()
    copy = F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.lit(0)))
    return (
        texts.join(runs, ["_k1", "_k2"], "left")
        .withColumn("_copy", copy)
        .select("_id", "_row", "_text", "_runs", "_copy")
        .mapInArrow(
            _cut(min_words),
            f"_id {kinds[id_col]}, _row {carried}, n_lines long, n_removed long, kept_sha256 string, kept_text string",
        )
        .withColumnRenamed("_id", id_col)
    )
