"""Mixing sources to target weights by fitting a subset sum of document lengths.

A source's target is met by whole rounds over its documents and a remainder. Of the remainder, each
length first gives its proportional number of documents, rounded down. Of the shortest documents, up to RESERVE words,
none is taken at first; longer ones are added until half of that reserve would do, and a bounded knapsack over
the reserve then takes the sum nearest to what is missing, from below or above. Where all choices of documents are
few, all are tried. Only counts by (source, length) go to the fit; which documents of a length are chosen follows from a
seeded hash, counted in 64 ranges of the hash so that no length is ranked in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tailseries.llm.common import pieces, row_key, scratch, ship

CAP = 3
#: Sums that a knapsack keeps apart, and words of the shortest documents that it chooses from in the end.
SUMS, RESERVE = 1 << 16, 1 << 14


def _sizes(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        counts = [np.diff(p.first) for p in pieces(batch.column("_text"), hashed=False)]
        sizes = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("_id", "_source", "_k1", "_k2", "_hash")] + [sizes],
            names=["_id", "_source", "_k1", "_k2", "_hash", "size"],
        )


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """_id, _source, _k1 and _k2 (see row_key), the seeded hash and the number of words of every row."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    k1, k2 = row_key(id_col, text_col)
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        k1,
        k2,
        F.xxhash64(F.lit(seed), k1, k2).alias("_hash"),
        F.col(text_col).alias("_text"),
    ).mapInArrow(_sizes, f"_id {kinds[id_col]}, _source {kinds[source_col]}, _k1 long, _k2 long, _hash long, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """_key, _source, source_size and target: a row for each source, so windows over all of them are small.

    A target is weight times the level at which all targets add up to all sizes, or the cap. The level
    follows from the sources in the order in which they meet their caps.
    """
    per_source = sizes.groupBy("_key", "_source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("_source").asc_nulls_last())
    ranked = per_source.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    ).withColumn("_full", cap * F.col("source_size") / F.col("weight"))
    order = W.orderBy("_full", "_key")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(W.partitionBy())
        - cap * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    ) / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    level = F.when(level <= F.col("_full"), level)
    return (
        ranked.withColumn("_level", level)
        .withColumn(
            "_level",
            F.min(F.when(F.col("_level").isNotNull(), F.struct("_full", "_key", "_level"))).over(W.partitionBy())[
                "_level"
            ],
        )
        .select(
            "_key",
            "_source",
            "source_size",
            F.least(F.col("weight") * F.col("_level"), (cap * F.col("source_size")).cast("double")).alias("target"),
        )
    )


def _nearest(sums: np.ndarray, goal: int) -> int:
    """Place of the sum nearest to the goal; ties go to the one below."""
    return int(np.argmin(np.abs(sums - goal) * 2 + (sums > goal)))


def _every(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """The choice whose sum is nearest to the goal, from all choices."""
    sums = np.zeros(1, np.int64)
    for length, n in zip(lengths, counts):
        sums = (sums[:, None] + length * np.arange(n + 1)).ravel()
    at = _nearest(sums, goal)
    taken = np.zeros(len(lengths), np.int64)
    for i in range(len(lengths) - 1, -1, -1):
        at, taken[i] = divmod(at, int(counts[i]) + 1)
    return taken


def _knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """Bounded knapsack: how many of each length make a sum next to the goal, below or above.

    A sum beyond twice the goal is farther from it than none, so the table ends there. Each of its cells holds
    the first sum found in it; where SUMS cells are enough they are one word wide, and the nearest sum is found.
    """
    unit = 2 * goal // SUMS + 1
    cells = 2 * goal // unit + 1
    sums = np.full(cells, -1, np.int64)
    via = np.full(cells, -1, np.int64)
    sums[0] = 0
    steps: list[tuple[int, int]] = []
    for i in np.flatnonzero((counts > 0) & (lengths > 0) & (lengths <= 2 * goal))[::-1]:
        n, part = min(int(counts[i]), 2 * goal // int(lengths[i])), 1
        while n and sums[goal // unit] != goal:
            part = min(part, n)
            weight = part * int(lengths[i])
            known = np.flatnonzero(sums >= 0)
            new = sums[known] + weight
            known, new = known[new <= 2 * goal], new[new <= 2 * goal]
            cell = new // unit
            free = sums[cell] < 0
            # Of several sums for one cell the last one stays; any of them will do.
            sums[cell[free]] = new[free]
            via[cell[free]] = len(steps)
            steps.append((i, part))
            n -= part
            part *= 2
    known = np.flatnonzero(sums >= 0)
    at = int(known[_nearest(sums[known], goal)])
    taken = np.zeros(len(lengths), np.int64)
    while at:
        i, part = steps[via[at]]
        taken[i] += part
        at = (int(sums[at]) - part * int(lengths[i])) // unit
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length, ascending, to take so that their words come near the budget.

    The nearest sum there is, from either side, where all choices are at most SUMS; otherwise the nearest that
    the reserve of short documents makes beside the longer ones. Ties go to the sum below.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    if np.log2(counts + 1.0).sum() <= np.log2(SUMS):
        return _every(lengths, counts, budget)

    def off(taken: np.ndarray) -> int:
        return budget - int((taken * lengths).sum())

    before = np.concatenate([[0], np.cumsum(lengths * counts)[:-1]])
    reserve = np.where(
        lengths > 0, np.clip((RESERVE - before) // np.maximum(lengths, 1), 0, counts), 0
    )
    kept = int((reserve * lengths).sum())
    others = counts - reserve
    plain = np.minimum(np.floor(others * (budget / total)).astype(np.int64), others)
    best = np.zeros(len(lengths), np.int64)
    for coarse in (False, True):
        taken = plain.copy()
        goal = off(taken) - kept // 2
        if goal > 0 and coarse:
            taken += _knapsack(lengths, others - plain, goal)
        elif goal > 0:
            for i in np.argsort(-lengths, kind="stable"):
                n = min(int(others[i] - taken[i]), goal // int(lengths[i])) if lengths[i] else 0
                taken[i] += n
                goal -= n * int(lengths[i])
        missing = off(taken)
        if missing >= kept:
            taken = taken + reserve
        elif missing > 0:
            taken = taken + _knapsack(lengths, reserve, missing)
        if abs(off(taken)) < abs(off(best)):
            best = taken
        if not off(best):
            break
    return best


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    rounds = min(int(target // total), CAP) if total else 0
    extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), round(target - rounds * total))
    return pdf[["_key", "size", "source_size", "target"]].assign(rounds=rounds, extra=extra if rounds < CAP else 0)


def _chosen(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Every row's _id, _source, _k1, _k2 and its results (see mix_to_targets)."""
    sizes = scratch(
        measured(docs, id_col, text_col, source_col, seed).withColumn(
            "_key", F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit(""))
        ),
        "sizes",
    )
    plan = (
        sizes.groupBy("_key", "size")
        .agg(F.count("*").alias("n"))
        .join(source_targets(sizes).drop("_source"), "_key")
        .groupBy("_key")
        .applyInPandas(
            _fit_source, "_key string, size long, source_size long, target double, rounds long, extra long"
        )
    )
    sizes = sizes.withColumn("_range", F.shiftright("_hash", 58))
    ranges = (
        sizes.groupBy("_key", "size", "_range")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("n").over(
                    W.partitionBy("_key", "size").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .join(plan, ["_key", "size"])
        .drop("n")
    )
    place = F.row_number().over(W.partitionBy("_key", "size", "_range").orderBy("_hash", "_id"))
    copies = F.col("rounds") + (F.col("before") + F.col("_place") <= F.col("extra")).cast("long")
    return (
        sizes.withColumn("_place", place)
        .join(ranges, ["_key", "size", "_range"])
        .withColumn("copies", copies)
        .select(
            "_id",
            "_source",
            "_k1",
            "_k2",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mix_to_targets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document: id, source, size, source_size, target, copies and taken words.

    Sources by code point, null last, weigh 1, 2, 3, repeating; they share the words of the whole
    table. One row per input row. A null or empty text has size 0 and takes 0 words; null sources are
    a source of their own; repeated rows are chosen one by one; ids may be null. An empty table gives
    no rows. Reruns agree: choices depend on seed, id and text only.
    """
    chosen = _chosen(docs, id_col, text_col, source_col, seed).drop("_k1", "_k2")
    return chosen.withColumnsRenamed({"_id": id_col, "_source": source_col})


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, that it takes, and how many copies of each.

    A document without words counts for nothing and is left out. Rows equal in id and text are told apart
    by counting them, so that each gets one of their decisions. A column named copies before is replaced.
    """
    nth = F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.lit(0))).alias("_nth")
    chosen = _chosen(docs, id_col, text_col, source_col, seed).select("_k1", "_k2", "copies", nth)
    kept = [c for c in docs.columns if c != "copies"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    met = (
        docs.select(*row_key(id_col, text_col), row)
        .select("_k1", "_k2", "_row", nth)
        .join(chosen.where("copies > 0"), ["_k1", "_k2", "_nth"])
    )
    return met.select(*[F.col("_row").getField(c).alias(c) for c in kept], "copies")
