"""MinHash near-dedup by an inverted join over signature coordinates.

Documents are sets of word shingles; equal sets are one node from the start. A node's signature has
COORDINATES minimum hashes. Two nodes whose similarity reaches the threshold agree in ``matches`` of them
but for a share of MISS of the pairs that lie exactly on the threshold, and so share one of the
COORDINATES - ``matches`` + 1 rarest coordinate-value pairs of each (prefix filter). Both numbers of matches
follow from the threshold. Nodes are posted under
those; values that one node has need no posting.

1. Each posting list joins its members to one pivot, its most typical member. These pairs are confirmed
   on full sets. In a group of copies nearly all members meet here, without pairs among them.
2. Lists whose members are still in different components are merged in blocks: collisions of members of
   different components are counted, each pair under its first shared posting only. Pairs with enough
   are counted on over FINE further coordinates of 8 bits, and those with enough in all
   name a node and the component it may belong to.
3. Each such node is confirmed on full sets against all members of that component, in blocks.

Links join components; a component's name is its smallest id. Nothing is capped: lists and components of
any size are processed in blocks of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tailseries.llm.common import U64, Rolling, mix, packed, pieces, row_key, scratch, ship, unpacked

COORDINATES, FINE = 40, 216
#: Share of the pairs exactly on the threshold that have fewer matches than asked for.
MISS = 4e-6
BLOCK = 256
LIST_BLOCK = 1024
_WORDS = Rolling(0xC2B2AE3D27D4EB4F)
_SEEDS = mix(np.arange(1, COORDINATES + FINE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def matches(percent: int, coordinates: int) -> int:
    """The most matches that pairs of this similarity have in all but a share of MISS of cases; 1 at least."""
    s, left = percent / 100, 0.0
    for m in range(coordinates + 1):
        left += comb(coordinates, m) * s**m * (1 - s) ** (coordinates - m)
        if left > MISS:
            return max(1, m)
    return coordinates


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, all their distinct shingles (rising within a row), and how many each row has.

    Fewer words than ``width`` are one shingle; no words are none.
    """
    for p in pieces(column, lower=True):
        words = np.diff(p.first)
        prefix = _WORDS.prefix(mix(p.hashes))
        n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        row = np.repeat(np.arange(len(n)), n)
        at = p.first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = _WORDS.ranges(prefix, at, np.minimum(at + width, p.first[row + 1]))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield p.lo, p.hi, h[new], np.bincount(row[new], minlength=len(n))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi, h, n in shingle_sets(batch.column("_text"), width):
                rows = hi - lo
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                node, check = np.zeros(rows, U64), np.zeros(rows, U64)
                signature = np.zeros((rows, COORDINATES), np.uint32)
                if len(full):
                    node[full] = mix(np.add.reduceat(mix(h), starts) + n[full].astype(U64))
                    check[full] = np.add.reduceat(mix(h ^ U64(0xA0761D6478BD642F)), starts)
                    for k in range(COORDINATES):
                        signature[full, k] = np.minimum.reduceat((mix(h ^ _SEEDS[k]) >> U64(32)).astype(np.uint32), starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, rows) for c in ("_id", "_k1", "_k2")]
                    + [
                        pa.array(node.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.array(n),
                        packed(signature.reshape(-1), np.full(rows, COORDINATES)),
                    ],
                    names=["_id", "_k1", "_k2", "node", "check", "n_shingles", "signature"],
                )

    return run


def _fine(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi, h, n in shingle_sets(batch.column("_text"), width):
                signature = np.zeros((hi - lo, FINE), np.uint8)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                for k in range(FINE if len(full) else 0):
                    signature[full, k] = np.minimum.reduceat(mix(h ^ _SEEDS[COORDINATES + k]), starts) & U64(255)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo), packed(signature.reshape(-1), np.full(hi - lo, FINE))],
                    names=["node", "fine"],
                )

    return run


def _coordinates(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        values = unpacked(batch.column("signature"), np.uint32)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column("node").to_numpy(), COORDINATES)),
                pa.array(np.tile(np.arange(COORDINATES, dtype=np.int32), n)),
                pa.array(values.view(np.int32)),
            ],
            names=["node", "k", "v"],
        )


def postings(nodes: DataFrame, percent: int) -> DataFrame:
    """node, k, v: each node under its rarest shared coordinate-value pairs; weight: how typical it is."""
    coordinates = nodes.select("node", "signature").mapInArrow(_coordinates, "node long, k int, v int")
    shared = coordinates.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    posted = coordinates.join(shared, ["k", "v"])
    # At most COORDINATES entries a node; single values come before all shared ones.
    entry = F.struct("n", "k", "v")
    return (
        posted.groupBy("node")
        .agg(F.sort_array(F.collect_list(entry)).alias("all"), F.sum(F.log("n")).alias("weight"))
        .withColumn("kept", F.size("all") - (matches(percent, COORDINATES) - 1))
        .where("kept > 0")
        .select("node", "weight", F.explode(F.slice("all", F.lit(1), F.col("kept"))).alias("e"))
        .select("node", "weight", "e.k", "e.v")
    )


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, h, n in shingle_sets(column, width):
        out += np.split(h, np.cumsum(n)[:-1]) if len(n) else []
    return out


def _confirm_pairs(width: int, percent: int):
    """Rows of a pivot lie together, so its set is computed once a batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pivots = batch.column("pivot").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], pivots[1:] != pivots[:-1]]))
            of_pivot = _sets(batch.column("pivot_text").take(pa.array(begins)), width)
            where = np.searchsorted(begins, np.arange(len(pivots)), "right") - 1
            own = _sets(batch.column("_text"), width)
            hit = np.array([_similar(own[i], of_pivot[where[i]], percent) for i in range(len(own))], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").filter(pa.array(hit)), batch.column("pivot").filter(pa.array(hit))],
                names=["a", "b"],
            )

    return run


def _merge_lists(percent: int):
    """Nodes of smaller components and the larger components that they may belong to, within a list."""
    least, least_of_all = matches(percent, COORDINATES), matches(percent, COORDINATES + FINE)

    def run(table: pa.Table) -> pa.Table:
        return _met(table, least, least_of_all)

    return run


def _met(table: pa.Table, least: int, least_of_all: int) -> pa.Table:
    table = table.combine_chunks()
    signature = unpacked(table.column("signature"), np.uint32).reshape(-1, COORDINATES)
    fine = unpacked(table.column("fine"), np.uint8).reshape(-1, FINE)
    posted = unpacked(table.column("posted"), np.uint8).reshape(-1, COORDINATES).astype(bool)
    node, own = table.column("node").to_numpy(), table.column("component").to_numpy()
    size, side = table.column("size").to_numpy(), table.column("side").to_numpy()
    k = table.column("k")[0].as_py()
    rank = np.lexsort((own, size))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    left = np.flatnonzero(side <= 0) if (side != 0).any() else np.arange(len(node))
    right = np.flatnonzero(side >= 0) if (side != 0).any() else left
    found = set()
    for i in left:
        other = right[own[right] != own[i]]
        if not len(other):
            continue
        equal = signature[other] == signature[i]
        # A pair belongs to the first list in which both are posted.
        first = (equal & posted[other] & posted[i]).argmax(axis=1)
        same = equal.sum(axis=1)
        near = np.flatnonzero((same >= least) & (first == k))
        near = near[same[near] + (fine[other[near]] == fine[i]).sum(axis=1) >= least_of_all]
        for j in other[near]:
            small, large = (i, j) if (size[i], own[i]) < (size[j], own[j]) else (j, i)
            found.add((int(node[small]), int(own[large]), int(size[large])))
    rows = sorted(found)
    return pa.table(
        {
            "node": pa.array([r[0] for r in rows], pa.int64()),
            "component": pa.array([r[1] for r in rows], pa.int64()),
            "size": pa.array([r[2] for r in rows], pa.int64()),
        }
    )


def _confirm_blocks(width: int, percent: int):
    def run(members: pa.Table, asking: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(members) or not len(asking):
            return empty
        sets = _sets(members.column("_text").combine_chunks(), width)
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every)
        every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        names, found = members.column("node").to_numpy(), []
        for name, own in zip(asking.column("node").to_numpy(), _sets(asking.column("_text").combine_chunks(), width)):
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            same = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero(100 * same >= percent * (sizes + len(own) - same))
            if len(hit):
                found.append((int(name), int(names[hit[0]])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in links (a, b), by alternating stars.

    Each step ties a node's neighbours to its smallest one; minima are combined before the shuffle, and
    every round is written, so lineage stays short.
    """
    edges = scratch(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = scratch(small, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        mark = now


def _grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between the components in ``found``."""
    named = found.select(F.col("node"), F.col("component"))
    for side in "ab":
        links = (
            links.join(named.withColumnRenamed("node", side), side, "left")
            .withColumn(side, F.coalesce("component", side))
            .drop("component")
        )
    joined = components(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = named.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # Nodes that had no link before, and the smallest node of a component, name themselves.
    return moved.union(joined.select(F.col("component").alias("node"), F.col("to").alias("component"))).groupBy(
        "node"
    ).agg(F.min("component").alias("component"))


def near_links(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component of all linked nodes. nodes: node, signature, _k1, _k2; texts: _k1, _k2, _text."""
    lists = scratch(postings(nodes, percent), "postings")
    pivot = (
        lists.groupBy("k", "v")
        .agg(F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("m"))
        .where("m > 1")
        .select("k", "v", F.col("top.node").alias("pivot"))
    )
    lists = lists.join(pivot, ["k", "v"])
    pairs = scratch(lists.where("node <> pivot").select("node", "pivot").distinct(), "pairs")
    # Only nodes that share a list need their text. Rows equal in id and text are one.
    wanted = lists.select("node").distinct().join(nodes.select("node", "_k1", "_k2"), "node")
    texts = scratch(
        texts.join(wanted, ["_k1", "_k2"]).select("node", "_text").dropDuplicates(["node"]), "candidates"
    )
    links = scratch(
        pairs.join(texts, "node")
        .join(texts.select(F.col("node").alias("pivot"), F.col("_text").alias("pivot_text")), "pivot")
        .sortWithinPartitions("pivot")
        .mapInArrow(_confirm_pairs(width, percent), "a long, b long"),
        "links",
    )
    found = scratch(components(links), "components")
    # Lists that still lie in several components.
    placed = scratch(
        lists.join(found, "node", "left").select("k", "v", "node", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    open_lists = (
        placed.groupBy("k", "v")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
        .where("lo < hi")
        .select("k", "v", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("blocks"))
    )
    posted = placed.groupBy("node", "component").agg(F.collect_list("k").alias("ks"))
    compared = placed.join(open_lists, ["k", "v"]).select("node").distinct()
    fine = texts.join(compared, "node").select("node", "_text").mapInArrow(_fine(width), "node long, fine binary")
    mask = F.concat(*[F.when(F.array_contains("ks", k), F.lit(b"\1")).otherwise(F.lit(b"\0")) for k in range(COORDINATES)])
    sizes = placed.select("node", "component").distinct().groupBy("component").agg(F.count("*").alias("size"))
    described = (
        posted.select("node", "component", mask.alias("posted"))
        .join(sizes, "component")
        .join(nodes.select("node", "signature"), "node")
        .join(fine, "node")
        .drop("component")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = (
        placed.join(open_lists, ["k", "v"])
        .withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "k",
            "v",
            "node",
            "component",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            F.signum(F.col("own") - F.col("other")).cast("int").alias("side"),
        )
        .join(described, "node")
    )
    asked = scratch(
        met.groupBy("k", "v", "i", "j")
        .applyInArrow(_merge_lists(percent), "node long, component long, size long")
        .distinct()
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")),
        "asked",
    )
    members = (
        asked.groupBy("component")
        .agg(F.max("blocks").alias("blocks"))
        .join(placed.select("component", "node").distinct(), "component")
        .select("component", "node", block.alias("block"))
        .join(texts, "node")
    )
    asking = asked.select(
        "component", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    ).join(texts, "node")
    # Both sides come from the same tables: columns of their own tell them apart.
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])
    members = members.select(*[F.col(c).alias(c) for c in members.columns])
    more = scratch(
        members.groupBy("component", "block")
        .cogroup(asking.groupBy("component", "block"))
        .applyInArrow(_confirm_blocks(width, percent), "a long, b long"),
        "links",
    )
    return scratch(_grown(found, more), "components")


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Every row's _id, _k1, _k2 and its results (see near_dedup)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    ship(docs.sparkSession)
    k1, k2 = row_key(id_col, text_col)
    texts = docs.select(F.col(id_col).alias("_id"), k1, k2, F.col(text_col).alias("_text"))
    rows = scratch(
        texts.mapInArrow(
            _signatures(width),
            f"_id {dict(docs.dtypes)[id_col]}, _k1 long, _k2 long, node long, check long, n_shingles long, signature binary",
        ),
        "signatures",
    )
    # One row of each set: the text of any document that has it serves to confirm links.
    nodes = (
        rows.where("n_shingles > 0")
        .groupBy("node", "check")
        .agg(F.min(F.struct("_k1", "_k2")).alias("row"), F.first("signature").alias("signature"))
    )
    nodes = scratch(nodes.select("node", "row._k1", "row._k2", "signature"), "nodes")
    found = near_links(nodes, texts.select("_k1", "_k2", "_text"), width, percent)
    placed = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_k2")).alias("first")
    names = placed.where("n_shingles > 0").groupBy("component").agg(first)
    own = F.col("n_shingles") == 0
    return placed.join(names, "component", "left").select(
        "_id",
        "_k1",
        "_k2",
        "n_shingles",
        F.when(own, F.col("_id")).otherwise(F.col("first._id")).alias("component_id"),
        (own | (F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_k2") == F.col("first._k2")))).alias("kept"),
    )


def near_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their shingle sets.

    One row per input row: id, n_shingles, component_id (smallest id that links reach, its own included)
    and kept (true for the one row that stays). Texts without words, null ones too, are linked with
    nothing and kept. Null ids come after all others as names of a component. Of rows with a component's
    smallest id the one with the smallest text hash stays; rows equal in id and text stay together.
    """
    labelled = _labelled(docs, id_col, text_col, width, percent)
    return labelled.select(F.col("_id").alias(id_col), "n_shingles", "component_id", "kept")


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """The rows of ``docs``, all columns, that near_dedup keeps; of rows equal in id and text only one."""
    kept = _labelled(docs, id_col, text_col, width, percent).where("kept").select("_k1", "_k2").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return (
        docs.select(*row_key(id_col, text_col), row)
        .join(kept, ["_k1", "_k2"])
        .withColumn("_nth", F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.lit(0))))
        .where("_nth = 1")
        .select("_row.*")
    )
