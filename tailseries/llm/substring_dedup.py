"""Substring dedup: a count-min sketch rules out most windows, the rest is grouped exactly.

A window is ``window`` consecutive words. Its *anchors* are the smallest hashes of ``GRAM`` words
in it; equal windows have equal anchors at equal places, so a window occurs at most as often as
its anchor, and there is one anchor in about 14 words. Each partition counts its anchors in a
sketch of two rows, kept as the cells it touched; sketches are merged by block of cells, and every
estimate is at least the true count. The second pass keeps windows whose anchor is estimated to
occur twice or more and groups them by anchor and window hash (128 bits together). A sketch that
is too narrow for the input lets more windows through to the grouping and loses none.

Only the merged sketch is broadcast: two bits per cell pair, at most ``2 * 2**MAX_LOG / 8`` bytes
(32 MB) at any input size. Windows go to buckets by anchor, as 8 bytes each. The windows of anchors
estimated to occur ``HOT`` times or more are salted: each salted part decides what it can and hands
on one window per distinct content, which a second grouping decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tailseries.llm.common import (
    U64,
    Piece,
    Rolling,
    grouped,
    mix,
    packed,
    pieces,
    row_key,
    scratch,
    ship,
    text_bytes,
    unpacked,
)

GRAM = 8
MIN_LOG, MAX_LOG, BLOCK_LOG = 18, 27, 18
HOT, SALTS = 1000, 64
BUCKET_BYTES = 12 << 20
_ROWS = (U64(0x8CB92BA72F3D8DD7), U64(0x2545F4914F6CDD1D))
_WORDS = Rolling(0xDA942042E4DD58B5)
_RUN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("anchor", "<u8"), ("start", "<i4"), ("n", "<i4")])
_SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values."""
    if len(a) < width:
        return a[:0]
    done = 1
    while done * 2 <= width:
        a = op(a[:-done], a[done:])
        done *= 2
    return op(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


class _Windows:
    """Window hashes of a piece; ``least`` is each window's anchor hash, ``at`` its word number."""

    def __init__(self, p: Piece, window: int, gram: int):
        self.prefix = _WORDS.prefix(mix(p.hashes))
        n = len(p.hashes)
        starts = np.arange(max(0, n - window + 1))
        last = np.repeat(p.first[1:], np.diff(p.first))
        valid = starts + window <= last[: len(starts)]
        self.grams = _WORDS.ranges(self.prefix, np.arange(max(0, n - gram + 1)), np.arange(gram, n + 1))
        self.width = window - gram + 1
        self.all_least = _sliding(self.grams, self.width, np.minimum)
        self.all_least = np.where(valid, self.all_least, U64(0))
        self.valid = valid
        self.window = window

    def anchors(self) -> np.ndarray:
        """Every place in a window whose hash is that window's least, equal ones too."""
        pad = np.zeros(self.width - 1, U64)
        most = _sliding(np.concatenate([pad, self.all_least, pad]), self.width, np.maximum)
        return self.grams[most[: len(self.grams)] == self.grams] if len(self.grams) else self.grams

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return _WORDS.ranges(self.prefix, at, at + self.window)


def _cells(anchors: np.ndarray, row: int, log: int) -> np.ndarray:
    return (mix(anchors ^ _ROWS[row]) >> U64(64 - log)).astype(np.int64)


def _block_log(log: int) -> int:
    return min(BLOCK_LOG, log)


def _partition_sketch(text: str, window: int, gram: int, log: int):
    block_log = _block_log(log)
    per_row = 1 << (log - block_log)
    schema = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def emit(held: list[np.ndarray]):
        for row in (0, 1):
            cells, counts = np.unique(_cells(np.concatenate(held), row, log), return_counts=True)
            blocks = cells >> block_log
            sizes = np.bincount(blocks, minlength=per_row)
            keep = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((keep + row * per_row).astype(np.int32)),
                    packed((cells & ((1 << block_log) - 1)).astype(np.uint32), sizes[keep]),
                    packed(counts.astype(np.uint32), sizes[keep]),
                ],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            for p in pieces(batch.column(text)):
                held.append(_Windows(p, window, gram).anchors())
                n += len(held[-1])
                if n > 4_000_000:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _merge_block(log: int):
    def run(table: pa.Table) -> pa.Table:
        cells = unpacked(table.column("cells"), np.uint32)
        counts = unpacked(table.column("counts"), np.uint32)
        total = np.bincount(cells, weights=counts, minlength=1 << _block_log(log))
        return pa.table(
            {
                "block": table.column("block").slice(0, 1),
                "twice": pa.array([np.packbits(total >= 2).tobytes()], pa.binary()),
                "hot": pa.array([np.packbits(total >= HOT).tobytes()], pa.binary()),
            }
        )

    return run


class _Sketch:
    """The merged sketch: a bit per cell for two or more, and one for hot. Its size follows from ``log`` alone."""

    def __init__(self, rows, log: int):
        self.log = log
        block_log = _block_log(log)
        per_row = 1 << (log - block_log)
        self.bits = {kind: np.zeros((2, (1 << log) >> 3), np.uint8) for kind in ("twice", "hot")}
        for r in rows:
            row, block = divmod(r["block"], per_row)
            size = (1 << block_log) >> 3
            for kind, bits in self.bits.items():
                bits[row, block * size : (block + 1) * size] = np.frombuffer(r[kind], np.uint8)

    def _set(self, kind: str, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for row in (0, 1):
            c = _cells(anchors, row, self.log)
            out &= (self.bits[kind][row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return out

    def twice(self, anchors: np.ndarray) -> np.ndarray:
        return self._set("twice", anchors)

    def often(self, anchors: np.ndarray) -> np.ndarray:
        return self._set("hot", anchors)


_PART = "bucket int, salt int, runs binary, hashes binary"
_PART_ARROW = pa.schema(
    [("bucket", pa.int32()), ("salt", pa.int32()), ("runs", pa.binary()), ("hashes", pa.binary())]
)


def _candidates(sketch, text: str, window: int, gram: int, buckets: int):
    """Windows with a repeated anchor, in runs of one anchor, by bucket of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]):
        s = sketch.value
        for batch in batches:
            k1 = batch.column("_k1").to_numpy()
            k2 = batch.column("_k2").to_numpy()
            for p in pieces(batch.column(text)):
                w = _Windows(p, window, gram)
                least, n = w.all_least, len(w.all_least)
                if not n:
                    continue
                begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                lengths = np.diff(np.append(begins, n))
                valid = w.valid[begins]
                begins, lengths = begins[valid], lengths[valid]
                anchors = least[begins]
                keep = s.twice(anchors)
                begins, lengths, anchors = begins[keep], lengths[keep], anchors[keep]
                if not len(begins):
                    continue
                row = np.searchsorted(p.first, begins, "right") - 1
                runs = np.empty(len(begins), _RUN)
                runs["k1"], runs["k2"] = k1[p.lo + row], k2[p.lo + row]
                runs["anchor"], runs["start"], runs["n"] = anchors, begins - p.first[row], lengths
                bucket = (mix(anchors) % U64(buckets)).astype(np.int64)
                salt = np.where(s.often(anchors), 1 + mix(runs["k1"].astype(U64)) % U64(SALTS), U64(0))
                code = bucket * (SALTS + 1) + salt.astype(np.int64)
                order = np.argsort(code, kind="stable")
                code, runs, begins, lengths = code[order], runs[order], begins[order], lengths[order]
                codes, where, sizes = np.unique(code, return_index=True, return_counts=True)
                at = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(
                    lengths.sum()
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((codes // (SALTS + 1)).astype(np.int32)),
                        pa.array((codes % (SALTS + 1)).astype(np.int32)),
                        packed(runs, sizes),
                        packed(w.hashes(at), np.add.reduceat(lengths, where)),
                    ],
                    schema=_PART_ARROW,
                )

    return run


def _decide(window: int, handed_on: bool):
    """Which windows of a bucket occur twice: spans of words to remove (salt -1), by document.

    A salted part also hands on its distinct windows, once (salt 0) or as already repeated (salt 1).
    """

    def run(table: pa.Table) -> pa.Table:
        runs = unpacked(table.column("runs"), _RUN)
        hashes = unpacked(table.column("hashes"), U64)
        salts = table.column("salt").to_numpy()
        bucket = table.column("bucket")[0].as_py()
        lengths = runs["n"].astype(np.int64)
        anchor = np.repeat(runs["anchor"], lengths)
        order = np.lexsort((anchor, hashes))
        h, a = hashes[order], anchor[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])])
        group = np.cumsum(new) - 1
        times = np.bincount(group)
        if handed_on:
            done = np.repeat(salts, [len(r.as_py()) // _RUN.itemsize for r in table.column("runs")])
            times = times + np.bincount(group, weights=np.repeat(done, lengths)[order]).astype(np.int64)
        repeated = np.empty(len(h), bool)
        repeated[order] = (times >= 2)[group]
        within = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        start = np.repeat(runs["start"], lengths) + within
        run_of = np.repeat(np.arange(len(runs)), lengths)
        hit, first = np.flatnonzero(repeated), 0
        out = []
        if len(hit):
            # Consecutive repeated windows of a run are one span.
            cut = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(run_of[hit]) != 0)])
            lo, hi = hit[cut], hit[np.append(np.flatnonzero(cut)[1:] - 1, len(hit) - 1)]
            spans = np.empty(len(lo), _SPAN)
            spans["start"], spans["end"] = start[lo], start[hi] + window
            owner = runs[run_of[lo]]
            order2 = np.lexsort((spans["start"], owner["k2"], owner["k1"]))
            owner, spans = owner[order2], spans[order2]
            first = np.flatnonzero(
                np.concatenate([[True], (owner["k1"][1:] != owner["k1"][:-1]) | (owner["k2"][1:] != owner["k2"][:-1])])
            )
            sizes = np.diff(np.append(first, len(owner)))
            out.append(_rows(bucket, -1, owner["k1"][first], owner["k2"][first], packed(spans, sizes)))
        if not handed_on and salts[0] > 0:
            one = order[new]
            for flag in (0, 1):
                chosen = one[(times[group[new]] >= 2) == bool(flag)]
                if len(chosen):
                    single = runs[run_of[chosen]].copy()
                    single["start"], single["n"] = start[chosen], 1
                    out.append(
                        _rows(
                            bucket, flag, [0], [0], packed(hashes[chosen], [len(chosen)]), packed(single, [len(single)])
                        )
                    )
        return pa.concat_tables(out) if out else _EMPTY

    return run


_DECIDED = "bucket int, salt int, _k1 long, _k2 long, spans binary, runs binary"
_DECIDED_ARROW = pa.schema(
    [
        ("bucket", pa.int32()),
        ("salt", pa.int32()),
        ("_k1", pa.int64()),
        ("_k2", pa.int64()),
        ("spans", pa.binary()),
        ("runs", pa.binary()),
    ]
)
_EMPTY = _DECIDED_ARROW.empty_table()


def _rows(bucket: int, salt: int, k1, k2, spans: pa.Array, runs: pa.Array | None = None) -> pa.Table:
    n = len(spans)
    return pa.table(
        [
            pa.array(np.full(n, bucket, np.int32)),
            pa.array(np.full(n, salt, np.int32)),
            pa.array(np.asarray(k1, np.int64)),
            pa.array(np.asarray(k2, np.int64)),
            spans,
            pa.nulls(n, pa.binary()) if runs is None else runs,
        ],
        schema=_DECIDED_ARROW,
    )


def repeated_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, max_log: int = MAX_LOG
) -> DataFrame:
    """Spans of words covered by repeated windows: _k1, _k2 (see row_key), spans (int32 start, end pairs)."""
    spark = ship(docs.sparkSession)
    gram = min(GRAM, window)
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_text"))
    size = text_bytes(docs, text_col)
    # Sixteen cells for each expected anchor; four bytes a word is less than texts have.
    log = min(max_log, max(MIN_LOG, (size * 16 // (6 * 14)).bit_length()))
    merged = (
        texts.select("_text")
        .mapInArrow(_partition_sketch("_text", window, gram, log), "block int, cells binary, counts binary")
        .groupBy("block")
        .applyInArrow(_merge_block(log), "block int, twice binary, hot binary")
    )
    sketch = spark.sparkContext.broadcast(_Sketch(merged.toLocalIterator(), log))
    buckets = size // BUCKET_BYTES + 1
    first = scratch(
        texts.mapInArrow(_candidates(sketch, "_text", window, gram, buckets), _PART)
        .groupBy("bucket", "salt")
        .applyInArrow(_decide(window, False), _DECIDED),
        "windows",
    )
    second = (
        first.where("salt >= 0")
        .select("bucket", "salt", "runs", F.col("spans").alias("hashes"))
        .groupBy("bucket")
        .applyInArrow(_decide(window, True), _DECIDED)
    )
    return first.where("salt < 0").unionByName(second).select("_k1", "_k2", "spans")


def _cut(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        spans = batch.column("_spans")
        ids = batch.column("_id")
        for p in pieces(batch.column("_text")):
            mine = spans.slice(p.lo, p.hi - p.lo)
            n = len(p.starts)
            cover = np.zeros(n + 1, np.int64)
            for r in np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False)):
                for part in mine[r].as_py():
                    s = np.frombuffer(part, _SPAN)
                    np.add.at(cover, p.first[r] + s["start"], 1)
                    np.add.at(cover, p.first[r] + s["end"], -1)
            keep = np.cumsum(cover[:-1]) == 0
            rows = p.hi - p.lo
            words = np.diff(p.first)
            before = np.concatenate([[0], np.cumsum(keep)])[p.first]
            kept = np.diff(before)
            # Each kept word with the byte after it, which is white space; not after a row's last.
            last = np.zeros(n, bool)
            index = np.flatnonzero(keep)
            last[index[before[1:][kept > 0] - 1]] = True
            mark = np.zeros(len(p.data) + 2, np.int8)
            mark[p.starts[keep]] += 1
            np.add.at(mark, p.ends[keep] + ~last[keep], -1)
            taken = np.cumsum(mark[: len(p.data)], dtype=np.int8) > 0
            data = p.data[taken]
            gaps = np.zeros(len(p.data), bool)
            gaps[p.ends[keep & ~last]] = True
            data[gaps[taken]] = 32
            ends = np.concatenate([[0], np.cumsum(taken)])[p.offsets].astype(np.int32)
            view = memoryview(data)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(p.lo, rows),
                    pa.array(words),
                    pa.array(words - kept),
                    pa.array(digests, pa.string()),
                    pa.StringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(data)),
                ],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def substring_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, max_log: int = MAX_LOG
) -> DataFrame:
    """Remove every word covered by a window of words that also starts anywhere else in the table.

    One row per input row: the id, n_words, n_removed, kept_text (kept words joined by one space)
    and its SHA-256 kept_sha256. All copies of a repeated window go, its own document's included;
    windows are judged on the input. A null text is empty: no words, kept_text ''. Texts shorter
    than the window keep all words. Repeated rows and rows with a null id are rows like others, so
    two equal rows remove each other's windows. Other columns are not read. Spans are joined to the
    texts by id and text hash, never by position.
    """
    spans = (
        repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, max_log=max_log)
        .groupBy("_k1", "_k2")
        .agg(F.collect_list("spans").alias("_spans"))
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *row_key(id_col, text_col))
    return (
        texts.join(spans, ["_k1", "_k2"], "left")
        .select("_id", "_text", "_spans")
        .mapInArrow(
            _cut, f"id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string, kept_text string"
        )
        .withColumnRenamed("id", id_col)
    )
