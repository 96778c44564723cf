"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

S(w | h) is count(h w) / count(h), or ALPHA times the score with a shorter history where h w is not in
the tables; a word alone has its share of all words. A document's log score is the sum over its words.

``score_corpus`` scores the corpus that is counted, so no n-gram is missing from the tables. Every n-gram
is exploded as its history and the word after it and goes to the hash partition of the history, which
therefore holds all that S needs: the partition counts n-grams and histories, joins both counts to
the exploded rows and sums by document; the sums of all partitions are added up. Rows travel packed by
block of documents: 64 bits of a history once for all its words in the block, 32 bits of a word, and the
number of the document. Two words after the same history have equal bits with a chance of 2 ** -32, two
histories with 2 ** -64. A history that ends a document travels with no word, so it is counted too.

Histories so frequent that they would fill a quarter of a partition are counted beforehand, with the n-grams
of all lengths; their n-grams are partitioned by themselves, or scored where they occur if they are as frequent.
There are at most ``2 / HOT_SHARE`` of them, which bounds what is broadcast. Texts shorter than a
history are n-grams of their own: a filter of ``CELLS`` bits says which n-grams to count for them.

``count_tables`` and ``score_documents`` do the same as plain tables and joins for other documents,
with backing off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tailseries.llm.common import U64, Piece, Rolling, hash_spans, mix, pieces, row_key, ship
from tailseries.llm.language_id import HashArray

ORDER, ALPHA = 3, 0.4
#: N-grams in a partition of the tables.
PARTITION = 3_000_000
HOT_SHARE = 1e-6
#: Bytes of text in a block of documents.
DOCS = 4 << 20
#: Bits of the filter of short texts; where it fills up, more n-grams are counted than are asked for.
CELLS = 1 << 23
_WORDS = Rolling(0xE7037ED1A0B428DB)
_CODEC = "zstd"


def _starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every n-gram of rows that begin at these words."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return first[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), row


def _grams(first: np.ndarray, prefix: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of rows that begin at these words."""
    at, _ = _starts(first, n)
    return _WORDS.ranges(prefix, at, at + n)


def _frequent(order: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held = [(p.first, _WORDS.prefix(mix(p.hashes))) for p in pieces(batch.column("_text"), lower=True)]
            least = max(2, int(np.ceil(share * sum(first[-1] for first, _ in held))))
            for n in range(1, order + 1):
                h = np.concatenate([np.zeros(0, U64), *[_grams(*x, n) for x in held]])
                h.sort()
                # What occurs so often stands that far from itself.
                often = np.unique(h[: max(0, len(h) - least + 1)][h[least - 1 :] == h[: max(0, len(h) - least + 1)]])
                times = np.searchsorted(h, often, "right") - np.searchsorted(h, often)
                yield pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(times)], names=["h", "n"])

    return run


def _counted(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        total = np.zeros(len(table.keys), np.int64)
        for batch in batches:
            for p in pieces(batch.column("_text"), lower=True):
                prefix = _WORDS.prefix(mix(p.hashes))
                for n in range(1, order + 1):
                    at = table.find(_grams(p.first, prefix, n))
                    total += np.bincount(at[at >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

    return run


def frequent_grams(texts: DataFrame, words: int, order: int, share: float) -> tuple[HashArray, np.ndarray]:
    """N-grams that about this share of all words begin, and exactly how often they occur.

    Candidates reach the share in some batch; those that reach half of it over such batches are at most
    2 / share and are then counted over everything.
    """
    spark = texts.sparkSession
    found = (
        texts.mapInArrow(_frequent(order, share), "h long, n long")
        .groupBy("h")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= share * words / 2)
        .select("h")
        .toArrow()
    )
    keys = found.column("h").to_numpy().view(U64)
    table = HashArray(keys, np.zeros(len(keys), np.int8))
    total = np.zeros(len(keys), np.int64)
    if len(keys):
        shared = spark.sparkContext.broadcast(table)
        for r in texts.mapInArrow(_counted(shared, order), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            total[r.i] = r.n
    return table, np.log(np.maximum(total, 1))


def _cells(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U64(0x589965CC75374CC3)) & U64(CELLS - 1)).astype(np.int64)


def _sized(order: int):
    """Numbers of words (slot -1), and the filter's words of 64 bits for texts shorter than a history."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            total, cells = 0, [np.zeros(0, np.int64)]
            for p in pieces(batch.column("_text"), lower=True, hashed=False):
                words = np.diff(p.first)
                total += len(p.starts)
                row = np.flatnonzero((words > 0) & (words < order - 1))
                if len(row):
                    own = np.flatnonzero(np.isin(p.row_of_word, row))
                    ends = np.cumsum(words[row])
                    prefix = _WORDS.prefix(mix(hash_spans(_folded(p), p.starts[own], p.ends[own])))
                    cells.append(_cells(_WORDS.ranges(prefix, ends - words[row], ends)))
            cell = np.unique(np.concatenate(cells))
            slot = np.concatenate([[-1], cell >> 6])
            bits = np.concatenate([[0], np.int64(1) << (cell & 63)])
            n = np.zeros(len(slot), np.int64)
            n[0] = total
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits), pa.array(n)], names=["slot", "bits", "n"])

    return run


def _folded(p: Piece) -> np.ndarray:
    upper = (p.data >= 65) & (p.data <= 90)
    return p.data + (upper.astype(np.uint8) << 5)


def sizes(texts: DataFrame, order: int) -> tuple[int, np.ndarray]:
    """Number of all words, and the filter of the texts shorter than a history (none without such texts)."""
    found = (
        texts.mapInArrow(_sized(order), "slot long, bits long, n long")
        .groupBy("slot")
        .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
        .toArrow()
    )
    slot, bits = found.column("slot").to_numpy(), found.column("bits").to_numpy()
    words = int(found.column("n").to_numpy().sum()) if found.num_rows else 0
    if not (slot >= 0).any():
        return words, np.zeros(0, U64)
    filled = np.zeros(CELLS >> 6, U64)
    filled[slot[slot >= 0]] = bits[slot >= 0].view(U64)
    return words, filled


@dataclass
class _Shared:
    hot: HashArray
    logs: np.ndarray
    short: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        return self.hot.find(h) if len(self.hot.keys) else np.full(len(h), -1)

    def asked(self, h: np.ndarray) -> np.ndarray:
        cell = _cells(h)
        return (self.short[cell >> 6] >> (cell & 63).astype(U64)) & U64(1) == 1


@dataclass
class _Exploded:
    """N-grams of some documents.

    history, word, mark: of every n-gram; word is 0 at a document's end; mark is twice the row, plus 1 for
    the document's first. gram, row, n, weight: n-grams partitioned by themselves. words, base: by row.
    """

    history: np.ndarray
    word: np.ndarray
    mark: np.ndarray
    gram: np.ndarray
    row: np.ndarray
    n: np.ndarray
    weight: np.ndarray
    words: np.ndarray
    base: np.ndarray

    @classmethod
    def joined(cls, parts: list[_Exploded]) -> _Exploded:
        first = np.cumsum([0] + [len(p.words) for p in parts])
        for p, f in zip(parts, first):
            p.mark, p.row = p.mark + np.uint32(2 * f), p.row + np.uint32(f)
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in cls.__dataclass_fields__])


def _exploded(p: Piece, order: int, shared: _Shared) -> _Exploded:
    prefix = _WORDS.prefix(mix(p.hashes))
    words = np.diff(p.first)
    base = np.zeros(len(words))
    alone = []

    def add(row, value):
        base[:] += np.bincount(row, weights=value, minlength=len(base))

    def by_themselves(h, row, weight):
        spot = shared.find(h)
        add(row[spot >= 0], shared.logs[spot[spot >= 0]] * weight[spot >= 0])
        h, row, weight = (x[spot < 0] for x in (h, row, weight))
        own = weight > 0
        # N-grams that only count need no row.
        rest, n = np.unique(h[~own], return_counts=True)
        alone.append((h[own], row[own], np.ones(own.sum(), np.uint32), weight[own]))
        alone.append((rest, np.zeros(len(rest), int), n, np.zeros(len(rest), int)))

    if order == 1:
        at, row = _starts(p.first, 1)
        by_themselves(_WORDS.ranges(prefix, at, at + 1), row, np.ones(len(at), int))
        history, word, mark = np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    else:
        at, row = _starts(p.first, order - 1)
        after = at + order - 1
        history = _WORDS.ranges(prefix, at, after)
        inside = after < p.first[row + 1]
        word = np.zeros(len(at), np.uint32)
        word[inside] = np.maximum(p.hashes[after[inside]] >> U64(32), U64(1)).astype(np.uint32)
        begins = at == p.first[row]
        spot = shared.find(history)
        often = np.flatnonzero(spot >= 0)
        if len(often):
            add(row[often], shared.logs[spot[often]] * (begins[often].astype(int) - inside[often]))
            often = often[inside[often]]
            by_themselves(_WORDS.ranges(prefix, at[often], at[often] + order), row[often], np.ones(len(often), int))
        mark = (2 * row + begins).astype(np.uint32)
        if (spot >= 0).any():
            history, word, mark = (x[spot < 0] for x in (history, word, mark))
    if len(shared.short):
        for n in range(1, order - 1):
            at, row = _starts(p.first, n)
            h = _WORDS.ranges(prefix, at, at + n)
            asked = shared.asked(h)
            by_themselves(h[asked], row[asked], (words[row] == n)[asked].astype(int))
    gram, row, n, weight = (np.concatenate([x[i] for x in alone]) if alone else np.zeros(0, int) for i in range(4))
    small = (x.astype(np.uint32) for x in (row, n, weight))
    return _Exploded(history, word, mark, gram.astype(U64), *small, words, base)


def _planes(*arrays: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, byte by byte, compressed: most high bytes are alike."""
    flat = np.concatenate(arrays).astype(np.uint32)
    return pa.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), _CODEC, asbytes=True)


def _of_planes(data: bytes, *counts: int) -> list[np.ndarray]:
    total = sum(counts)
    flat = np.frombuffer(pa.decompress(data, 4 * total, _CODEC, asbytes=True), np.uint8)
    values = np.ascontiguousarray(flat.reshape(4, total).T).view(np.uint32).reshape(-1)
    return np.split(values, np.cumsum(counts)[:-1])


_SCHEMA = pa.schema(
    [
        ("bucket", pa.int32()),
        ("unit", pa.int64()),
        ("histories", pa.int32()),
        ("grams", pa.int32()),
        ("alone", pa.int32()),
        ("numbers", pa.binary()),
        ("low", pa.binary()),
        ("words", pa.binary()),
        ("keys", pa.binary()),
        ("ids", pa.list_(pa.int64())),
        ("n_words", pa.binary()),
        ("base", pa.binary()),
    ]
)
_BLOCK = (
    "bucket int, unit long, histories int, grams int, alone int, numbers binary, low binary, words binary, keys binary, "
    "ids array<bigint>, n_words binary, base binary"
)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets)) >> U64(32)


def _rows(x: _Exploded, ids: list, unit: int, buckets: int) -> Iterator[tuple]:
    """Packed rows of a block for the partitions of the tables; one of them carries the ids."""
    by = np.argsort(x.history)
    history, word, mark = x.history[by], x.word[by], x.mark[by]
    new = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]])[: len(history)])
    distinct, times = history[new], np.diff(np.append(new, len(history)))
    by = np.argsort(x.gram)
    gram, row, n, weight = x.gram[by], x.row[by], x.n[by], x.weight[by]
    cut = np.searchsorted(_bucket_of(distinct, buckets), np.arange(buckets + 1))
    cut_gram = np.searchsorted(_bucket_of(gram, buckets), np.arange(buckets + 1))
    places = np.append(new, len(history))
    home = unit % buckets
    for b in np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_gram) > 0) | (np.arange(buckets) == home)):
        lo, hi, glo, ghi = cut[b], cut[b + 1], cut_gram[b], cut_gram[b + 1]
        h = distinct[lo:hi]
        high = (h >> U64(40)).astype(np.int64)
        inner = slice(places[lo], places[hi])
        yield (
            int(b),
            unit,
            int(hi - lo),
            int(places[hi] - places[lo]),
            int(ghi - glo),
            _planes(np.diff(high, prepend=0), times[lo:hi], mark[inner], row[glo:ghi], n[glo:ghi], weight[glo:ghi]),
            np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(),
            word[inner].tobytes(),
            gram[glo:ghi].tobytes(),
            ids if b == home else None,
            x.words.astype(np.int64).tobytes() if b == home else None,
            x.base.tobytes() if b == home else None,
        )


def _explode(broadcast, order: int, buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        shared = broadcast.value
        # A unit is a block of documents; its name is the same whenever it is computed from the same rows.
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("_id")
            parts, start, filled = [], 0, 0
            for p in pieces(batch.column("_text"), lower=True):
                parts.append(_exploded(p, order, shared))
                filled += len(p.data)
                if filled >= size or p.hi == batch.num_rows:
                    unit += 1
                    rows = _rows(_Exploded.joined(parts), ids[start : p.hi].to_pylist(), unit, buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                    parts, start, filled = [], p.hi, 0

    return run


def _times(keys: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Logarithm of how often every key is there, and the keys' ranks."""
    by = np.argsort(keys)
    ordered = keys[by]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]
    begins = np.flatnonzero(new)
    total = np.diff(np.append(begins, len(keys))) if n is None else np.add.reduceat(n[by].astype(np.int64), begins) if len(begins) else begins
    del ordered
    rank = np.empty(len(keys), np.int32)
    rank[by] = np.cumsum(new, dtype=np.int32) - 1
    del by
    return np.log(total)[rank] if len(keys) else np.zeros(0), rank


def _count_and_sum(table: pa.Table) -> pa.Table:
    """Counts of a partition's n-grams and histories, joined to the exploded n-grams and summed by document."""
    history, times, mark, row, n, weight = ([] for _ in range(6))
    sizes = [table.column(c).to_pylist() for c in ("histories", "grams", "alone")]
    for h, g, a, numbers, low in zip(*sizes, table.column("numbers").to_pylist(), table.column("low").to_pylist()):
        parts = _of_planes(numbers, h, h, g, a, a, a)
        key = np.zeros((h, 8), np.uint8)
        key[:, :5] = np.frombuffer(low, np.uint8).reshape(h, 5)
        history.append(key.view(U64).reshape(-1) | (np.cumsum(parts[0], dtype=U64) << U64(40)))
        for held, part in zip((times, mark, row, n, weight), parts[1:]):
            held.append(part)
    word = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint32)
    mark, row, weight = np.concatenate(mark), np.concatenate(row), np.concatenate(weight)
    history = np.repeat(np.concatenate(history), np.concatenate(times))
    log_h, rank = _times(history)
    del history
    key = rank.astype(np.int64)
    del rank
    key <<= 32
    key |= word
    log_g, _ = _times(key)
    del key
    inside = word > 0
    log_h *= (mark & 1).astype(np.int8) - inside
    value = np.where(inside, log_g, 0)
    value += log_h
    del log_g, log_h
    gram = np.frombuffer(b"".join(table.column("keys").to_pylist()), U64)
    alone = _times(gram, np.concatenate(n))[0] * weight
    mark >>= 1
    rows, sums, at, at_alone = [], [], 0, 0
    for g, a in zip(*sizes[1:]):
        doc = np.concatenate([mark[at : at + g], row[at_alone : at_alone + a]])
        total = np.bincount(doc, weights=np.concatenate([value[at : at + g], alone[at_alone : at_alone + a]]))
        keep = np.flatnonzero(total)
        rows.append(keep.astype(np.uint32).tobytes())
        sums.append(total[keep].tobytes())
        at, at_alone = at + g, at_alone + a
    kept = table.select(["unit", "bucket", "ids", "n_words", "base"])
    return kept.append_column("rows", pa.array(rows, pa.binary())).append_column("sums", pa.array(sums, pa.binary()))


def _add_up(table: pa.Table) -> pa.Table:
    """The sums of all partitions for one block of documents."""
    table = table.sort_by("bucket")
    home = next(i for i, x in enumerate(table.column("n_words").to_pylist()) if x is not None)
    total = np.frombuffer(table.column("base")[home].as_py(), np.float64).copy()
    for rows, sums in zip(table.column("rows").to_pylist(), table.column("sums").to_pylist()):
        total[np.frombuffer(rows, np.uint32)] += np.frombuffer(sums, np.float64)
    words = np.frombuffer(table.column("n_words")[home].as_py(), np.int64)
    return pa.table({"_id": table.column("ids")[home].values, "n_words": words, "total": total})


def score_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Log score of every document by the n-grams of all documents: id, n_words, log_score, mean_log_score.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A to Z folded. One row per input row. Texts without words,
    null ones too, have log_score 0 and no mean. Repeated rows count as often as they occur. Ids must
    be whole numbers, others are an error; null ids stay null. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number")
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    words, short = sizes(texts.select("_text"), order)
    share = max(HOT_SHARE, PARTITION / (4 * max(words, 1)))
    if share < 0.5:
        hot, logs = frequent_grams(texts.select("_text"), words, order, share)
    else:
        hot, logs = HashArray(np.zeros(0, U64), np.zeros(0, np.int8)), np.zeros(0)
    shared = spark.sparkContext.broadcast(_Shared(hot, logs, short))
    buckets = words // PARTITION + 1
    sums = (
        texts.mapInArrow(_explode(shared, order, buckets, DOCS), _BLOCK)
        # One partition of the tables in a task, at any size.
        .repartitionById(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(
            _count_and_sum,
            "unit long, bucket int, ids array<bigint>, n_words binary, base binary, rows binary, sums binary",
        )
        .groupBy("unit")
        .applyInArrow(_add_up, "_id long, n_words long, total double")
    )
    # Of longer histories than none, only the first word's is all words.
    whole = F.col("n_words") if order == 1 else F.lit(1)
    log_score = F.when(F.col("n_words") > 0, F.col("total") - whole * F.log(F.lit(float(max(words, 1))))).otherwise(0.0)
    return sums.select(
        F.col("_id").cast(kind).alias(id_col),
        "n_words",
        log_score.alias("log_score"),
        F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"),
    )


def _positions(docs: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """Every word's place and the n-grams that end there, longest first, as words joined by spaces."""
    words = F.filter(
        F.split(F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"),
        lambda w: w != "",
    )
    placed = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("_id"), words.alias("w"))
    placed = placed.select("_id", "_k1", "_k2", "w", F.posexplode("w").alias("i", "_"))
    grams = [
        F.when(F.col("i") >= n - 1, F.concat_ws(" ", F.slice("w", F.col("i") - n + 2, F.lit(n)))).alias(f"g{n}")
        for n in range(1, order + 1)
    ]
    return placed.select("_id", "_k1", "_k2", "i", *grams)


def count_tables(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """gram (words joined by spaces), n: n-grams of 1 to ``order`` words, and as gram '' the number of words."""
    placed = _positions(docs, id_col, text_col, order)
    grams = placed.select(F.explode(F.array(F.lit(""), *[f"g{n}" for n in range(1, order + 1)])).alias("gram"))
    return grams.where("gram IS NOT NULL").groupBy("gram").agg(F.count("*").alias("n"))


def score_documents(
    docs: DataFrame, tables: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER
) -> DataFrame:
    """Log scores of any documents by given tables, backing off: id, n_words, log_score.

    A word that the tables lack counts as seen once. One row per input row: texts without words, null ones too,
    have 0 words and log_score 0, and rows equal in id and text are scored once and given the same score.
    Null ids stay null, ids may be of any type, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col))
    placed = _positions(docs, id_col, text_col, order).drop("_id").dropDuplicates(["_k1", "_k2", "i"])
    score = None
    for n in range(order, 0, -1):
        history = F.lit("") if n == 1 else F.regexp_replace(F.col(f"g{n}"), r" [^ ]*$", "")
        placed = (
            placed.withColumn("h", history)
            .join(tables.select(F.col("gram").alias(f"g{n}"), F.col("n").alias(f"n{n}")), f"g{n}", "left")
            .join(tables.select(F.col("gram").alias("h"), F.col("n").alias(f"h{n}")), "h", "left")
            .drop("h")
        )
    for n in range(1, order + 1):
        seen = F.log(F.col(f"n{n}") / F.col(f"h{n}"))
        if n == 1:
            score = F.coalesce(seen, -F.log(F.coalesce("h1", F.lit(1))))
        else:
            # A document's first words have no longer history: no backing off there.
            score = F.when(F.col("i") < n - 1, score).otherwise(F.coalesce(seen, F.log(F.lit(ALPHA)) + score))
    scored = placed.groupBy("_k1", "_k2").agg(F.count("*").alias("n_words"), F.sum(score).alias("log_score"))
    return rows.join(scored, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce("log_score", F.lit(0.0)).alias("log_score"),
    )
