"""Repeated passages: a count-min prefilter over window anchors, then an exact grouping of the windows left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from careflow.llm.text import WordHash, grams, longs, mix, raw, slide

NO_ID = 2**63 - 1
SECOND = 0xD6E8FEB86659FD93
FLUSH_WORDS = 3_000_000
REPLY = pa.schema([("shard", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
REPLY_SQL = "shard int, kind byte, data binary"
#: A document with a sketch cell or the start of a window, and a window to be grouped.
CELL = np.dtype([("id", "<i8"), ("tid", "<u4"), ("cell", "<u4")])
PLACE = np.dtype([("id", "<i8"), ("tid", "<u4"), ("at", "<u4"), ("a", "<u8"), ("b", "<u4")])


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the smallest hash of its runs of half the length, and the places of all such runs by hash.

    A window that occurs k times brings k places of its smallest run, so the count of the run is never below that of the window.
    """
    half = window // 2
    runs = grams(words, half)
    span = window - half + 1
    least = slide(runs, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    most = slide(np.concatenate([edge, least, edge]), span, np.maximum)
    return least, runs[most == runs]


class Batch:
    """Documents of a task gathered up to `FLUSH_WORDS` words, as flat arrays."""

    def __init__(self, window: int):
        self.window, self.hashes = window, WordHash()
        self.clear()

    def clear(self) -> None:
        self.n, self.id, self.tid, self.keys, self.more = 0, [], [], [], []

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(k) for k in self.keys]
        return np.repeat(np.array(self.id, np.int64), sizes), np.repeat(np.array(self.tid, np.uint32), sizes), np.concatenate(self.keys)


def _rows(kind: int, shard: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """A row for each shard with its records as bytes; `data` is a record array."""
    order = np.argsort(shard, kind="stable")
    shard, data = shard[order], data[order]
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
    pieces = [p.tobytes() for p in np.split(data, at[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int8)), pa.array(pieces, pa.binary())], schema=REPLY)


def _answers(ids: np.ndarray, tids: np.ndarray, values: np.ndarray, shards: int) -> pa.RecordBatch:
    """What documents are told, addressed to the shards that gather the answers of a document."""
    told = np.zeros(len(ids), CELL)
    told["id"], told["tid"], told["cell"] = ids, tids, values
    return _rows(1, (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int32), told)


def _gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with all it was told."""
    held = [np.frombuffer(d, CELL) for part in parts for d in part.column(2).to_pylist()]
    if not held:
        return
    data = np.concatenate(held)
    data = data[np.lexsort((data["tid"], data["id"]))]
    at = np.flatnonzero(np.r_[True, (data["id"][1:] != data["id"][:-1]) | (data["tid"][1:] != data["tid"][:-1])])
    pieces = [p.tobytes() for p in np.split(np.ascontiguousarray(data["cell"]), at[1:])]
    for start in range(0, len(at), 1000):
        some = slice(start, start + 1000)
        yield pa.RecordBatch.from_arrays([pa.array(data["id"][at[some]]), pa.array(data["tid"][at[some]].astype(np.int64)), pa.array(pieces[some], pa.binary())],
                                         names=["id", "tid", "told"])


def _ask_cells(window: int, shards: int):
    """First pass: what each partition adds to the sketch, by shard. Runs repeated within the batch are answered here, and sent once for all."""
    def flush(b: Batch) -> Iterator[pa.RecordBatch]:
        if not b.keys:
            return
        ids, tids, keys = b.flat()
        shard, cell = (keys % np.uint64(shards)).astype(np.int32), (keys // np.uint64(shards)).astype(np.uint32)
        _, first, back, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        many = n[back] > 1
        yield _answers(ids[many], tids[many], cell[many], shards)
        once = np.zeros(len(first), CELL)
        once["id"], once["tid"], once["cell"] = ids[first], tids[first], cell[first]
        once["id"][n > 1] = NO_ID - 1
        yield _rows(0, shard[first], once)
        b.clear()

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Batch(window)
        for part in parts:
            for i, tid, text in zip(longs(part.column(0)).tolist(), longs(part.column(1)).tolist(), raw(part.column(2))):
                words = text.split() if text else []
                if len(words) >= window:
                    b.id.append(i)
                    b.tid.append(tid)
                    b.keys.append(anchors(b.hashes.of(words), window)[1])
                    b.n += len(words)
                    if b.n >= FLUSH_WORDS:
                        yield from flush(b)
        yield from flush(b)

    return ask


def _sketch(shards: int):
    """Add up the partitions' counters of a shard's count-min sketch (two rows); tell each document its runs with an estimate over one."""
    def reply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for part in parts:
            kind = part.column(1).to_numpy()
            yield part.filter(pa.array(kind == 1))
            held += [(s, np.frombuffer(d, CELL)) for s, d, k in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), kind) if k == 0]
        if not held:
            return
        data = np.concatenate([d for _, d in held])
        place = data["cell"].astype(np.uint64) * np.uint64(shards) + np.repeat(np.array([s for s, _ in held], np.uint64), [len(d) for _, d in held])
        weight = np.where(data["id"] == NO_ID - 1, 2, 1)
        width = 1 << max(10, int(2 * len(data)).bit_length())
        estimate = np.full(len(data), 2**31)
        for row in (1, 2):
            slot = (mix(place * np.uint64(2) + np.uint64(row * SECOND % 2**63)) % np.uint64(width)).astype(np.int64)
            estimate = np.minimum(estimate, np.bincount(slot, weights=weight, minlength=width)[slot])
        again = (estimate > 1) & (data["id"] != NO_ID - 1)
        yield _answers(data["id"][again], data["tid"][again], data["cell"][again], shards)

    return reply


def _split_firsts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window, and all places but those; a place that is given twice, by a repeated row, is one place."""
    data = data[np.lexsort((data["at"], data["tid"], data["id"], data["b"], data["a"]))]
    new = np.r_[True, (data["a"][1:] != data["a"][:-1]) | (data["b"][1:] != data["b"][:-1])][: len(data)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(data)), 0))
    again = np.zeros(len(data), bool)
    for name in ("id", "tid", "at"):
        again |= data[name] != data[name][start]
    return data[new], data[again]


def _ask_places(window: int, shards: int):
    """Second pass: hashes of the windows whose anchor is estimated repeated, by shard. In a batch only the first of equal windows is sent on."""
    def flush(b: Batch) -> Iterator[pa.RecordBatch]:
        if not b.keys:
            return
        ids, tids, a = b.flat()
        second, at = np.concatenate([m[0] for m in b.more]), np.concatenate([m[1] for m in b.more])
        data = np.zeros(len(a), PLACE)
        for name, values in (("id", ids), ("tid", tids), ("at", at), ("a", a), ("b", second)):
            data[name] = values
        first, again = _split_firsts(data)
        yield _answers(again["id"], again["tid"], again["at"], shards)
        shard = (mix(first["a"]) % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((first["at"], first["id"], shard))
        yield _rows(0, shard[order], first[order])
        b.clear()

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Batch(window)
        for part in parts:
            for i, tid, text, cells in zip(longs(part.column(0)).tolist(), longs(part.column(1)).tolist(), raw(part.column(2)), part.column(3).to_pylist()):
                words = b.hashes.of(text.split())
                least, _ = anchors(words, window)
                wanted = np.frombuffer(cells, np.uint32)
                at = np.flatnonzero(np.isin((least // np.uint64(shards)).astype(np.uint32), wanted))
                if len(at):
                    b.id.append(i)
                    b.tid.append(tid)
                    b.keys.append(grams(words, window)[at])
                    b.more.append(((grams(words, window, SECOND)[at] >> np.uint64(32)).astype(np.uint32), at.astype(np.uint32)))
                    b.n += len(at)
                    if b.n >= FLUSH_WORDS:
                        yield from flush(b)
        yield from flush(b)

    return ask


def _group(shards: int):
    """Group equal windows of a shard; tell each document which of its windows start earlier elsewhere."""
    def reply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for part in parts:
            kind = part.column(1).to_numpy()
            yield part.filter(pa.array(kind == 1))
            held += [np.frombuffer(d, PLACE) for d, k in zip(part.column(2).to_pylist(), kind) if k == 0]
        if not held:
            return
        _, again = _split_firsts(np.concatenate(held))
        yield _answers(again["id"], again["tid"], again["at"], shards)

    return reply


def _cut(window: int):
    """Take the covered words out of each text; the columns after the fifth pass through."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, removed, digests, kept = [], [], [], []
            for text, copy, starts in zip(raw(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist()):
                words = text.split() if text else []
                left = words
                if copy and len(words) >= window:
                    left = []
                elif starts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(np.frombuffer(starts, np.uint32))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                joined = b" ".join(left)
                n.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(text if len(words) == len(left) else joined)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()),
                 *part.columns[5:]], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text", *part.schema.names[5:]])

    return cut


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shards: int | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Remove every word covered by a run of `window` words that also starts earlier: in a smaller id, or before in the same text.

    Words are runs of non-blank characters, unchanged. Returns a row for each input row: `id_col`, `n_words`, `n_removed`,
    `kept_sha256` (of the kept words joined by one blank), `kept_text` (those words; the text itself where nothing is removed)
    and the columns named in `keep`. Runs are judged on the input.

    * First pass: each window is stood for by its anchor, the smallest hash among its runs of half the length. The
      partitions' counts of anchors are added up in a count-min sketch that is split over `shards` (the shuffle setting, if
      not given); a count is never too low, so no repeated window is lost.
    * Second pass: only windows whose anchor is estimated repeated are grouped, by a 96-bit hash of the window.
    * Both passes answer what repeats inside a batch of a task on the spot and send one record of it, so a passage that
      a third of the documents share costs each shard one record a batch.
    * Whole copies of an earlier text are found by their hash and need no windows.
    * Texts are shuffled once, by id, for the second pass and the removal.

    A null text has no words. Null ids come last, after all others. Rows that share an id and a text are one document and get
    the same answer; rows that share an id but not the text come in the order of a hash of the text. Columns outside `keep`
    are ignored. An empty table gives no rows.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tid: Column = F.shiftrightunsigned(F.xxhash64(text), 32)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), tid.alias("tid")]
    more = [f"keep_{i}" for i in range(len(keep))]
    keyed = docs.select(*key, text.alias("text"), *[F.col(c).alias(m) for c, m in zip(keep, more)])

    asked = docs.select(*key, text.alias("text")).mapInArrow(_ask_cells(window, shards), REPLY_SQL)
    told = asked.repartitionById(shards, "shard").mapInArrow(_sketch(shards), REPLY_SQL)
    cells = told.repartitionById(shards, "shard").mapInArrow(_gather, "id long, tid long, told binary").withColumnRenamed("told", "cells")

    marks = docs.select(*key, F.unhex(F.md5(text)).alias("digest"))
    firsts = marks.groupBy("digest").agg(F.min(F.struct("id", "tid")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = marks.join(firsts, "digest").where(F.struct("id", "tid") > F.col("first")).select("id", "tid").distinct().withColumn("copy", F.lit(True))

    by_key = keyed.repartition("id", "tid")
    known = by_key.join(cells, ["id", "tid"], "left").join(copies, ["id", "tid"], "left").where("copy is null and cells is not null")
    places = known.select("id", "tid", "text", "cells", *more).mapInArrow(_ask_places(window, shards), REPLY_SQL)
    found = places.repartitionById(shards, "shard").mapInArrow(_group(shards), REPLY_SQL)
    found = found.repartitionById(shards, "shard").mapInArrow(_gather, "id long, tid long, told binary").withColumnRenamed("told", "starts")

    whole = by_key.join(copies, ["id", "tid"], "left").join(found, ["id", "tid"], "left").select("id", "tid", "text", "copy", "starts", *more)
    fields = [StructField("id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()),
              StructField("kept_text", StringType()), *[StructField(m, docs.schema[c].dataType) for c, m in zip(keep, more)]]
    out = whole.mapInArrow(_cut(window), StructType(fields))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text",
                      *[F.col(m).alias(c) for c, m in zip(keep, more)])
