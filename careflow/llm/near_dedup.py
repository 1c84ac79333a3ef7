"""Near-duplicate documents: MinHash signatures, banding, verification on full sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.components import components
from careflow.llm.text import WordHash, grams, mix, raw
from careflow.session import cut_lineage

SIGNED = "id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"
CHUNK = 256
#: Bits of the parity sketch of a set.
PARITY = 2048


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; the whole text is one run if it has fewer words."""
    if not len(words):
        return words
    return np.unique(grams(words, min(size, len(words))) + np.uint64(min(size, len(words))))


def _word_hashes(texts: pa.Array, hashes: WordHash) -> Iterator[np.ndarray]:
    for text in raw(texts):
        yield hashes.of(text.lower().split()) if text else np.zeros(0, np.uint64)


def _signer(size: int, rows: int, bands: int, seed: int):
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 2**63, rows * bands, dtype=np.uint64)
    weight = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band_no = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(x: np.ndarray) -> np.ndarray:
        """Minima of (factor * x + offset) mod 2**64, of which the upper half is kept: a universal family."""
        least = np.full(rows * bands, np.uint64(2**64 - 1))
        for at in range(0, len(x), 256):
            np.minimum(least, (x[at : at + 256, None] * factor + offset).min(axis=0), out=least)
        return least >> np.uint64(32)

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("n", "a", "b", "bands", "signature")}
            for words in _word_hashes(part.column(1), hashes):
                x = shingle_set(words, size)
                whole = xxhash.xxh3_128_intdigest(x.tobytes())
                out["n"].append(len(x))
                out["a"].append((whole >> 64) - 2**63)
                out["b"].append((whole & (2**64 - 1)) - 2**63)
                if len(x):
                    s = signature(x)
                    out["bands"].append((mix((s.reshape(bands, rows) * weight).sum(axis=1, dtype=np.uint64)) + band_no).view(np.int64))
                    out["signature"].append(s.astype(np.uint8).tobytes() + np.uint32(len(x)).tobytes() + parity(x).tobytes())
                else:
                    out["bands"].append([])
                    out["signature"].append(b"")
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()),
                 pa.array(out["bands"], pa.list_(pa.int64())), pa.array(out["signature"], pa.binary())],
                names=["id", "n_shingles", "set_a", "set_b", "bands", "signature"])

    return sign


def _set_maker(size: int):
    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for part in parts:
            sets = [shingle_set(w, size).view(np.int64) for w in _word_hashes(part.column(1), hashes)]
            for at in range(0, len(sets), 100):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(at, 100).cast(pa.int64()), pa.array(sets[at : at + 100], pa.list_(pa.int64()))], names=["id", "shingles"])

    return make


def parity(x: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of members falls on i. Where two sketches differ, so do the sets: they differ in at least as many members as the sketches in bits."""
    return np.packbits(np.bincount((x >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY).astype(np.uint8) & 1)


def _unpack(signatures: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minima, set sizes and parity sketches of packed signatures."""
    packed = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, width + 4 + PARITY // 8)
    sizes = np.ascontiguousarray(packed[:, width : width + 4]).view(np.uint32)[:, 0].astype(np.int64)
    return packed[:, :width], sizes, np.ascontiguousarray(packed[:, width + 4 :]).view(np.uint64)


def _may_link(left: tuple, right: tuple, percent: int) -> np.ndarray:
    """Pairs that the minima (an estimate 0.15 under the threshold will do) and the parity sketches (no link is lost) leave possible."""
    minima, sizes, bits = left
    minima2, sizes2, bits2 = right
    close = np.flatnonzero((minima == minima2).sum(axis=-1) >= (percent / 100 - 0.15) * minima2.shape[-1])
    both = (sizes + sizes2)[close]
    apart = np.bitwise_count((bits if bits.ndim == 1 else bits[close]) ^ bits2[close]).sum(axis=-1, dtype=np.int64)
    return close[(100 + percent) * apart <= (100 - percent) * both]


def _alike(width: int, percent: int):
    """Keep the pairs that may be linked."""
    def test(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = _may_link(_unpack(part.column(2).to_pylist(), width), _unpack(part.column(3).to_pylist(), width), percent)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).take(pa.array(keep))

    return test


def _alike_chunks(width: int, percent: int):
    """Compare the members of two chunks of a bucket; only pairs of different components that may be linked leave the task."""
    def test(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, comps = np.array(row["ids"]), np.array(row["comps"])
                ids2, comps2 = np.array(row["ids2"]), np.array(row["comps2"])
                minima, sizes, bits = _unpack(row["signatures"], width)
                right = _unpack(row["signatures2"], width)
                u, v = [], []
                for i in range(len(ids)):
                    hit = _may_link((minima[i], sizes[i], bits[i]), right, percent)
                    hit = hit[comps2[hit] != comps[i]]
                    u.append(np.full(len(hit), ids[i]))
                    v.append(ids2[hit])
                u, v = np.concatenate(u), np.concatenate(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], names=["u", "v"])

    return test


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 5, bands: int = 30, seed: int = 7,
) -> DataFrame:
    """Link documents whose sets of `size`-word shingles have a Jaccard similarity of at least `percent` / 100.

    Words are runs of non-blank characters, A-Z lower-cased. Returns a row for each input row: `id_col`, `n_shingles`,
    `component_id` (smallest id reachable over links, the document itself included), `kept` (it is that id).

    * Signatures: `rows * bands` minima under universal hash functions. Documents with one and the same set are a class,
      and only its smallest id goes on.
    * Banding: classes that share all `rows` minima of a band meet in a bucket. Every member is tried against one centre
      of the bucket, the class that shares the most buckets in all, so a family of copies costs a pair a member.
    * Verification: signatures first (an estimate 0.15 under the threshold is let through), a parity sketch that proves many
      pairs too far apart, then the full sets.
    * Members that are still in other components than their centre are compared with the rest of their bucket in chunks
      of `CHUNK`, whatever their number, so no link inside a bucket depends on the choice of the centre.
    * Components by large-star and small-star.

    A pair at similarity s shares no bucket with probability (1 - s**rows)**bands: 7e-6 at 0.8 with the defaults.

    A null or blank text has the empty set and no link. A null id has no link, a null component and is kept. Rows that
    share an id are one document: its links are those of all its rows, and all its rows get the same answer. Other columns
    are ignored. An empty table gives no rows.
    """
    width = rows * bands
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut_lineage(source.mapInArrow(_signer(size, rows, bands, seed), SIGNED), "signatures")

    some = signed.where("n_shingles > 0 and id is not null")
    classes = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"))
    member = some.select("id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"])
    copies = member.where("id > rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    reps = some.join(classes, ["set_a", "set_b", "n_shingles"]).where("id = rep").select("id", "bands", "signature").dropDuplicates(["id", "bands"])
    marks = cut_lineage(reps.select("id", F.explode("bands").alias("key")), "marks")
    crowded = marks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "n")
    buckets = cut_lineage(marks.join(crowded, "key"), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("n").alias("degree"))
    centre = buckets.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("c")).select(
        "key", (-F.col("c.minus")).alias("centre"))
    tagged = cut_lineage(buckets.join(centre, "key"), "tagged")

    signature = cut_lineage(reps.select("id", "signature").join(degree.select("id"), "id", "left_semi"), "bucketed")
    sets = cut_lineage(source.join(degree.select("id"), "id", "left_semi").mapInArrow(_set_maker(size), "id long, shingles array<long>"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
        b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
        shared = F.size(F.array_intersect("su", "sv"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", shared.alias("i"), (F.size("su") + F.size("sv") - shared).alias("all")).where(
            100 * F.col("i") >= percent * F.col("all")).select("u", "v")

    tried = tagged.where("id <> centre").select(F.greatest("id", "centre").alias("u"), F.least("id", "centre").alias("v")).distinct()
    tried = tried.join(signature.select(F.col("id").alias("u"), F.col("signature").alias("p")), "u").join(
        signature.select(F.col("id").alias("v"), F.col("signature").alias("q")), "v").select("u", "v", "p", "q")
    tried = cut_lineage(tried.mapInArrow(_alike(width, percent), "u long, v long"), "tried")
    links = cut_lineage(linked(tried), "links")
    first = components(links)

    placed = tagged.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    of_centre = first.select(F.col("id").alias("centre"), F.col("component").alias("centre_component"))
    apart = placed.join(split, "key").join(of_centre, "centre", "left").withColumn("stray", ~F.col("component").eqNullSafe(F.coalesce("centre_component", "centre")))
    chunks = apart.join(signature, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK))).groupBy("key", "stray", "chunk").agg(
        F.collect_list("id").alias("ids"), F.collect_list("component").alias("comps"), F.collect_list("signature").alias("signatures"))
    chunks = cut_lineage(chunks, "chunks")
    stray = chunks.where("stray")
    other = chunks.select("key", F.col("stray").alias("stray2"), F.col("chunk").alias("chunk2"), F.col("ids").alias("ids2"), F.col("comps").alias("comps2"),
                          F.col("signatures").alias("signatures2"))
    meet = stray.join(other, "key").where("not stray2 or chunk <= chunk2").select("ids", "comps", "signatures", "ids2", "comps2", "signatures2")
    late = meet.mapInArrow(_alike_chunks(width, percent), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti")
    late = cut_lineage(linked(cut_lineage(late, "late")), "late-links")

    whole = components(links.union(late).union(copies))
    return signed.select("id", "n_shingles").join(whole, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
