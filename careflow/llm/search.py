"""Exact top-k search by BM25: an inverted index in shards, where common terms are matrix rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.text import WordHash, hash_words, longs, mix, raw
from careflow.session import cut_lineage

#: Documents of a shard (65,536 at most, as members are two bytes), and queries and query terms that are sent to the shards at once.
SHARD, QUERIES, TERMS = 8192, 8192, 4_000_000
#: A term is common if more than one in `COMMON` documents of a shard holds it; the lists of up to `DENSE` of them are multiplied by `TOGETHER` queries at a time.
COMMON, DENSE, TOGETHER = 24, 1024, 256
#: Bytes of text that are hashed together.
TEXT = 4_000_000
#: Room for rounding in bounds.
SLACK = 1e-9
INDEX_SQL = "shard long, n_docs long, n_words long, docs binary, lengths binary, terms binary, starts binary, members binary, counts binary"
NAMES = ["shard", "n_docs", "n_words", "docs", "lengths", "terms", "starts", "members", "counts"]


def _words(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Id and word hashes of each text that has words, hashed for about `TEXT` bytes at a time."""
    hashes = WordHash()
    for part in parts:
        ids, texts = longs(part.column(0)), [text or b"" for text in raw(part.column(1))]
        cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // TEXT, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            if a < b:
                found, n = hash_words(texts[a:b], hashes)
                yield from ((i, words) for i, words in zip(ids[a:b].tolist(), np.split(found, np.cumsum(n)[:-1])) if len(words))


def _build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of up to `SHARD` documents at a time: term hashes in order, and for each its documents and how often they hold it, in the fewest bytes that do."""
    ids: list[int] = []
    words: list[np.ndarray] = []

    def shard() -> pa.RecordBatch:
        order = np.argsort(np.array(ids), kind="stable")
        each = [words[i] for i in order]
        lengths = np.array([len(w) for w in each], np.int32)
        flat = np.concatenate(each)
        each.clear()
        words.clear()
        terms = np.sort(flat)
        terms = terms[np.r_[True, terms[1:] != terms[:-1]]]
        # Sorted numbers of a term and a document: the hash without its last 16 bits is the term's number, unless that is the same for two terms.
        doc = (flat >> 16 if (terms[1:] >> 16 != terms[:-1] >> 16).all() else np.searchsorted(terms, flat).astype(np.uint64)) << 16
        doc |= np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        doc.sort()
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        counts = np.diff(np.r_[new, len(doc)]).astype(np.int32)
        doc = doc[new]
        starts = np.flatnonzero(np.r_[True, doc[1:] >> 16 != doc[:-1] >> 16, True]).astype(np.int32)
        docs = np.array(ids, np.int64)[order]
        number = int(mix(docs[:1].view(np.uint64) + np.uint64(len(docs)))[0] >> np.uint64(1))
        row = [number, len(docs), int(lengths.sum()), docs.tobytes(), lengths.tobytes(), terms.tobytes(), starts.tobytes(),
               (doc & 0xFFFF).astype(np.uint16).tobytes(), counts.astype(np.min_scalar_type(counts.max())).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row], names=NAMES)

    for i, found in _words(parts):
        ids.append(i)
        words.append(found)
        if len(ids) >= SHARD or len(found) > 10 * TERMS:
            yield shard()
            ids, words = [], []
    if ids:
        yield shard()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents, written to the shared folder: a row for each shard of up to `SHARD` documents.

    Terms are runs of non-blank characters, A-Z lower-cased, kept as 64-bit hashes. Documents without a word or with a null id
    are left out; repeated rows are documents of their own. Shards follow the partitions of `docs`: nothing is shuffled.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(_build, INDEX_SQL), "index")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of all ranges, one after another."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


class Shard:
    """A shard ready for queries: scores of all postings by term and by document, and those of common terms as rows of a dense matrix."""

    def __init__(self, row: dict, mean_length: float, k1: float, b: float):
        self.docs, lengths = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["lengths"], np.int32)
        self.terms, self.starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int32).astype(np.int64)
        self.member = np.frombuffer(row["members"], np.uint16)
        self.counts = np.frombuffer(row["counts"], f"u{2 * len(row['counts']) // len(row['members'])}")
        self.norm, self.k1 = k1 * (1 - b + b * lengths / mean_length), k1
        self.sizes = np.diff(self.starts)
        self.asked = np.zeros(len(self.terms), bool)
        self.by_doc = np.argsort(self.member, kind="stable").astype(np.int32)
        self.own_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.sizes)[self.by_doc]
        self.own_starts = np.r_[0, np.cumsum(np.bincount(self.member, minlength=len(self.docs)))]

    def weigh(self, at: np.ndarray, weights: np.ndarray) -> None:
        """Scores of all postings of the terms that are asked for, from the weights of these terms; those of common terms as a matrix, too."""
        weight = np.zeros(len(self.terms))
        weight[at] = weights
        self.value = self.norm[self.member]
        self.value += self.counts
        np.divide(self.counts * (self.k1 + 1), self.value, out=self.value)
        self.value *= np.repeat(weight, self.sizes)
        self.own_value = self.value[self.by_doc]

        common = np.flatnonzero((self.sizes * COMMON > len(self.docs)) & (weight > 0))
        common = np.sort(common[np.argsort(-self.sizes[common], kind="stable")[:DENSE]])
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(self.docs)), np.float32)
        for i, term in enumerate(common.tolist()):
            own = slice(self.starts[term], self.starts[term + 1])
            self.dense[i, self.member[own]] = self.value[own]
        self.slack = SLACK + (len(common) + 8) * float(np.finfo(np.float32).eps)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in the shard, -1 for those it does not hold."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def tops(self, queries: Iterable[tuple[np.ndarray, float]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, terms of the shard that `weigh` was given and a floor: documents and scores of the shard's best k among those that score at least the floor.

        All documents are summed up: the lists of common terms by a matrix product for `TOGETHER` queries at a time, in single
        precision, the others one by one. All summands are positive, so a sum is off by a bounded share (`slack`), whatever
        cancels; the k-th largest sum less that share is a score that k documents reach, so the floor rises to it, and only
        documents whose sum and that share reach the floor are scored again, in double precision from their own terms.
        """
        queries = iter(queries)
        while some := list(islice(queries, TOGETHER)):
            asked = np.zeros((len(some), len(self.dense)), np.float32)
            rows = [self.row[at] for at, _ in some]
            for i, row in enumerate(rows):
                asked[i, row[row >= 0]] = 1
            for (at, floor), row, summed in zip(some, rows, asked @ self.dense):
                rare = at[row < 0]
                places = _ranges(self.starts[rare], self.sizes[rare])
                yield self._best(at, summed + np.bincount(self.member.take(places), self.value.take(places), len(self.docs)), k, floor)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """`tops` of one query, from its term hashes and their weights."""
        at = self.find(terms)
        held = at >= 0
        self.weigh(at[held], weights[held])
        return next(self.tops([(at[held], floor)], k))

    def _best(self, at: np.ndarray, summed: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The best k by exact scores, from sums that are off by a share of `slack` at most.

        Documents are scored in full from the largest sum down, some at a time, until no sum reaches the k-th best score so
        far; ties at that score go to the smaller id, so equal bounds are scored.
        """
        open_ = np.flatnonzero((summed >= floor * (1 - self.slack)) & (summed > 0))
        bound = summed[open_]
        if len(open_) > k:
            floor = max(floor, float(np.partition(bound, -k)[-k]) * (1 - self.slack))
        bound *= 1 + 2 * self.slack
        order = np.argsort(-bound, kind="stable")
        open_, bound = open_[order], bound[order]
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        self.asked[at] = True
        done, step = 0, 4 * k
        while done < len(open_) and bound[done] >= floor:
            chosen = open_[done : done + step][bound[done : done + step] >= floor]
            done += step
            step = min(2 * step, 1024)
            size = self.own_starts[chosen + 1] - self.own_starts[chosen]
            own = _ranges(self.own_starts[chosen], size)
            shared = np.flatnonzero(self.asked[self.own_term[own]])
            score = np.bincount(np.repeat(np.arange(len(chosen)), size)[shared], self.own_value[own[shared]], len(chosen))
            hit = (score > 0) & (score >= floor)
            ids, scores = np.r_[ids, self.docs[chosen[hit]]], np.r_[scores, score[hit]]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = max(floor, scores[-1])
        self.asked[at] = False
        return ids, scores


def _add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the arrays of each start."""
    total: dict[int, np.ndarray] = {}
    for part in parts:
        for start, n in zip(part.column(0).to_pylist(), part.column(1)):
            n = n.values.to_numpy()
            total[start] = total[start] + n if start in total else n
    for start, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([n], pa.list_(pa.int64()))], names=["start", "n"])


def search(index: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of every query by BM25: rows `query_id`, `rank` (from 1), `doc_id`, `score`.

    A query is a text with an id; its distinct terms each count once. Score: the sum over them of ln(1 + (N - df + 0.5) /
    (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / mean words)), with N, df and the mean over all shards. Only
    documents that share a term are ranked; ties go to the smaller id.

    Queries go to the shards in blocks of at most `QUERIES` queries and about `TERMS` terms, whatever their number. For each
    block the document frequencies are added up over all shards; a twelfth of the shards gives a first k-th best score for
    each query, from which the search of all shards starts; the shards' best are merged by score. Nothing is lost, as
    a score that is k-th best among some documents cannot be above that among all.

    Queries with null or empty texts or null ids have no rows; queries that share an id are one query with the terms of all.
    An empty index or no query gives no rows.
    """
    spark = index.sparkSession

    def to_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, found in _words(parts):
            terms = np.unique(found)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([terms.tobytes()], pa.binary()), pa.array([len(terms)], pa.int64())], names=["query_id", "terms", "n"])

    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = cut_lineage(asked.mapInArrow(to_terms, "query_id long, terms binary, n long").groupBy("query_id").agg(F.collect_list("terms").alias("terms"), F.sum("n").alias("n")), "queries")
    size = asked.agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = max(1, -(-size[0] // QUERIES), -(-(size[1] or 0) // TERMS))
    n_docs, n_words, n_shards = index.agg(F.sum("n_docs"), F.sum("n_words"), F.count(F.lit(1))).first()
    result = spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    if not n_docs:
        return result
    mean = n_words / n_docs
    seeds = index.where(F.pmod(F.xxhash64("shard"), F.lit(12)) == 0)

    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "terms").orderBy("query_id").collect()
        if not rows:
            continue
        ids = np.array([r["query_id"] for r in rows], np.int64)
        terms = [np.unique(np.frombuffer(b"".join(r["terms"]), np.uint64)) for r in rows]
        every = np.unique(np.concatenate(terms))
        wanted = spark.sparkContext.broadcast(every)

        def frequencies(parts: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(wanted.value), np.int64)
            for part in parts:
                for found, starts in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found, n = np.frombuffer(found, np.uint64), np.diff(np.frombuffer(starts, np.int32))
                    at = np.searchsorted(found, wanted.value)
                    at[at == len(found)] = 0
                    total += np.where(found[at] == wanted.value, n[at], 0)
            for start in range(0, len(total), 1 << 16):
                some = total[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([some.tolist()], pa.list_(pa.int64()))], names=["start", "n"])

        counted = index.select("terms", "starts").mapInArrow(frequencies, "start long, n array<long>").repartition("start").mapInArrow(_add_up, "start long, n array<long>")
        df = np.zeros(len(every), np.int64)
        for r in counted.toLocalIterator():
            df[r["start"] : r["start"] + len(r["n"])] += np.array(r["n"])
        weight = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        places = [np.searchsorted(every, t).astype(np.int32) for t in terms]

        def find(floors: np.ndarray, ids=ids, places=places, weight=weight, wanted=wanted):
            sent = spark.sparkContext.broadcast((ids, places, weight, floors))

            def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, places, weight, floors = sent.value

                def tops(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
                    shard = Shard(row, mean, k1, b)
                    at = shard.find(wanted.value)
                    shard.weigh(at[at >= 0], weight[at >= 0])
                    held = (at[own] for own in places)
                    return list(shard.tops(((own[own >= 0], floor) for own, floor in zip(held, floors)), k))

                for part in parts:
                    for at in range(part.num_rows):
                        found = tops({name: part.column(name)[at].as_buffer() for name in NAMES[3:]})
                        n = [len(d) for d, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(ids, n)), pa.array(np.concatenate([d for d, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "doc_id", "score"])

            return run

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        found_sql = "query_id long, doc_id long, score double"
        floors = np.zeros(len(ids))
        first = seeds.mapInArrow(find(floors), found_sql).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        for r in first.select("query_id", "score").toLocalIterator():
            floors[np.searchsorted(ids, r["query_id"])] = r["score"]
        found = index.mapInArrow(find(floors), found_sql).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        result = result.union(found.select("query_id", "rank", "doc_id", "score"))
    return result
