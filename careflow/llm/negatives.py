"""Hard negatives: rows of another label whose inner product with an anchor is a little below that of a positive."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.token_files import _at_uri
from careflow.llm.vectors import is_finite, matrix, scaled
from careflow.session import cut_lineage, spread

#: Components that the vectors of one tree have together, and rows of a leaf and children of an inner box.
TREE_CELLS = 1 << 21
LEAF = 128
FANOUT = 16
#: Queries that a tree answers at a time.
QUERIES = 1024


def tiles(x: np.ndarray, rows: np.ndarray, axes: list[int], leaf: int) -> Iterator[np.ndarray]:
    """Sort-tile-recursive packing: cut rows into slabs along the first axis, each slab along the next, down to leaves."""
    pages = -(-len(rows) // leaf)
    if pages <= 1:
        yield rows
        return
    slabs = int(np.ceil(pages ** (1 / len(axes)))) if axes else pages
    step = leaf * -(-pages // slabs)
    order = rows[np.argsort(x[rows, axes[0]], kind="stable")] if axes else rows
    for at in range(0, len(rows), step):
        yield from tiles(x, order[at : at + step], axes[1:], leaf)


def pack_rows(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows in leaves, none of which mixes labels, and the first place of each leaf. Axes go by falling spread."""
    axes = np.argsort(-x.std(axis=0), kind="stable").tolist() if x.size else []
    by_label = np.argsort(labels, kind="stable")
    groups = np.split(by_label, np.flatnonzero(np.diff(labels[by_label])) + 1) if len(labels) else []
    leaves = [t for g in groups for t in tiles(x, g, axes, leaf)]
    sizes = np.array([len(t) for t in leaves], np.int64)
    return (np.concatenate(leaves) if leaves else np.zeros(0, np.int64)), np.cumsum(sizes) - sizes


@dataclass
class Tree:
    """Boxes over rows in packed order. Box b spans children `first[b]` to `last[b]` - 1: rows for the leaves, which come first, else boxes."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    n_leaves: int
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    most: int

    @classmethod
    def over(cls, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, starts: np.ndarray, fanout: int = FANOUT) -> Tree:
        """The tree over packed rows whose leaves begin at `starts`."""
        first, last = [starts], [np.append(starts[1:], len(x))]
        boxes = [(np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), labels[starts], labels[starts])]
        base, n = 0, len(starts)
        while n > 1:
            cuts = np.arange(0, n, fanout)
            low, high, label_low, label_high = boxes[-1]
            boxes.append((
                np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(label_low, cuts), np.maximum.reduceat(label_high, cuts)))
            first.append(base + cuts)
            last.append(base + np.append(cuts[1:], n))
            base, n = base + n, len(cuts)
        low, high, label_low, label_high = (np.concatenate(part) for part in zip(*boxes))
        return cls(x, ids, labels, len(starts), np.concatenate(first), np.concatenate(last), low, high, label_low, label_high, int(np.abs(x).max(initial=0)))

    def exact(self, queries: np.ndarray) -> type:
        """Type in which every sum of products is exact; raises if a long could not hold one."""
        bound = self.most * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        if bound >= 1 << 62:
            raise ValueError("inner products do not fit a long")
        return np.float64 if bound < 1 << 52 else np.int64

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that each query can have in each box, from the interval of every coordinate."""
        kind = self.exact(queries)
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        low, high = self.low.astype(kind).T, self.high.astype(kind).T
        return (up @ low + down @ high).astype(np.int64), (up @ high + down @ low).astype(np.int64)

    def search(
        self, query: np.ndarray, least: np.ndarray, most: np.ndarray, query_id: int, label: int, same: bool, windows: list[tuple[int, int]], k: int,
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first `k` rows (higher scores, then smaller ids) of each score window, of the query's label or, if not `same`, of others.

        `query` has the tree's numeric type, `least` and `most` are its intervals over all boxes. A queue gives the box with the
        largest possible score. Boxes are passed over that lie outside all windows, or strictly below the k-th score that
        every window has found so far; an equal score may still have a smaller id.
        """
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(windows)
        floors = [w[0] for w in windows]
        ceiling, floor = max(w[1] for w in windows), min(floors)
        root = len(self.first) - 1
        queue = [(-int(most[root]), root)]
        while queue and -queue[0][0] >= floor:
            _, box = heapq.heappop(queue)
            a, b = int(self.first[box]), int(self.last[box])
            if box >= self.n_leaves:
                fits = (self.label_low[a:b] <= label) & (self.label_high[a:b] >= label) if same else (self.label_low[a:b] != label) | (self.label_high[a:b] != label)
                fits &= (most[a:b] >= floor) & (least[a:b] <= ceiling)
                for child in (a + np.flatnonzero(fits)).tolist():
                    heapq.heappush(queue, (-int(most[child]), child))
                continue
            if (int(self.label_low[box]) == label) != same or least[box] > ceiling:
                continue  # reached only by a tree of one leaf
            scores, ids = (self.x[a:b] @ query).astype(np.int64), self.ids[a:b]
            keep = (scores >= floor) & (scores <= ceiling) & (ids != query_id)
            if not keep.any():
                continue
            scores, ids = scores[keep], ids[keep]
            for w, (_, high) in enumerate(windows):
                fits = (scores >= floors[w]) & (scores <= high)
                if fits.any():
                    s, i = np.concatenate([found[w][0], scores[fits]]), np.concatenate([found[w][1], ids[fits]])
                    order = np.lexsort((i, -s))[:k]
                    found[w] = s[order], i[order]
                    if len(order) == k:
                        floors[w] = int(s[order[-1]])
            floor = min(floors)
        return found


def pack_trees(rows: DataFrame, dims: int) -> DataFrame:
    """Rows (id, label, v) as trees of bounded size: `tree` is a row's share of the table, packed, with its leaves' first places.

    Rows are dealt by label, the first two coordinates and the id: the outermost tiles. Rows alike in all but the id are spread too.
    """
    most = max(LEAF, TREE_CELLS // max(1, dims))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree(n: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            now, rest = table.slice(0, n), table.slice(n)
            held[:] = rest.to_batches()
            x = np.concatenate([matrix(c, dims) for c in now.column("v").chunks])
            ids, labels = now.column("id").to_numpy(), now.column("label").to_numpy()
            order, starts = pack_rows(x, labels)
            blobs = [x[order].astype("<i4"), ids[order].astype("<i8"), labels[order].astype("<i8"), starts.astype("<i8")]
            return pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in blobs], names=["x", "ids", "labels", "starts"])

        for part in parts:
            held.append(part)
            while sum(b.num_rows for b in held) >= most:
                yield tree(most)
        if sum(b.num_rows for b in held):
            yield tree(most)

    dealt = rows.repartitionByRange("label", F.get("v", F.lit(0)), F.get("v", F.lit(1)), "id")
    return cut_lineage(dealt.mapInArrow(pack, "x binary, ids binary, labels binary, starts binary"), "trees")


def ask_trees(trees: DataFrame, queries: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """Answers of every tree to every query: `query`, `anchor_id`, `goal_id`, `goal_score`, `id`, `score`, at most `k` a window and tree.

    `queries` is a written table (query, anchor_id, label, v, goals); `goals` are the windows (id, score, low, high). A task holds one tree and
    streams the queries from shared storage in blocks, so neither the driver nor a task ever holds them all.
    """
    folder = queries.inputFiles()[0].rsplit("/", 1)[0] if not queries.isEmpty() else None
    schema = "query long, anchor_id long, goal_id long, goal_score long, id long, score long"
    if folder is None:
        return queries.sparkSession.createDataFrame([], schema)
    names = [part.split()[0] for part in schema.split(", ")]

    def blocks() -> Iterator[pa.RecordBatch]:
        fs, at = _at_uri(folder)
        return pa.dataset.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=QUERIES, batch_readahead=1, fragment_readahead=1, use_threads=False)

    def answers(tree: Tree, block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = matrix(block.column("v"), dims)
        least, most = tree.intervals(q)
        exact = q.astype(tree.exact(q))
        tree.x = tree.x.astype(exact.dtype, copy=False)
        out: list[list[np.ndarray]] = [[] for _ in names]
        heads = zip(*[block.column(c).to_pylist() for c in ("query", "anchor_id", "label", "goals")])
        for row, (query, anchor, label, goals) in enumerate(heads):
            found = tree.search(exact[row], least[row], most[row], anchor, label, same, [(g["low"], g["high"]) for g in goals], k)
            for goal, (scores, ids) in zip(goals, found):
                fixed = [query, anchor, goal["id"], goal["score"]]
                for column, values in zip(out, [*[np.full(len(ids), v, np.int64) for v in fixed], ids, scores]):
                    column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                x, ids, labels, starts = (np.frombuffer(part.column(c)[row].as_py(), t) for c, t in (("x", "<i4"), ("ids", "<i8"), ("labels", "<i8"), ("starts", "<i8")))
                tree = Tree.over(x.reshape(len(ids), dims), ids, labels, starts)
                for block in blocks():
                    if block.num_rows:
                        yield from answers(tree, block)

    return spread(trees).mapInArrow(run, schema)


def first_of(answers: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first `k` answers of each group over all trees, with their `rank`."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", factor: int = 256,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """Per anchor and positive the hardest negatives: `anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    `is_anchor` is a condition on the columns of `df`. A component x counts as floor(factor * x), and a row's score is its
    inner product with the anchor; higher scores come first, ties by smaller id. The positives of an anchor are the first `positives` rows of its
    label; for each, the negatives are the first `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    Anchors without positives, and positives without such rows, give no rows; a positive of negative score has none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors end in zeros.
    Rows with the anchor's id are not its positives or negatives. Repeated rows each count, save that equal anchors and equal positives are answered once; rows of one id with
    different labels or vectors are different anchors. An empty table gives no rows, and other columns are ignored. Scaled components must stay under 2**27.

    Trees of bounded size hold all rows and are written once. Every tree answers all anchors, first for positives, then for
    the windows that the positives set, and the answers are merged by anchor.
    """
    part = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) & is_finite(F.col(vector_col))
    rows = df.where(part).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vector_col), factor).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    trees = pack_trees(rows.select("id", "label", "v"), dims)

    floor, roof = F.lit(-(1 << 62)), F.lit(1 << 62)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), floor.alias("low"), roof.alias("high")))
    anchors = rows.where("anchor").select("id", "label", "v").distinct()
    anchors = cut_lineage(anchors.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("anchor_id"), "label", "v", whole.alias("goals")), "anchors")
    best = first_of(ask_trees(trees, anchors, dims, True, positives), ["query"], positives)

    def hundredths(x: Column) -> Column:
        """floor(x / 100) in whole numbers."""
        return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))

    s = F.col("score")
    goal = F.struct("id", "score", (-hundredths(-s * low)).alias("low"), hundredths(s * high).alias("high"))
    goals = best.groupBy("query").agg(F.sort_array(F.collect_set(goal)).alias("goals"))
    windows = cut_lineage(anchors.drop("goals").join(goals, "query"), "windows")
    found = first_of(ask_trees(trees, windows, dims, False, negatives), ["query", "goal_id", "goal_score"], negatives)
    return found.select(
        "anchor_id", F.col("goal_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("goal_score").alias("positive_score"), F.col("score").alias("negative_score"))
