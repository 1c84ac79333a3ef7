"""K-means with many starts in one pass over the rows per round.

Every batch of rows meets the centres of all starts as matrix products; a task keeps one sum
and count per start and centre, which Spark adds up. Centres live on the driver: their number is
`starts * k`, set by the caller and not by the data.

With few features near rows are brought together and written in chunks, each a tree of boxes of
halves. A round goes down the trees with the centres that may be nearest to a point of a box: where
one is left, the box is added by its count, sums and spread, and only rows of the last boxes with
more centres meet these one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.functions.scalar import hash_below
from careflow.session import cut_lineage, spread

#: Rows of a batch that meet the centres of one start at a time.
SLAB = 2048
#: Rows of a block that meets only the centres in reach of its box, and the most features for which boxes rule out enough.
BLOCK = 250
BLOCK_DIMS = 8
#: Rows of a chunk and of its last boxes, rows drawn to cut the space into regions, and regions for each partition.
CHUNK, LEAF, DRAWN, REGIONS = 1 << 16, 16, 50_000, 16
#: Rows times centres that meet at a time.
MEET = 1_000_000
#: What halving a box costs for each centre, what a row and a centre cost, and what a row costs, in nanoseconds.
ROW_COST = 240, 0.75, 25
#: Passes that gather candidates for the first centres, each of 2 * k rows.
SEED_PASSES = 3


@dataclass(frozen=True)
class Clusters:
    """Centres of the best start, its cost (summed squared distance), the cost and rounds of every start."""

    centres: np.ndarray
    cost: float
    costs: list[float]
    rounds: list[int]

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, the lower number on ties, and the squared distance to it."""
    state = np.empty(len(x), dtype=np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), SLAB):
        state[at:at + SLAB] = (half - x[at:at + SLAB] @ centres.T).argmin(axis=1)
    off = x - centres[state]
    return state, (off * off).sum(axis=1)


def in_blocks(x: np.ndarray, rows: int) -> np.ndarray:
    """Order of rows in which each run of about `rows` is close together: halves along the widest feature, again and again."""
    runs = len(x) // rows
    if runs and len(x) == rows * runs and runs & (runs - 1) == 0:
        order = np.arange(len(x))[None]
        while order.shape[1] > rows:
            own = x[order]
            wide = np.ptp(own, axis=1).argmax(axis=1)
            cut = np.argpartition(np.take_along_axis(own, wide[:, None, None], axis=2)[:, :, 0], order.shape[1] // 2, axis=1)
            order = np.take_along_axis(order, cut, axis=1).reshape(2 * len(order), -1)
        return order.ravel()
    out, todo = [], [np.arange(len(x))]
    while todo:
        mine = todo.pop()
        if len(mine) <= rows:
            out.append(mine)
            continue
        own = x[mine]
        half = rows * (-(-len(mine) // rows) // 2)
        cut = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)
        todo += [mine[cut[half:]], mine[cut[:half]]]
    return np.concatenate(out)


def in_reach(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres that may be nearest to a point of the box: all but those that another centre beats in every corner. A centre with NaN keeps all."""
    rival = centres[((centres - (low + high) / 2) ** 2).sum(axis=1).argmin()]
    corner = np.where(centres > rival, high, low)
    mine, other = ((centres - corner) ** 2).sum(axis=1), ((rival - corner) ** 2).sum(axis=1)
    return np.flatnonzero(~(mine > other * (1 + 1e-9) + 1e-300))


def complete(features: Sequence[str]) -> Column:
    """True where every feature is a finite number."""
    x = [F.col(c).cast("double") for c in features]
    return reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in x])


def _nearest_in(boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` of blocks of rows with their bounds; a block meets only the centres in reach of its box."""
    found = []
    for rows, low, high in boxes:
        near = in_reach(low, high, centres)
        state, far = nearest(rows, centres[near])
        found.append((near[state], far))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Tree:
    """Rows in the order of `in_blocks`, and for each level of halves the bounds, count, sums and summed squared distance to the mean of its boxes."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        leaves = -(-len(rows) // LEAF)
        self.depth = leaves.bit_length() - 1
        self.ends = np.minimum(((leaves * np.arange((1 << self.depth) + 1)) >> self.depth) * LEAF, len(rows))
        at, n = self.ends[:-1], np.diff(self.ends).astype(np.float64)
        total = np.add.reduceat(rows, at, axis=0)
        off = rows - np.repeat(total / n[:, None], np.diff(self.ends), axis=0)
        levels = [(np.minimum.reduceat(rows, at, axis=0), np.maximum.reduceat(rows, at, axis=0), n, total, np.add.reduceat((off * off).sum(axis=1), at))]
        for _ in range(self.depth):
            low, high, n, total, spread = levels[-1]
            (a, b), (one, two) = (total[::2], total[1::2]), (n[::2], n[1::2])
            apart = ((a / one[:, None] - b / two[:, None]) ** 2).sum(axis=1) * (one * two / (one + two))
            levels.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), one + two, a + b, spread[::2] + spread[1::2] + apart))
        self.levels = levels[::-1]

    def settle(self, live: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[tuple[int, np.ndarray, np.ndarray]]]:
        """Boxes with one nearest centre, as level, boxes and centres; and the rows of all others with their nearest centres, the lower number on ties.

        Centres of all starts are numbered one after another. Each row is in one box or among the rows, once for each start. A
        box is not halved further if its rows meet its centres in less time.
        """
        starts, k, dims = live.shape
        every, half = live.reshape(-1, dims), (live * live).sum(axis=2).ravel() / 2
        columns = np.ascontiguousarray(every.T)
        boxes, rows = [], []
        near = [in_reach(self.levels[0][0][0], self.levels[0][1][0], live[s]) + s * k for s in range(starts)]
        box, size, centre = np.zeros(starts, np.int64), np.array([len(c) for c in near]), np.concatenate(near)
        for level in range(self.depth + 1):
            low, high = self.levels[level][0][box].T, self.levels[level][1][box].T
            middle = (low + high) / 2
            reach = 2 * np.maximum(high - middle, middle - low)
            item = np.repeat(np.arange(len(box)), size)
            far, side = np.zeros(len(centre)), np.zeros(len(centre))
            met = [column.take(centre) for column in columns]
            for j in range(dims):
                off = met[j] - middle[j].take(item)
                off *= off
                far += off
            least = np.minimum.reduceat(far, np.cumsum(size) - size).take(item)
            first = np.flatnonzero(far == least)
            rival = np.empty(len(box), np.int64)
            rival[item[first]] = centre[first]
            for j in range(dims):
                off = met[j] - columns[j].take(rival).take(item)
                np.abs(off, out=off)
                off *= reach[j].take(item)
                side += off
            keep = np.flatnonzero(~(far - side > least + (far + least) * 1e-9))
            size = np.bincount(item[keep], minlength=len(box))
            centre = centre[keep]
            one = size == 1
            alone = np.repeat(one, size)
            boxes.append((level, box[one], centre[alone]))
            box, size, centre = box[~one], size[~one], centre[~alone]
            if not len(box):
                return boxes, rows
            width = LEAF << (self.depth - level)
            meet = size * (ROW_COST[0] - ROW_COST[1] * width) > ROW_COST[2] * width if level < self.depth else np.ones(len(box), bool)
            if meet.any():
                rows += [(level, *found) for found in self._meet(level, box[meet], size[meet], centre[np.repeat(meet, size)], every, half)]
                box, size, centre = box[~meet], size[~meet], centre[~np.repeat(meet, size)]
            if not len(box):
                return boxes, rows
            if level < self.depth:
                at = np.cumsum(size) - size
                box = (2 * box[:, None] + [0, 1]).ravel()
                at, size = np.repeat(at, 2), np.repeat(size, 2)
                ends = np.cumsum(size)
                centre = centre[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        return boxes, rows

    def places(self, level: int, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of boxes, a line for each box, and which of them are not just there to fill the line."""
        ends = self.ends[:: 1 << (self.depth - level)]
        size = ends[box + 1] - ends[box]
        line = np.arange(int(size.max()))
        return np.minimum(ends[box][:, None] + line, len(self.rows) - 1), line < size[:, None]

    def _meet(self, level: int, box: np.ndarray, size: np.ndarray, centre: np.ndarray, every: np.ndarray, half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows of boxes and the nearest of each box's centres."""
        at = np.cumsum(size) - size
        for m in np.unique(size).tolist():
            mine = np.flatnonzero(size == m)
            step = max(1, MEET // ((LEAF << (self.depth - level)) * m))
            for some in (mine[a:a + step] for a in range(0, len(mine), step)):
                met = centre[at[some][:, None] + np.arange(m)]
                place, real = self.places(level, box[some])
                best = (half[met][:, None, :] - self.rows[place] @ every[met].transpose(0, 2, 1)).argmin(axis=2)
                best = np.take_along_axis(met, best, axis=1)
                yield (place.ravel(), best.ravel()) if real.all() else (place[real], best[real])

    def bounded(self, live: np.ndarray) -> bool:
        """False if a square of a centre or of a bound is not a finite number, so that boxes rule out nothing."""
        return all(np.isfinite(x * x).all() for x in (live, *self.levels[0][:2]))

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`nearest` of all rows."""
        if not self.bounded(centres):
            return nearest(self.rows, centres)
        state = np.empty(len(self.rows), np.int64)
        boxes, rows = self.settle(centres[None])
        for level, box, centre in boxes:
            ends = self.ends[:: 1 << (self.depth - level)]
            for a, b, c in zip(ends[box].tolist(), ends[box + 1].tolist(), centre.tolist()):
                state[a:b] = c
        for _, place, centre in rows:
            state[place] = centre
        off = self.rows - centres[state]
        return state, (off * off).sum(axis=1)

    def totals(self, live: np.ndarray) -> np.ndarray:
        """Count, cost and feature sums of every centre of every start."""
        starts, k, dims = live.shape
        if not self.bounded(live):
            return np.concatenate([_add_rows(self.rows, *nearest(self.rows, live[s]), k) for s in range(starts)])
        every, out = live.reshape(-1, dims), np.zeros((dims + 2, starts * k))
        boxes, rows = self.settle(live)
        for level, box, centre in boxes:
            _, _, n, total, spread = (of[box] for of in self.levels[level])
            off = total / n[:, None] - every[centre]
            for j, weight in enumerate([n, spread + n * (off * off).sum(axis=1), *total.T]):
                out[j] += np.bincount(centre, weight, starts * k)
        for _, place, centre in rows:
            x = self.rows[place]
            off = x - every[centre]
            off *= off
            out[0] += np.bincount(centre, minlength=starts * k)
            for j, weight in enumerate([off.sum(axis=1), *x.T]):
                out[j + 1] += np.bincount(centre, weight, starts * k)
        return out.T


def _add_rows(rows: np.ndarray, state: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Count, cost and feature sums of every centre."""
    return np.column_stack([np.bincount(state, minlength=k), *[np.bincount(state, weights=w, minlength=k) for w in (far, *rows.T)]])


def _regions(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of the space into regions of about as many of the rows: for each node its feature (-1 for a region), its cut and its first child."""
    feature, cut, child, todo, regions = [-1], [0.0], [0], [(0, rows)] if len(rows) else [], 1
    for node, mine in todo:
        width = np.ptp(mine, axis=0)
        if regions >= most or not width.max() > 0:
            continue
        j = int(width.argmax())
        middle = np.partition(mine[:, j], (len(mine) - 1) // 2)[(len(mine) - 1) // 2]
        left = mine[:, j] <= middle if middle < mine[:, j].max() else mine[:, j] < middle
        feature[node], cut[node], child[node] = j, float(mine[left, j].max()), len(feature)
        todo += [(len(feature), mine[left]), (len(feature) + 1, mine[~left])]
        feature, cut, child, regions = [*feature, -1, -1], [*cut, 0.0, 0.0], [*child, 0, 0], regions + 1
    return np.array(feature), np.array(cut), np.array(child)


def _region(rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node of the region that each row is in."""
    node, todo = np.zeros(len(rows), np.int64), np.arange(len(rows))
    while len(todo := todo[feature[node[todo]] >= 0]):
        at = node[todo]
        node[todo] = child[at] + (rows[todo, feature[at]] > cut[at])
    return node


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _chunks(points: DataFrame, dims: int, draws: Sequence[Column]) -> DataFrame:
    """The points with their draws in chunks of near rows: a row for each chunk, its points in the order of `in_blocks`.

    The space is cut into regions of about as many rows by some that are drawn; a region with many rows, such as those of equal ones, goes to many partitions.
    """
    points = cut_lineage(points, "rows")
    n = points.count()
    drawn = points.sample(min(1.0, DRAWN / n), 0) if n else points
    drawn = np.array(drawn.limit(2 * DRAWN).toPandas(), dtype=np.float64).reshape(-1, dims)
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _regions(drawn, REGIONS * partitions)
    share = np.bincount(_region(drawn, *cuts), minlength=len(cuts[0])) / max(1, len(drawn))
    slots = np.maximum(1, np.round(share * REGIONS * partitions)).astype(np.int64)
    first = np.cumsum(slots) - slots
    each = np.repeat(share / slots, slots)
    task, load = np.zeros(len(each), np.int32), np.zeros(partitions)
    for slot in np.argsort(-each, kind="stable").tolist():
        task[slot] = load.argmin()
        load[task[slot]] += each[slot]
    names = points.columns

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            node = _region(_matrix(part), *cuts)
            slot = first[node] + np.arange(len(node)) % slots[node]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(task[slot])], names=[*names, "task"])

    def chunk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ordered() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            order = in_blocks(rows[:, :dims], LEAF)
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary()) for x in (rows[:, :dims], rows[:, dims:])], names=["points", "draws"])

        held: list[np.ndarray] = []
        for part in parts:
            rows = _matrix(part)
            while len(rows):
                room = CHUNK - sum(map(len, held))
                held.append(rows[:room])
                rows = rows[room:]
                if room <= len(held[-1]):
                    yield ordered()
        if held:
            yield ordered()

    dealt = points.mapInArrow(deal, ", ".join(f"{c} double" for c in names) + ", task int").repartitionById(partitions, F.col("task"))
    return cut_lineage(dealt.select(*names, *[u.alias(f"u{i}") for i, u in enumerate(draws)]).mapInArrow(chunk, "points binary, draws binary"), "points")


def _read(parts: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[Tree, np.ndarray | None]]:
    """Trees of the chunks, with the draws of their rows if these are read."""
    for part in parts:
        for i in range(part.num_rows):
            rows, *drawn = [np.frombuffer(c[i].as_buffer(), np.float64) for c in part.columns]
            rows = rows.reshape(-1, dims)
            yield Tree(rows), drawn[0].reshape(len(rows), -1) if drawn else None


def _sum_pass(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows or chunks of rows in, one row per start and centre that has rows: count, cost, and sum of each feature."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = shared.value
        starts, k, dims = live.shape
        total = np.zeros((starts * k, dims + 2))
        if dims <= BLOCK_DIMS:
            for tree, _ in _read(parts, dims):
                total += tree.totals(live)
        else:
            for rows in map(_matrix, parts):
                for s in range(starts):
                    total[s * k:(s + 1) * k] += _add_rows(rows, *nearest(rows, live[s]), k)
        cell = np.flatnonzero(total[:, 0])
        names = ["n", "cost", *[f"s{j}" for j in range(dims)]]
        yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(c) for c in total[cell].T]], names=["cell", *names])

    return run


def _totals(points: DataFrame, live: np.ndarray) -> np.ndarray:
    """Count, cost and feature sums of every centre of every start: one pass over the rows."""
    starts, k, dims = live.shape
    names = ["n", "cost", *[f"s{j}" for j in range(dims)]]
    shared = points.sparkSession.sparkContext.broadcast(live)
    rows = points.select("points") if dims <= BLOCK_DIMS else points
    parts = rows.mapInArrow(_sum_pass(shared), "cell long, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    shared.destroy()
    out = np.zeros((starts * k, dims + 2))
    out[got["cell"].to_numpy()] = got[names].to_numpy()
    return out.reshape(starts, k, dims + 2)


def _far_rows(points: DataFrame, dims: int, centres: np.ndarray, draw: Column, number: int, most: int) -> np.ndarray:
    """`most` different rows drawn without replacement, each with a chance in proportion to its squared distance to the centres.

    Chunks hold the draws, this one as the given number.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        if dims <= BLOCK_DIMS:
            found = ((tree.rows, drawn[:, number], tree.nearest(shared.value)[1]) for tree, drawn in _read(parts, dims))
        else:
            found = ((rows[:, :dims], rows[:, dims], nearest(rows[:, :dims], shared.value)[1]) for rows in map(_matrix, parts))
        for rows, drawn, far in found:
            ok = far > 0
            key = -np.log1p(-drawn[ok]) / far[ok]
            mine = np.column_stack([rows[ok], key])
            if len(mine) > most and best is not None and len(best) == most:
                mine = mine[key <= best[-1, dims]]
            best = np.unique(mine if best is None else np.vstack([best, mine]), axis=0)
            best = best[np.argsort(best[:, dims], kind="stable")[:most]]
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.T], names=names)

    names = [*[f"x{j}" for j in range(dims)], "key"]
    shared = points.sparkSession.sparkContext.broadcast(centres)
    rows = points if dims <= BLOCK_DIMS else points.withColumn("u", draw)
    rows = rows.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    got = rows.distinct().orderBy(*reversed(names)).limit(most).toPandas()
    shared.destroy()
    return got[names[:-1]].to_numpy()


def _first_row(points: DataFrame, dims: int) -> np.ndarray:
    """The row of the chunks with the smallest first draw, then the smallest features; empty without rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, drawn in _read(parts, dims):
            mine = tree.rows[drawn[:, 0] == drawn[:, 0].min()]
            row = mine[np.lexsort(mine.T[::-1])[0]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (drawn[:, 0].min(), *row)], names=names)

    names = ["u", *[f"x{j}" for j in range(dims)]]
    got = points.mapInArrow(run, ", ".join(f"{c} double" for c in names)).orderBy(*names).limit(1).toPandas()
    return got[names[1:]].to_numpy(dtype=np.float64)


def _plus_plus(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates, each drawn by weight times squared distance to those drawn before."""
    take = [rng.choice(len(candidates), p=weight / weight.sum())]
    far = ((candidates - candidates[take[0]]) ** 2).sum(axis=1)
    while len(take) < k:
        mass = weight * far
        take.append(rng.choice(len(candidates), p=mass / mass.sum()) if mass.sum() > 0 else int(far.argmax()))
        far = np.minimum(far, ((candidates - candidates[take[-1]]) ** 2).sum(axis=1))
    return candidates[take]


def _draw(dims: int, seed: int, i: int) -> Column:
    """Number in [0, 1) from a hash of a row's features."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"x{j}") for j in range(dims)], F.lit(seed), F.lit(i)), 11) / F.lit(float(1 << 53))


def _first_centres(points: DataFrame, dims: int, k: int, starts: int, seed: int) -> np.ndarray:
    """First centres of all starts: shared candidates far from each other, weighted by the rows nearest to them.

    With no more than k different candidates each of them is a centre.
    """
    if dims <= BLOCK_DIMS:
        candidates = _first_row(points, dims)
    else:
        candidates = np.array(points.orderBy(_draw(dims, seed, 0), *points.columns).limit(1).toPandas(), dtype=np.float64)
    if not len(candidates):
        raise ValueError("no row has all features")
    for i in range(1, SEED_PASSES + 1):
        more = _far_rows(points, dims, candidates, _draw(dims, seed, i), i, 2 * k)
        candidates = np.unique(np.vstack([candidates, more]), axis=0)
    if len(candidates) <= k:
        return np.repeat(candidates[None], starts, axis=0)
    weight = _totals(points, candidates[None])[0, :, 0]
    return np.stack([_plus_plus(candidates, weight, k, np.random.default_rng([seed, s])) for s in range(starts)])


def fit(
    df: DataFrame, features: Sequence[str], k: int = 750, share: float = 0.25, starts: int = 32, max_iter: int = 30,
    seed: int = 0, row_key: Sequence[str] | None = None, initial: DataFrame | None = None, tolerance: float = 1e-4,
) -> Clusters:
    """Best of `starts` k-means runs on a share of the rows, all in one pass over them per round.

    A start drops out when no centre of it moves by more than `tolerance`. A centre
    without rows stays. The share is drawn by a hash of `row_key`. `initial` gives the first
    centres instead: columns `start`, `centre` (both from 0) and the features, the same
    number of centres for each start. Rows with a null or non-finite feature take no
    part; without any other row it is an error. With fewer different rows than k
    there are fewer centres.
    """
    part = df.filter(complete(features))
    if share < 1:
        part = part.filter(hash_below(share, *[F.col(c) for c in row_key], str(seed))) if row_key else part.sample(share, seed)
    points = part.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    if len(features) <= BLOCK_DIMS:
        points = _chunks(points, len(features), [_draw(len(features), seed, i) for i in range(SEED_PASSES + 1)])
    else:
        points = cut_lineage(spread(points), "points")
    if initial is None:
        centres = _first_centres(points, len(features), k, starts, seed)
    else:
        given = initial.select("start", "centre", *[F.col(c).cast("double").alias(c) for c in features]).orderBy("start", "centre").toPandas()
        centres = given[list(features)].to_numpy().reshape(given["start"].nunique(), -1, len(features))
    moving, rounds = np.arange(len(centres)), np.zeros(len(centres), dtype=int)
    for _ in range(max_iter):
        total = _totals(points, centres[moving])
        n = total[:, :, :1]
        moved = np.where(n > 0, total[:, :, 2:] / np.maximum(n, 1), centres[moving])
        way = np.sqrt(((moved - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
        centres[moving] = moved
        rounds[moving] += 1
        moving = moving[way > tolerance]
        if not len(moving):
            break
    costs = _totals(points, centres)[:, :, 1].sum(axis=1)
    best = int(costs.argmin())
    return Clusters(centres[best].copy(), float(costs[best]), costs.tolist(), rounds.tolist())


def _gather(parts: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """`CHUNK` rows together, and the rest."""
    held = np.zeros((0, 0))
    for part in parts:
        rows = part.to_numpy(dtype=np.float64)
        held = np.concatenate([held, rows]) if len(held) else rows
        while len(held) >= CHUNK:
            yield held[:CHUNK]
            held = held[CHUNK:]
    if len(held):
        yield held


def _nearest_of(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest`, by a tree of the rows where there are few features and many centres."""
    if not len(rows) or rows.shape[1] > BLOCK_DIMS or len(centres) < 2 * LEAF:
        return nearest(rows, centres)
    order = in_blocks(rows, LEAF)
    state, far = np.empty(len(rows), np.int64), np.empty(len(rows))
    state[order], far[order] = Tree(rows[order]).nearest(centres)
    return state, far


def assign(df: DataFrame, clusters: Clusters, features: Sequence[str], state: str = "state", distance: str | None = None) -> DataFrame:
    """Append the nearest centre of each row, the lower number on ties, and on request the squared distance.

    Both are null where a feature is null or not finite.
    """
    centres = clusters.centres

    @F.pandas_udf("state int, distance double")
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _gather(parts):
            at, far = _nearest_of(rows, centres)
            yield pd.DataFrame({"state": at.astype(np.int32), "distance": far})

    ok = complete(features)
    x = F.struct(*[F.when(ok, F.col(c).cast("double")).otherwise(0.0).alias(f"x{j}") for j, c in enumerate(features)])
    out = df.withColumn("__near", find(x))
    new = {state: F.when(ok, F.col("__near.state"))}
    if distance:
        new[distance] = F.when(ok, F.col("__near.distance"))
    return out.withColumns(new).drop("__near")


def assign_all(df: DataFrame, models: Sequence[Clusters], features: Sequence[str], states: str = "states") -> DataFrame:
    """Append the nearest centre under every model as an array, in one pass over the rows; null where `assign` gives null.

    What is sent to the tasks is models x centres x features.
    """
    shared = df.sparkSession.sparkContext.broadcast([m.centres for m in models])

    @F.pandas_udf("array<int>")
    def find(rows: pd.DataFrame) -> pd.Series:
        x = rows.to_numpy(dtype=np.float64)
        return pd.Series(list(np.stack([_nearest_of(x, c)[0] for c in shared.value], axis=1).astype(np.int32)))

    ok = complete(features)
    x = F.struct(*[F.when(ok, F.col(c).cast("double")).otherwise(0.0).alias(f"x{j}") for j, c in enumerate(features)])
    return df.withColumn("__all", find(x)).withColumn(states, F.when(ok, F.col("__all"))).drop("__all")
