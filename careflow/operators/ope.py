"""Off-policy evaluation and model selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from careflow.functions.scalar import hash_below, hash_order, hash_unit
from careflow.operators.scan import (
    exact_quantiles, find_hot, following, join_null_safe, number_rows, remaining_sum, row_number, scan,
)
from careflow.session import cut_lineage, spread

SMALLEST = 1e-100
#: Standard deviations around a sample's expected cut within which stays are ranked one by one.
REACH = 4.0
#: Stays whose hashes a task holds at a time.
SLAB = 256


def future_returns(
    df: DataFrame, keys: Sequence[str], order: str, reward: str, gamma: float, name: str = "ret",
    last: str | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Discounted reward after each row: sum of gamma^(k-1) r over the rows k steps ahead, 0 for the last.

    With `last` a column of that name marks the last row of each key.

    Long series are cut into blocks in which gamma^steps stays representable. What
    lies more than a block ahead weighs under 1e-100 and only the next block's total
    is carried over, so the result is exact to double precision.
    """
    keys = list(keys)
    block = None if gamma >= 1 else max(1, math.floor(math.log(SMALLEST) / math.log(gamma))) if gamma > 0 else 1
    hot = 0 if block and not find_hot(df, keys, order, block) else None
    steps = {"__i": row_number(), "__r": following(F.struct(F.col(reward).cast("double").alias("r")))}
    ahead = scan(df, keys, [order], steps, hot_rows, hot)
    if last:
        ahead = ahead.withColumn(last, F.col("__r").isNull())
    ahead = ahead.withColumn("__r", F.coalesce(F.col("__r")["r"], F.lit(0.0)))
    if gamma >= 1:
        return scan(ahead, keys, [order], {name: remaining_sum(F.col("__r"))}, hot_rows).drop("__i", "__r")
    if hot == 0:
        w = F.pow(F.lit(gamma), F.col("__i") - 1)
        out = scan(ahead, keys, [order], {name: remaining_sum(F.col("__r") * w)}, hot_rows, hot)
        return out.withColumn(name, F.col(name) / w).drop("__i", "__r")
    k = (F.col("__i") - 1) % block
    w = F.pow(F.lit(gamma), k)
    cut = ahead.withColumn("__b", F.floor((F.col("__i") - 1) / block))
    inner = scan(cut, [*keys, "__b"], [order], {name: remaining_sum(F.col("__r") * w)}, hot_rows)
    ahead_sum = cut.groupBy(*keys, (F.col("__b") - 1).alias("__b")).agg(F.sum(F.col("__r") * w).alias("__c"))
    out = join_null_safe(inner, ahead_sum, [*keys, "__b"], "left")
    carried = F.coalesce("__c", F.lit(0.0)) * F.pow(F.lit(gamma), block - k)
    return out.withColumn(name, F.col(name) / w + carried).drop("__i", "__r", "__b", "__c")


def averaged_q(
    updates: DataFrame, keys: Sequence[str], order: Sequence[str], ret: str, alpha: float = 0.1,
    hot_rows: int | None = None,
) -> DataFrame:
    """Q after the updates `Q = (1 - alpha) Q + alpha G` of each key, applied from the *last* row in `order` to the first.

    The value is the weighted sum of the returns, so no order-dependent loop is left:
    the k-th update from the end weighs alpha (1 - alpha)^k.
    """
    ranked = scan(updates, keys, order, {"__k": row_number()}, hot_rows)
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("__k") - 1)
    return ranked.groupBy(*keys).agg(F.sum(weight * F.col(ret)).alias("q"))


def sampled_traces(
    stays: DataFrame, stay: str, draws: int, replicates: int = 1, seed: str = "trace", first: int = 0, last: int | None = None,
) -> DataFrame:
    """Stays drawn with replacement: `(replicate, draw, stay)`, reproducible from the seed.

    `first` and `last` ask for the draws of that half-open range only, the same ones as in the whole.
    """
    return _pick(_numbered(stays, stay), draws, replicates, seed, first, last)


def _numbered(stays: DataFrame, stay: str) -> tuple[DataFrame, int]:
    numbered = number_rows(stays.select(stay).distinct(), [stay], "__row")
    return numbered, numbered.count()


def _pick(numbered: tuple[DataFrame, int], draws: int, replicates: int, seed: str, first: int, last: int | None) -> DataFrame:
    rows, n = numbered
    part = (draws if last is None else last) - first
    i = F.col("id")
    replicate, draw = F.floor(i / part).cast("int"), i % part + first
    picks = rows.sparkSession.range(part * replicates).select(
        replicate.alias("replicate"), draw.alias("draw"),
        (F.floor(hash_unit(replicate.cast("long") * draws + draw, seed) * n) + 1).alias("__row"),
    )
    return picks.join(rows, "__row").drop("__row")


def trace_updates(records: DataFrame, gamma: float = 0.99, alpha: float = 0.1, hot_rows: int | None = None) -> DataFrame:
    """What one draw of a stay does to each Q it meets: `n` updates that turn Q into `(1 - alpha)^n Q + v`.

    A trace updates from its end to its start. Its last row and rows without an action update nothing.
    """
    rets = future_returns(records, ["icustayid"], "bloc", "reward", gamma, "g", last="__last")
    rows = cut_lineage(rets.filter(~F.col("__last") & (F.col("action") >= 0)).select("icustayid", "bloc", "state", "action", "g"), "returns")
    keys = ["icustayid", "state", "action"]
    ranked = scan(rows, keys, ["bloc"], {"__k": row_number()}, hot_rows)
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("__k") - 1)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col("g")).alias("v"))


def _in_turn(updates: DataFrame, keys: Sequence[str], order: str, alpha: float) -> DataFrame:
    """The updates of each key as a single one, the highest `order` applied last."""
    late_first = F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("at"), "n", "v")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("v"))

    def add(done: Column, x: Column) -> Column:
        return F.struct((done["n"] + x["n"]).alias("n"), (done["v"] + F.pow(F.lit(1 - alpha), done["n"]) * x["v"]).alias("v"))

    one = updates.groupBy(*keys).agg(F.aggregate(late_first, start, add).alias("__u"))
    return one.select(*keys, "__u.n", "__u.v")


def drawn_updates(updates: DataFrame, draws: DataFrame, alpha: float = 0.1, block: int = 1024) -> DataFrame:
    """The updates of all draws merged per replicate, state and action: `n` and `v` as in `trace_updates`.

    Merging is associative, so draws are merged in blocks of `block` and then the blocks: a task holds at most a
    block of one key, or one entry per block, whatever share of the rows a key has.
    """
    keys = ["replicate", "state", "action"]
    rows = updates.join(draws, "icustayid").withColumn("__b", F.floor(F.col("draw") / block))
    return _in_turn(_in_turn(rows, [*keys, "__b"], "draw", alpha), keys, "__b", alpha)


def extend_updates(before: DataFrame, after: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Merged updates followed by later ones."""
    both = before.withColumn("__at", F.lit(0)).unionByName(after.withColumn("__at", F.lit(1)))
    return _in_turn(both, ["replicate", "state", "action"], "__at", alpha)


def td_q(
    records: DataFrame, draws: DataFrame, gamma: float = 0.99, alpha: float = 0.1, hot_rows: int | None = None,
) -> DataFrame:
    """Q per replicate from drawn traces, the updates `Q = (1 - alpha) Q + alpha G` from 0 in the order of the draws.

    The last row of a trace and rows without an action update nothing.
    """
    draws = cut_lineage(draws, "draws")
    merged = drawn_updates(trace_updates(records, gamma, alpha, hot_rows), draws, alpha)
    return merged.select("replicate", "state", "action", F.col("v").alias("q"))


def td_q_until_stable(
    records: DataFrame, stays: DataFrame, chunk: int = 50_000, max_draws: int = 300_000, gamma: float = 0.99,
    alpha: float = 0.1, change: float = 0.001, seed: str = "trace",
) -> tuple[DataFrame, int]:
    """Q with more draws in chunks until the sum of Q moves by less than `change` between chunk ends.

    Stays are reduced once and every draw is merged once: a chunk extends the result so far.
    """
    updates = cut_lineage(trace_updates(records, gamma, alpha), "updates")
    rows, n = _numbered(stays, "icustayid")
    numbered = cut_lineage(rows, "numbered"), n
    before, draws, merged = 1.0, 0, None
    while True:
        first, draws = draws, min(draws + chunk, max_draws)
        more = drawn_updates(updates, _pick(numbered, max_draws, 1, seed, first, draws), alpha)
        merged = cut_lineage(more if merged is None else extend_updates(merged, more, alpha), "merged")
        now = merged.agg(F.sum("v")).first()[0] or 0.0
        if draws >= max_draws or (before and abs((now - before) / before) < change):
            return merged.select("replicate", "state", "action", F.col("v").alias("q")), draws
        before = now


def policy_value(records: DataFrame, policy: DataFrame, q: DataFrame, n_states: int) -> DataFrame:
    """Value of a policy per replicate: sum of p*Q per state, weighted by the starting states of the stays."""
    starts = records.filter((F.col("bloc") == 1) & (F.col("state") < n_states)).groupBy("state").agg(
        F.count(F.lit(1)).alias("n")
    )
    n = starts.agg(F.sum("n")).first()[0]
    v = q.join(policy, ["state", "action"]).groupBy("replicate", "state").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
    weighted = v.join(starts, "state").groupBy("replicate").agg(F.sum(F.col("v") * F.col("n")).alias("s"))
    return weighted.select("replicate", (F.col("s") / F.lit(n)).alias("value"))


def stay_ratios(
    df: DataFrame, behaviour: str, target: str, outcome: str, gamma: float = 0.99, reward: float = 100.0,
    stay: str = "icustayid", by: Sequence[str] = (),
) -> DataFrame:
    """Each stay (of each `by`) reduced once to its importance ratio and discounted final reward.

    The ratio is summed in logs. A zero target probability makes it 0, a zero
    behaviour probability makes it null, which drops the stay. The discount starts
    at exponent -1, so a stay of n rows ends at n - 2.
    """
    b, t = F.col(behaviour), F.col(target)
    logs = F.sum(F.when((b > 0) & (t > 0), F.log(t) - F.log(b)))
    ratio = F.when(F.max((b <= 0).cast("int")) == 1, None).when(F.max((t <= 0).cast("int")) == 1, 0.0).otherwise(F.exp(logs))
    n = F.count(F.lit(1))
    final = F.when(F.max(outcome) == 1, -reward).otherwise(reward)
    return df.groupBy(*by, stay).agg(ratio.alias("rho"), (F.pow(F.lit(gamma), n - 2) * final).alias("g"))


def clamped_ratios(
    df: DataFrame, behaviour: str, target: str, reward: str, order: str, gamma: float = 0.99, stay: str = "icustayid",
    floor: float = 1e-30, ceiling: float = 1e4, unseen: float = 0.1,
) -> DataFrame:
    """Ratios kept inside [floor, ceiling]; a zero behaviour probability counts as `unseen`. Step rewards from exponent 0."""
    b = F.when(F.col(behaviour) <= 0, unseen).otherwise(F.col(behaviour))
    rows = scan(df, [stay], [order], {"__i": row_number()})
    zero = F.max((F.col(target) <= 0).cast("int")) == 1
    raw = F.when(zero, 0.0).otherwise(F.exp(F.sum(F.when(F.col(target) > 0, F.log(target) - F.log(b)))))
    g = F.sum(F.pow(F.lit(gamma), F.col("__i") - 1) * F.col(reward))
    return rows.groupBy(stay).agg(F.greatest(F.least(raw, F.lit(ceiling)), F.lit(floor)).alias("rho"), g.alias("g"))


def legacy_ratios(
    df: DataFrame, behaviour: str, target: str, reward: str, order: str, gamma: float = 0.99, stay: str = "icustayid",
) -> DataFrame:
    """Ratios over all rows but the last of a stay, rewards of the following rows; infinite ratios become null."""
    rows = scan(df, [stay], [order], {"__i": row_number(), "__next": following(F.struct(F.col(reward).alias("r")))})
    b, t, inside = F.col(behaviour), F.col(target), F.col("__next").isNotNull()
    bad, none = F.max((inside & (b <= 0)).cast("int")) == 1, F.max((inside & (t <= 0)).cast("int")) == 1
    logs = F.coalesce(F.sum(F.when(inside & (b > 0) & (t > 0), F.log(t) - F.log(b))), F.lit(0.0))
    ratio = F.when(bad, None).when(none, 0.0).otherwise(F.exp(logs))
    g = F.coalesce(F.sum(F.pow(F.lit(gamma), F.col("__i") - 1) * F.col("__next")["r"]), F.lit(0.0))
    return rows.groupBy(stay).agg(ratio.alias("rho"), g.alias("g"))


def weighted_value(ratios: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """sum(rho g) / sum(rho), with the number of stays that have a positive ratio."""
    aggs = [
        F.try_divide(F.sum(F.col("rho") * F.col("g")), F.sum("rho")).alias("wis"),
        F.sum((F.col("rho") > 0).cast("long")).alias("positive"),
    ]
    used = ratios.filter(F.col("rho").isNotNull())
    return used.groupBy(*by).agg(*aggs) if by else used.agg(*aggs)


def _replicates_of(stay: Column, replicates: int, seed: str, share: float) -> Column:
    """Replicate numbers whose hash admits the stay, filtered before any row is made."""
    every = F.sequence(F.lit(0), F.lit(replicates - 1))
    return every if share >= 1 else F.filter(every, lambda r: hash_below(share, stay, r, seed))


def bootstrap_samples(
    ratios: DataFrame, replicates: int = 750, share: float = 0.75, most: int = 25_000, seed: str = "boot",
    stay: str = "icustayid", by: Sequence[str] = (),
) -> DataFrame:
    """Samples without replacement: `replicate` added, min(most, share of the stays) stays each.

    Where the stays far outnumber the sample, a hash filter with a wide margin lets
    only candidates through, so the rows made are replicates times sample size, not
    replicates times stays. A replicate's exact sample is its lowest hashes. With `by`
    each group (say a model) is sampled by itself; groups that share a stay share its hashes.
    """
    if by:
        return _samples_by(ratios, replicates, share, most, seed, stay, list(by))
    total = ratios.count()
    size = min(most, int(total * share))
    need = size / max(total, 1)
    margin = min(1.0, need + 12 * math.sqrt(need / max(total, 1)) + 100 / max(total, 1))
    s = F.col(stay)
    made = spread(ratios).withColumn("replicate", F.explode(_replicates_of(s, replicates, seed, margin)))
    w = Window.partitionBy("replicate").orderBy(hash_order(s, F.col("replicate"), seed), s)
    return made.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= size).drop("__k")


def _samples_by(ratios: DataFrame, replicates: int, share: float, most: int, seed: str, stay: str, by: list[str]) -> DataFrame:
    """Bootstrap samples of each group; the hash of a stay and replicate is made once for all groups, and each tests it against its own margin."""
    n = F.col("__n")
    size = F.least(F.lit(most), F.floor(n * share))
    need = size / n
    margin = F.least(F.lit(1.0), need + 12 * F.sqrt(need / n) + 100 / n)
    totals = ratios.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*by, size.alias("__size"), margin.alias("__margin"))
    kept = [c for c in ratios.columns if c not in (*by, stay)]
    groups = join_null_safe(ratios, totals, by).groupBy(stay).agg(F.collect_list(F.struct(*by, *kept, "__size", "__margin")).alias("__in"))
    made = spread(groups).select(stay, "__in", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    made = made.withColumn("__h", hash_order(F.col(stay), F.col("replicate"), seed))
    at = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    made = made.withColumn("__at", at).withColumn("__in", F.filter("__in", lambda g: F.col("__at") <= g["__margin"]))
    rows = made.select(stay, "replicate", "__h", F.explode("__in").alias("__g")).select(stay, "replicate", "__h", "__g.*")
    w = Window.partitionBy(*by, "replicate").orderBy("__h", stay)
    picked = rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= F.col("__size"))
    return picked.select(*ratios.columns, "replicate")


def _cut_pass(replicates: int, seed: str, stay: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed stays in; out come sums of the stays surely in each sample, one row a group and replicate, and one row for each stay near a cut."""
    sums = ["n", "known", "positive", "rho", "gain"]
    ends = [f"{r}|{seed}".encode() for r in range(replicates)]

    def table(group, replicate, near, values, stays=None) -> pa.RecordBatch:
        cols = {"__group": group, "replicate": replicate, "__near": np.full(len(group), near), **dict(zip(sums, values)), stay: stays}
        cols[stay] = pa.nulls(len(group), schema.field(stay).type) if stays is None else stays
        return pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := cols[f.name], pa.Array) else pa.array(x.astype(f.type.to_pandas_dtype())) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLAB):
                part = batch.slice(at, SLAB)
                digests = b"".join([md5(name + end, usedforsecurity=False).digest() for name in part.column("__name").cast("binary").to_pylist() for end in ends])
                unit = np.frombuffer(digests, ">u4")[::4].reshape(part.num_rows, replicates) / 4294967296.0
                packed = part.column("__in")
                row = np.repeat(np.arange(part.num_rows), packed.value_lengths().to_numpy())
                x = {f.name: v.to_numpy(zero_copy_only=False) for f, v in zip(packed.type.value_type, packed.flatten().flatten())}
                weights = np.stack([np.ones(len(row)), x["known"], x["known"] & (x["rho"] > 0), x["rho"], x["gain"]]).astype(np.float64)
                order = np.argsort(x["group"], kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(x["group"][order])) + 1):
                    g, own, w = int(x["group"][mine[0]]), unit[row[mine]], weights[:, mine]
                    below = own < x["low"][mine[0]]
                    add = w @ below if np.isfinite(w).all() else np.where(below, w[:, :, None], 0.0).sum(axis=1)
                    total[g] = total[g] + add if g in total else add
                    i, r = np.nonzero(~below & (own <= x["high"][mine[0]]))
                    if len(i):
                        yield table(np.full(len(i), g), r, True, w[:, i], part.column(stay).take(pa.array(row[mine][i])))
        for g, add in total.items():
            yield table(np.full(replicates, g), np.arange(replicates), False, add)

    return run


def bootstrap_values(
    ratios: DataFrame, replicates: int = 750, share: float = 0.75, most: int = 25_000, seed: str = "boot",
    stay: str = "icustayid", by: Sequence[str] = ("model",),
) -> DataFrame:
    """`weighted_value` of each group and replicate of `bootstrap_samples`, the same samples without a row for each of their stays.

    A sample is its lowest hashes, and nearly all stays are clearly below or above its cut: tasks add up those below, and
    only the stays within `REACH` standard deviations of the expected cut are ranked, so the rows made grow with the root
    of the sample. A sample whose cut is not there has all its stays ranked. Every group has one row a stay, `g` is not null;
    a task holds sums for each group and replicate.
    """
    by, n, pair = list(by), F.col("__n"), ["__group", "replicate"]
    size = F.least(F.lit(most), F.floor(n * share))
    off = REACH * F.sqrt(size / n * (1 - size / n) / n) + 8 / n
    totals = ratios.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*by, size.alias("__size"), (size / n - off).alias("__low"), (size / n + off).alias("__high"))
    groups = cut_lineage(number_rows(cut_lineage(totals, "totals"), by, "__group"), "groups")
    known = F.col("rho").isNotNull()
    placed = join_null_safe(ratios, groups, by).select(
        "__group", stay, "__low", "__high", "__size", known.alias("known"), F.coalesce("rho", F.lit(0.0)).alias("rho"),
        F.when(known, F.col("rho") * F.col("g")).otherwise(0.0).alias("gain"),
    )
    one = F.struct(F.col("__group").alias("group"), F.col("__low").alias("low"), F.col("__high").alias("high"), "known", "rho", "gain")
    packed = spread(placed.groupBy(stay).agg(F.collect_list(one).alias("__in"))).withColumn("__name", F.concat_ws("|", F.col(stay).cast("string"), F.lit("")))
    kind = ratios.schema[stay].dataType
    ddl = f"__group long, replicate int, __near boolean, n long, known long, positive long, rho double, gain double, `{stay}` {kind.simpleString()}"
    schema = to_arrow_schema(packed.select(F.col(stay)).schema)
    numbers = [("__group", pa.int64()), ("replicate", pa.int32()), ("__near", pa.bool_()), *[(c, pa.int64()) for c in ("n", "known", "positive")], ("rho", pa.float64()), ("gain", pa.float64())]
    parts = cut_lineage(packed.mapInArrow(_cut_pass(replicates, seed, stay, pa.schema([*numbers, schema.field(0)])), ddl), "cuts")
    added = [F.sum(c).alias(c) for c in ("n", "known", "positive", "rho", "gain")]
    sure = parts.filter(~F.col("__near")).groupBy(*pair).agg(*added)
    near = parts.filter("__near")
    wanted = groups.select("__group", "__size").crossJoin(ratios.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")))
    wanted = wanted.join(sure.select(*pair, "n"), pair, "left").join(near.groupBy(*pair).agg(F.count(F.lit(1)).alias("__at")), pair, "left")
    need = F.col("__size") - F.coalesce("n", F.lit(0))
    wanted = cut_lineage(wanted.select(*pair, "__size", need.alias("__need"), F.coalesce("__at", F.lit(0)).alias("__at")), "wanted")
    missed = (F.col("__need") < 0) | (F.col("__need") > F.col("__at"))
    w = Window.partitionBy(*pair).orderBy(hash_order(F.col(stay), F.col("replicate"), seed), F.col(stay))
    ranked = near.repartition(*pair).withColumn("__k", F.row_number().over(w)).join(wanted.filter(~missed), pair).filter(F.col("__k") <= F.col("__need"))
    columns = [*pair, "known", "positive", "rho", "gain"]
    used = sure.join(wanted.filter(~missed), pair, "left_semi").select(*columns).unionByName(ranked.select(*columns))
    again = wanted.filter(missed).select(*pair)
    if not again.isEmpty():
        whole = placed.join(again, "__group").withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= F.col("__size"))
        used = used.unionByName(whole.withColumns({"positive": (F.col("known") & (F.col("rho") > 0)).cast("long"), "known": F.col("known").cast("long")}).select(*columns))
    out = used.groupBy(*pair).agg(*added[1:]).filter("known > 0")
    named = out.join(groups.select("__group", *by), "__group")
    return named.select(*by, "replicate", F.try_divide("gain", "rho").alias("wis"), "positive")


def bernoulli_samples(
    ratios: DataFrame, replicates: int, most: int = 25_000, share: float = 0.75, seed: str = "boot", stay: str = "icustayid",
) -> DataFrame:
    """Samples in which each stay takes part with probability min(most / stays, share)."""
    total = ratios.count()
    p = min(most / max(total, 1), share)
    return spread(ratios).withColumn("replicate", F.explode(_replicates_of(F.col(stay), replicates, seed, p)))


def replicate_stats(values: DataFrame, value: str, keys: Sequence[str] = (), probs: Mapping[str, float] | None = None) -> DataFrame:
    """Mean and quantiles of a bootstrapped value."""
    probs = probs or {"q01": 0.01, "q05": 0.05, "q95": 0.95, "q99": 0.99}
    keys = list(keys)
    q = exact_quantiles(values, keys, value, probs)
    mean = values.groupBy(*keys).agg(F.avg(value).alias("mean")) if keys else values.agg(F.avg(value).alias("mean"))
    if keys:
        return join_null_safe(mean, q, keys)
    (m,) = mean.collect()
    return q.select(F.lit(m["mean"]).cast("double").alias("mean"), *probs)


def pick_models(stats: DataFrame, model: str = "model", bound: str = "q05") -> DataFrame:
    """Best model by its lower bound (above 0) and the worst one; the first model wins ties."""
    at = F.struct(F.col(bound).alias("b"), (-F.col(model)).alias("m"))
    low = F.struct(F.col(bound).alias("b"), F.col(model).alias("m"))
    best = F.max(F.when(F.col(bound) > 0, at))
    return stats.agg(
        (-best["m"]).alias("best_model"), best["b"].alias("best_bound"),
        F.min(low)["m"].alias("worst_model"), F.min(low)["b"].alias("worst_bound"),
    )


def agreement(df: DataFrame, given: str, chosen: str) -> DataFrame:
    """Share of rows where the policy picks the action that was given."""
    return df.agg(F.avg((F.col(given) == F.col(chosen)).cast("double")).alias("agreement"))
