"""Training batches: length buckets with the least padding, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths up to this have an entry of their own in the histogram: all have.
FINE = (1 << 63) - 1


def word_count(text: Column) -> Column:
    """Runs of non-blank characters of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def best_edges(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper edges of at most `buckets` buckets over a sorted histogram that make the padding, the sum of edge - length, least.

    Dynamic programming over (buckets used, lengths covered). The padding of a bucket obeys the quadrangle inequality, so the
    best start of the last bucket moves only forward and each layer is solved by divide and conquer.
    """
    n = len(lengths)
    docs = np.r_[0.0, np.cumsum(counts, dtype=float)]
    tokens = np.r_[0.0, np.cumsum(lengths * counts.astype(float))]
    cost = np.r_[0.0, np.full(n, np.inf)]
    choice = []
    for _ in range(min(buckets, n)):
        new, pick = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            start = np.arange(first, min(mid - 1, last) + 1)
            pad = cost[start] + lengths[mid - 1] * (docs[mid] - docs[start]) - (tokens[mid] - tokens[start])
            at = int(np.argmin(pad))
            new[mid], pick[mid] = pad[at], start[at]
            todo += [(low, mid - 1, first, pick[mid]), (mid + 1, high, pick[mid], last)]
        choice.append(pick)
        cost = np.r_[np.inf, new[1:]]
    edges, at = [], n
    for pick in reversed(choice):
        if at == 0:
            break
        edges.append(int(lengths[at - 1]))
        at = pick[at]
    return edges[::-1]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 65_536, parts: int | None = None,
) -> DataFrame:
    """Give every document a length bucket and a batch: `id_col`, `n_tokens`, `bucket`, `bucket_len`, `batch`, `slot`.

    `length` counts a document's tokens (its words, if not given). The exact histogram of all lengths comes to the
    driver, where the bucket edges of the least padding are found; it has an entry for each distinct length, of which n need
    n * (n + 1) / 2 tokens at least, so entries grow with the root of the tokens at most. Every document is padded to the
    edge of its bucket (`bucket_len`); batch b of a bucket holds the documents numbered b * m to b * m + m - 1 of it, with
    m = max(1, budget // bucket_len), so only the last batch of a bucket is short. A document longer than the budget is a
    batch of its own, whole.

    Numbers within a bucket go by part (a hash of the id and length) and then by id; parts are numbered on their own and
    their counts added up, so a bucket with a third of all documents is no single task. `parts` is the shuffle setting if
    not given. Documents of no token (null or blank text) have no bucket, batch or slot. Rows with null or repeated ids are
    documents like any other; among rows alike in id and length the order is free. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    count = word_count(F.col(text_col).cast("string")) if length is None else length.cast("long")
    sized = docs.select(F.col(id_col).alias("id"), count.alias("n_tokens"))
    full = sized.where("n_tokens > 0")
    bins = full.groupBy("n_tokens").count().toArrow()
    lengths, counts = (bins.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "count"))
    order = np.argsort(lengths)
    edges = best_edges(lengths[order], counts[order], buckets)

    edge = F.lit(None).cast("long")
    number = F.lit(None).cast("int")
    for i in range(len(edges) - 1, -1, -1):
        fits = F.col("n_tokens") <= edges[i]
        edge, number = F.when(fits, F.lit(edges[i]).cast("long")).otherwise(edge), F.when(fits, F.lit(i)).otherwise(number)
    placed = full.withColumns({"bucket_len": edge, "bucket": number, "part": F.pmod(F.xxhash64("id", "n_tokens"), F.lit(parts))})

    counted = placed.groupBy("bucket", "part").count()
    before = counted.selectExpr("bucket", "part", "sum(count) over (partition by bucket order by part rows between unbounded preceding and 1 preceding) as before")
    within = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(F.col("id").asc_nulls_last(), "n_tokens")) - 1
    numbered = placed.withColumn("at", within).join(before, ["bucket", "part"]).withColumn("number", F.col("at") + F.coalesce("before", F.lit(0)))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    packed = numbered.select("id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("number") / each).alias("batch"), (F.col("number") % each).cast("int").alias("slot"))
    empty = sized.where("n_tokens = 0").selectExpr("id", "n_tokens", "cast(null as int) as bucket", "cast(null as long) as bucket_len", "cast(null as long) as batch", "cast(null as int) as slot")
    return packed.union(empty).select(F.col("id").cast(kind).alias(id_col), "n_tokens", "bucket", "bucket_len", "batch", "slot")
