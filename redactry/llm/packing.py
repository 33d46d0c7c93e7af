"""Problem 9: items into containers of a fixed capacity by multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.sources.tables import checkpointed

#: Tokens a container holds.
CAPACITY = 8192
#: Items a group holds on average. A group has about this many items whatever the
#: input's size, so its memory and its share of unused space don't depend on it.
GROUP_ITEMS = 1024
#: Groups a task packs, and the most tasks there are: an explicit number, as the rows are too small to be split by bytes.
TASK_GROUPS, MOST_TASKS = 4, 20_000


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Karmarkar-Karp with k ways: (sums, members of each way).

    Every item starts as a partition of its own. The two of the largest spread are
    merged, the heaviest way of one with the lightest of the other.
    """
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-int(s) if k > 1 else 0, i, sums, [[i], *([] for _ in range(k - 1))]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        sums, members = a + b[::-1], [p + q for p, q in zip(x, reversed(y))]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n, sums, [members[j] for j in order]))
        n += 1
    _, _, sums, members = heap[0]
    return sums, members


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item (every size is at most the capacity); starts at the least count and rises by what overflows,
    one at least."""
    out = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return out
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sums, members = difference(sizes, k)
        if sums.max() <= capacity:
            break
        k += max(1, int(np.maximum(sums - capacity, 0).sum()) // capacity)
    for j, items in enumerate(members):
        out[items] = j
    return out


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(id, part_no, size, container), one row per item or part.

    Items above the capacity are cut into full parts and one rest; all others stay
    whole. A null size counts as 0; items of size 0 are placed like any other.
    Repeated ids are separate items. An empty table gives no row.

    Items are dealt to groups by a hash of id and row, so equal ids or sizes can't
    gather in one task, and the groups are packed independently.
    """
    kind = dict(items.dtypes)[id_col]
    sizes = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("size"))
    sizes = checkpointed(sizes).withColumn("row", F.monotonically_increasing_id())
    groups = max(1, -(-sizes.count() // group_items))
    full = F.when(F.col("size") > capacity, F.floor((F.col("size") - 1) / capacity)).otherwise(0)
    parts = sizes.withColumn("part_no", F.explode(F.sequence(F.lit(0), full.cast("int")))).withColumn("size", F.least(F.lit(capacity), F.col("size") - F.col("part_no") * capacity)).withColumn("grp", F.pmod(F.xxhash64("id", "row", "part_no"), F.lit(groups)))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row", "part_no"], ascending=[False, True, True], kind="stable")
        pdf["container"] = key[0] << 20 | fill(pdf["size"].to_numpy(np.int64), capacity)
        return pdf[["id", "part_no", "size", "container"]]

    tasks = min(MOST_TASKS, -(-groups // TASK_GROUPS))
    return parts.repartition(tasks, "grp").groupBy("grp").applyInPandas(one, f"id {kind}, part_no int, size bigint, container bigint").withColumnRenamed("id", id_col)
