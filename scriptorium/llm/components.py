"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_joined, release_memory, stored

#: Links up to this many (4 MB, some 50 MB of a worker with what goes with them) are joined by one task; more by rounds over all.
FEW_LINKS = 250_000


def least_reachable(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least that each one reaches."""
    nodes, ends = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    above = list(range(len(nodes)))

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for x, y in zip(ends[: len(hi)].tolist(), ends[len(hi) :].tolist()):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    return nodes, nodes[np.fromiter(map(top, range(len(nodes))), np.int64, len(nodes))]


def _alone(batches):
    """All links at once."""
    if held := [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for batch in batches if batch.num_rows]:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, least_reachable(*map(np.concatenate, zip(*held))))), ["node", "root"])
        del held
    release_memory()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``, root being the least node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014):
    each node hands its larger, then its smaller neighbours to the least one it
    knows, until every node has one link, to its root.  Least neighbours are
    aggregated before they are joined, and sent to all tasks for nodes with very
    many links, so no task holds the links of one node.  Each round is a table in
    the shared folder, and a dozen exchanges that cost the driver threads and memory
    however few the links are, so ``FEW_LINKS`` or less are left to one task instead.
    Links of a node to itself and nulls are ignored; a node without links has no row.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    state, before = stored(pairs, "links"), None
    for _ in range(most_rounds):
        count = state.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(count) == before or not count[0]:
            break
        if count[0] <= FEW_LINKS:
            return state.select("hi", "lo").coalesce(1).mapInArrow(_alone, "node long, root long")
        before = tuple(count)
        both = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(state.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = hot_joined(both, least, "u", 2 * count[0]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = hot_joined(large, least, "hi", 2 * count[0]).select(F.inline(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))).where("hi <> lo").distinct()
        after = stored(small, "links")
        discard(state)
        state = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(state.select(F.col("lo"), F.col("lo")).distinct())
