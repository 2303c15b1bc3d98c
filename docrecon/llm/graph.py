"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import saved


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for links a-b, without the roots themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], np.int64)
    other = roots != np.arange(len(nodes))
    return nodes[other], nodes[roots[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of links as stars that connect the same nodes."""
    for x in batches:
        if x.num_rows:
            a, b = union_find(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


#: Links of a node that one task may join; nodes with more are hubs, of which there are MAX_HUBS at most.
HUB, MAX_HUBS = 512, 100_000


def with_least(rows: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) with m, the least v of u; and (u, m). Nodes with more than `hub` rows are joined by broadcast, so that
    none is a single task's work; rows / hub bounds how many there are. The least is taken from partial ones."""
    least = saved(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    plain = least.select("u", "m")
    large = least.where(F.col("n") > hub).select("u", "m")
    if not large.take(1):
        return rows.join(plain.hint("merge"), "u").select("u", "v", "m"), plain
    hubs = F.broadcast(large)
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m").hint("merge"), "u")
    return rows.join(hubs, "u").select("u", "v", "m").union(others.select("u", "v", "m")), plain


def components(links: DataFrame) -> DataFrame:
    """(node long, component long) for the nodes of links (a long, b long) that aren't the least of their component.

    Rounds grow with the logarithm of the size of a component. Links go to no driver.
    """
    links = links.select(F.col(links.columns[0]).alias("a"), F.col(links.columns[1]).alias("b")).where("a <> b")
    links = saved(links.mapInArrow(_contract, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.max(F.col("a"))).first())

    before = state(links)
    while before[0]:
        hub = max(HUB, 2 * before[0] // MAX_HUBS)
        both, _ = with_least(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))), hub)
        large = both.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        lower, low = with_least(down, hub)
        links = saved(lower.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(low).distinct())
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
