"""Hierarchical weighted hash tree: regions, racks and shards, each level chosen by weighted hash draws.

At a node a key draws -ln(u) / weight for each child, u hashed from the key and the child's name, and goes to the least
draw; a child's share is its weight. A child whose weight stays keeps its draws, so a change of weights moves keys only
into or out of the subtrees that changed. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import free_names, load

#: (region, rack, weight) of the shards 0, 1, 2, ...
Tree = Sequence[tuple[str, str, float]]
REGIONS, RACKS, PER_RACK = 3, 2, 4


def tree(shards: int) -> Tree:
    """The first 24 shards stand in 3 regions of 2 racks of 4. Each later shard is a region of its own, so that it changes
    the weight of no other subtree: one more shard takes rows only into itself."""
    size = RACKS * PER_RACK
    return [(f"r{i // size}", f"k{i // PER_RACK % RACKS}", 1.0) if i < REGIONS * size else (f"s{i}", "k0", 1.0) for i in range(shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(name)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _least(options: list[tuple[Column, Column]]) -> Column:
    """The value of the option with the least draw, the first on a tie."""
    if len(options) == 1:
        return options[0][1]
    return F.least(*[F.struct(draw.alias("d"), F.lit(i).alias("i"), value.alias("v")) for i, (draw, value) in enumerate(options)])["v"]


def shard_of(key: Column, nodes: Tree) -> Column:
    """The shard (a place in nodes) of a key. Shards of weight 0 get nothing."""
    weights: dict[str, dict[str, dict[int, float]]] = {}
    for i, (region, rack, weight) in enumerate(nodes):
        if weight > 0:
            weights.setdefault(region, {}).setdefault(rack, {})[i] = weight
    regions = []
    for region, racks in weights.items():
        per_rack = []
        for rack, shards in racks.items():
            leaf = _least([(_draw(key, f"shard {i}", w), F.lit(i)) for i, w in shards.items()])
            per_rack.append((_draw(key, f"{region}/{rack}", math.fsum(shards.values())), leaf))
        regions.append((_draw(key, region, math.fsum(w for s in racks.values() for w in s.values())), _least(per_rack)))
    return _least(regions)


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32 long, law string ('key'), shard int, slot long (0, 1, ... in each shard), grown_shard int
    (the shard if there were one more).

    size: UTF-8 bytes of the text (null: none) and 8. Rows with a null key share one, as do rows that repeat a key. Slots: each
    input partition counts its rows of a shard; a running sum over the partitions' counts (shards times partitions rows, not
    documents) puts them one after the other. The numbered rows are checkpointed in between, so they don't change when an
    executor is lost.
    """
    docs = free_names(docs, ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "_part", "_row"])
    spark = docs.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from docrecon.llm.common import scratch_dir

        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    text = F.coalesce(F.col("text"), F.lit(""))
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = docs.select(
        *[c for c in docs.columns if c != "text"], (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(k, tree(shards)).cast("int").alias("shard"), shard_of(k, tree(shards + 1)).cast("int").alias("grown_shard"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"),
    ).checkpoint()
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    bases = counts.select("shard", "_part", (F.sum("n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("n")).alias("base"))
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row")).cast("long") - 1
    numbered = placed.withColumn("own", own)
    return numbered.join(bases, ["shard", "_part"]).withColumn("slot", F.col("base") + F.col("own")).drop("_part", "_row", "base", "own")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
