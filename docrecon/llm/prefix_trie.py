"""Prefix trie of conversations: a double-array trie for each shard of prefixes, and global aggregates of what shards share.

Turns are hashed (128 bits), sequences of them grouped, so that copies of a conversation are one row, and dealt by range in the
order of their turns: a shard holds neighbouring prefixes. It numbers its turns densely, packs BASE and CHECK arrays (the child of
state s by turn t is BASE[s] + t if CHECK there is s), walks all its sequences over them and sums up subtrees through CHECK. Only
nodes on the paths of a shard's first and last sequence can be in another shard too. Those, the shared upper nodes, are merged by
their key; what hangs below each is summed along the paths, each node counting on the first path that has it.

A sequence of more than `segment` turns is cut: the rest is a sequence below the node where it was cut, in a layer of its own.
Layers are solved from the deepest up and hand what a subtree holds to the nodes where they hang.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import load, mixed, parallelism, saved, task_number

#: Turns in a sequence of one layer, and turns of all sequences in a shard.
SEGMENT, SHARD = 1 << 18, 1 << 20
#: Bytes of joined ids in a chunk.
IDS = 1 << 20
TURN = "struct<a:bigint,b:bigint,bytes:int>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx long, a, b long, bytes int), saved: the turns of each conversation numbered from 0 in the order of turn (null
    first), then role and text; hashes of role and text, and the text's UTF-8 bytes. Null role and text are empty; rows that
    repeat are turns of their own; rows without conv_id belong to no conversation.

    Rows are dealt by range and numbered in each partition; only a partition's first conversation can have begun in an earlier
    one, so one row a partition tells where it goes on. No conversation has to fit a task.
    """
    spark = conversations.sparkSession
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    slim = rows.select("conv_id", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.octet_length("text").cast("int").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = task_number(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            fresh = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), -1))
            within = np.arange(len(conv)) - start + np.where(start < 0, count - 1, 0)
            last, count = conv[-1], int(within[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within), pa.array(np.full(len(conv), part))], ["conv_id", "a", "b", "bytes", "within", "part"])

    rows = saved(slim.mapInArrow(run, "conv_id long, a long, b long, bytes int, within long, part long"))
    counts = rows.groupBy("part", "conv_id").agg((F.max("within") + 1).alias("n"))
    edges = counts.groupBy("part").agg(F.min("conv_id").alias("first"), F.min_by("n", "conv_id").alias("n_first"), F.max("conv_id").alias("last"), F.max_by("n", "conv_id").alias("n_last"))
    # A conversation over several partitions is the last of one, all of those between, and the first of the last one.
    told = edges.select("part", F.col("last").alias("conv_id"), F.col("n_last").alias("n")).union(edges.select("part", "first", F.lit(0).cast("long")))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = told.groupBy("part", "conv_id").agg(F.sum("n").alias("n")).select("part", "conv_id", F.sum("n").over(earlier).alias("before"))
    before = F.broadcast(before)  # two rows a partition at most
    return rows.join(before, ["part", "conv_id"], "left").select("conv_id", (F.col("within") + F.coalesce("before", F.lit(0))).alias("idx"), "a", "b", "bytes")


def _ends(told: DataFrame) -> DataFrame:
    """(ea, eb, depth, ends_sha256) of told (conv_id, ea, eb, depth): the hash of the ids at each node, ascending and joined by
    commas. Ids are sorted by range and joined within partitions; the hash takes the joined pieces one after the other."""
    key = ["ea", "eb", "depth"]
    dealt = told.repartitionByRange(parallelism(told.sparkSession), *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    piece = "ea long, eb long, depth long, first long, ids binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, ids, size, first = [], None, [], 0, 0

        def close() -> None:
            if now is not None and ids:
                out.append((*now, first, ",".join(ids).encode()))

        for batch in batches:
            for ea, eb, depth, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (ea, eb, depth) != now or size > IDS:
                    close()
                    now, ids, size, first = (ea, eb, depth), [], 0, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _rows(out, piece)
            out = []
        close()
        yield _rows(out, piece)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            out = []
            for *node, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if node != now:
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = node, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            yield _rows(out, "ea long, eb long, depth long, ends_sha256 string")
        if now:
            yield _rows([(*now, h.hexdigest())], "ea long, eb long, depth long, ends_sha256 string")

    pieces = dealt.select(*key, "conv_id").mapInArrow(join, piece)
    return pieces.repartition(parallelism(told.sparkSession), *key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "ea long, eb long, depth long, ends_sha256 string")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


class DoubleArray:
    """BASE and CHECK over states (slots); state 0 is the top. A child's slot is its parent's base and its symbol."""

    def __init__(self, parent: np.ndarray, symbol: np.ndarray):
        """Nodes 1, 2, ... with parents before children, given by parent node and symbol; node 0 is the top."""
        n = len(parent)
        order = np.argsort(parent[1:], kind="stable") + 1
        counts = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n, np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        self.slot = np.zeros(n, np.int64)
        base = np.zeros(n, np.int64)
        widest = int(symbol.max(initial=0)) + 1
        used = np.zeros(n + widest + 64, bool)
        used[0] = True
        many = np.flatnonzero(counts > 1)
        low = 1
        for node in many[np.argsort(-counts[many], kind="stable")]:  # those with most children first
            kids = order[starts[node] : starts[node + 1]]
            symbols = symbol[kids]
            least, span = int(symbols.min()), int(symbols.max())
            while low < len(used) and used[low]:
                low += 1
            at = low - least
            while True:
                if at + span + 64 >= len(used):
                    used = np.concatenate([used, np.zeros(len(used) + at + span + 64 - len(used) + 1, bool)])
                tries = np.arange(at, at + 32)
                free = ~used[np.minimum(tries[:, None] + symbols, len(used) - 1)].any(axis=1)
                if free.any():
                    at += int(free.argmax())
                    break
                at += 32
            base[node] = at
            self.slot[kids] = at + symbols
            used[at + symbols] = True
        single = np.flatnonzero(counts == 1)
        kids = order[starts[single]]
        free = np.flatnonzero(~used)
        if len(free) < len(kids):
            free = np.concatenate([free, np.arange(len(used), len(used) + len(kids) - len(free))])
        self.slot[kids] = free[: len(kids)]
        base[single] = self.slot[kids] - symbol[kids]
        size = int(self.slot.max(initial=0)) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[self.slot] = base
        self.check[self.slot[1:]] = self.slot[parent[1:]]

    def child(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where there is none."""
        to = self.base[states] + symbols
        ok = (to > 0) & (to < len(self.check))
        ok[ok] = self.check[to[ok]] == states[ok]
        return np.where(ok, to, -1)


NODES = "shard long, shared boolean, on_first boolean, on_last boolean, ka long, kb long, depth long, pa long, pb long, parent_shared boolean, conv_id long, parent_conv_id long, bytes long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def solve_shard(shard: int, depth0: int, roots: np.ndarray, lengths: np.ndarray, turns: np.ndarray, sizes: np.ndarray, n: np.ndarray, first: np.ndarray, below: np.ndarray, ends: list) -> pa.RecordBatch:
    """The nodes of a shard's sequences, which are sorted and differ. roots: (r, 2) keys; turns: (t, 2) hashes of all sequences one
    after the other, sizes their bytes; below: (r, 3) children, leaves and saved tokens that hang below a sequence's last node.

    Of a shared node, n_children, n_leaves and saved_tokens are what its own subtree has without shared nodes.
    """
    rows = len(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    pairs = np.ascontiguousarray(np.concatenate([roots, turns])).view([("a", "i8"), ("b", "i8")]).ravel()
    _, dense = np.unique(pairs, return_inverse=True)
    counts = np.bincount(dense)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))  # frequent turns get small numbers
    dense = rank[dense]
    top, seq = dense[:rows], dense[rows:]
    wide = int(dense.max()) + 1
    # Level by level: distinct (parent, turn) pairs are the nodes.
    parents, symbols, levels, depths, bytes_, keys = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [np.full(1, -1)], [np.zeros(1, np.int64)], [np.zeros((1, 2), np.int64)]
    node, active, total, level = np.zeros(rows, np.int64), np.arange(rows), 1, 0
    while len(active):
        what = top[active] if level == 0 else seq[starts[active] + level - 1]
        pair, where, back = np.unique(node[active] * wide + what, return_index=True, return_inverse=True)
        who = active[where]
        parents.append(pair // wide)
        symbols.append(pair % wide)
        depths.append(np.full(len(pair), level))
        if level:
            at = starts[who] + level - 1
            own = _mix(turns[at], depth0 + level - 1)
            keys.append(keys[-1][node[who] - levels[-1]] ^ own)
            bytes_.append(sizes[at].astype(np.int64))
        else:
            keys.append(roots[who])
            bytes_.append(np.zeros(len(pair), np.int64))
        levels.append(total)
        node[active] = total + back
        total += len(pair)
        level += 1
        active = active[lengths[active] >= level]
    parent, symbol, depth, size, key = (np.concatenate(x) for x in (parents, symbols, depths, bytes_, keys))
    trie = DoubleArray(parent, symbol)
    of_slot = np.full(len(trie.base), -1, np.int64)
    of_slot[trie.slot] = np.arange(total)
    # The walk: each sequence from state to state.
    passing, least = np.zeros(len(trie.base), np.int64), np.full(len(trie.base), np.iinfo(np.int64).max)
    state, active, level = np.zeros(rows, np.int64), np.arange(rows), 0
    while len(active):
        state[active] = trie.child(state[active], top[active] if level == 0 else seq[starts[active] + level - 1])
        np.add.at(passing, state[active], n[active])
        np.minimum.at(least, state[active], first[active])
        level += 1
        active = active[lengths[active] >= level]
    last = of_slot[state]
    shared = np.zeros(total, bool)
    marks = np.zeros((2, total), bool)
    for mark, row in ((0, 0), (1, rows - 1)):
        x = int(last[row])
        while x:
            marks[mark, x] = shared[x] = True
            x = int(parent[x])
    shared[0] = True
    passing, least = passing[trie.slot], least[trie.slot]
    hung = np.zeros((total, 3), np.int64)
    hung[last] = below
    children, leaves, saving = hung[:, 0].copy(), hung[:, 1].copy(), hung[:, 2].copy()
    np.add.at(children, parent[1:], ~shared[1:])
    saving[~shared] += ((passing - 1) * size)[~shared]
    leaves[~shared & (children == 0)] = 1
    bounds = [*levels, total]
    up = of_slot[trie.check[trie.slot[1:]]]  # the parent, by CHECK
    for lo, hi in zip(bounds[-2::-1], bounds[:0:-1]):
        own = np.arange(lo, hi)[~shared[lo:hi]]
        np.add.at(leaves, up[own - 1], leaves[own])
        np.add.at(saving, up[own - 1], saving[own])
    sha: list = [None] * total
    for row, text in zip(last.tolist(), ends):
        sha[row] = text
    pick = np.arange(1, total)
    inner = depth[pick] > 0
    over = parent[pick]
    told = [
        pa.array(np.full(len(pick), shard)), pa.array(shared[pick]), pa.array(marks[0, pick]), pa.array(marks[1, pick]), pa.array(key[pick, 0]), pa.array(key[pick, 1]), pa.array(depth[pick] + depth0),
        pa.array(key[over, 0], mask=~inner), pa.array(key[over, 1], mask=~inner), pa.array(shared[over] & inner), pa.array(least[pick]), pa.array(least[over], mask=~inner | shared[over]), pa.array(size[pick]),
        pa.array(passing[pick]), pa.array(children[pick]), pa.array(leaves[pick]), pa.array(saving[pick]), pa.array(sha[1:], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(told, [x.split()[0] for x in NODES.split(", ")])


def _mix(turns: np.ndarray, idx: np.ndarray | int) -> np.ndarray:
    """What the turns at these places add (by exclusive or) to both halves of a node's key."""
    out = np.empty_like(turns)
    a, b, place = turns[:, 0].astype(np.uint64), turns[:, 1].astype(np.uint64), np.atleast_1d(np.asarray(idx, np.uint64)) * np.uint64(2) + np.uint64(1)
    for half, seed in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F)):
        out[:, half] = mixed(mixed(a + place * np.uint64(seed)) ^ b + np.uint64(seed)).astype(np.int64)
    return out


def _layer(sequences: DataFrame, depth0: int, shard_turns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (ka, kb, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of a layer's
    sequences (ra, rb, seq, n, first, children, leaves, saved, ends_sha256), but for the roots; and the roots."""
    spark = sequences.sparkSession
    dealt = sequences.repartitionByRange(parallelism(spark), "ra", "rb", "seq").sortWithinPartitions("ra", "rb", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, shard, held, size = task_number() << 32, 0, [], 0

        def solved() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("seq").chunk(0)
            flat = lists.flatten()
            a, b, sizes = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            column = lambda c: t.column(c).to_numpy().astype(np.int64)
            below = np.stack([column("children"), column("leaves"), column("saved")], axis=1)
            lengths = lists.value_lengths().to_numpy().astype(np.int64)
            return solve_shard(base + shard, depth0, np.stack([column("ra"), column("rb")], axis=1), lengths, np.stack([a, b], axis=1).astype(np.int64), sizes, column("n"), column("first"), below, t.column("ends_sha256").to_pylist())

        for batch in batches:
            at = 0
            lengths = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            while at < batch.num_rows:
                fit = int(np.searchsorted(np.cumsum(lengths[at:] + 1), shard_turns - size, side="right"))
                fit = fit or (not held)
                if fit:
                    held.append(batch.slice(at, fit))
                    size += int(lengths[at : at + fit].sum() + fit)
                    at += fit
                if at < batch.num_rows:
                    yield solved()
                    shard, held, size = shard + 1, [], 0
        if held:
            yield solved()

    nodes = saved(dealt.select("ra", "rb", "seq", "n", "first", "children", "leaves", "saved", "ends_sha256").mapInArrow(run, NODES))
    key = ["ka", "kb", "depth"]
    edge = nodes.where("shared")
    merged = edge.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.max("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("own_children"),
        F.sum("n_leaves").alias("own_leaves"), F.sum("saved_tokens").alias("own_saved"), F.max("ends_sha256").alias("ends_sha256"),
    )
    kids = merged.where("pa is not null").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, key, "left").withColumn("n_children", F.col("own_children") + F.coalesce("kids", F.lit(0)))
    merged = merged.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(F.col("own_leaves"))).withColumn("value", (F.col("n_convs") - 1) * F.col("bytes") + F.col("own_saved"))
    merged = saved(merged.select(*key, "pa", "pb", "conv_id", "n_convs", "n_children", "leaf", "value", "ends_sha256"))
    # Paths: each node counts on the first path that has it; sums run from a path's end up, then over the paths of a node.
    steps = edge.select(*key, F.explode(F.expr("filter(array(IF(on_first, 2 * shard, NULL), IF(on_last, 2 * shard + 1, NULL)), x -> x IS NOT NULL)")).alias("path"))
    owner = steps.groupBy(*key).agg(F.min("path").alias("owner"))
    steps = steps.join(owner.join(merged.select(*key, "leaf", "value"), key), key)
    upward = Window.partitionBy("path").orderBy(F.desc("depth"))
    own = lambda c: F.sum(F.when(F.col("path") == F.col("owner"), F.col(c)).otherwise(0)).over(upward)
    sums = steps.select(*key, own("leaf").alias("leaf"), own("value").alias("value")).groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum("value").alias("saved_tokens"))
    merged = merged.drop("leaf", "value").join(sums, key)
    names = [*key, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = merged.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    upper = merged.where("pa is not null").join(above, ["pa", "pb", "depth"]).select(*names)
    plain = nodes.where("not shared and not parent_shared and pa is not null").select(*names)
    # A shared node may have any number of children: each shard asks for its own nodes' parents.
    asked = edge.select("shard", F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth")).join(above, ["pa", "pb", "depth"])
    hanging = nodes.where("not shared and parent_shared").drop("parent_conv_id").join(asked, ["shard", "pa", "pb", "depth"]).select(*names)
    no_parent = F.lit(None).cast("long").alias("parent_conv_id")
    roots = merged.where("pa is null").withColumn("parent_conv_id", no_parent).select(*names).union(nodes.where("not shared and pa is null").withColumn("parent_conv_id", no_parent).select(*names))
    return plain.union(upper).union(hanging), roots


def prefix_trie(turns: DataFrame, conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD) -> DataFrame:
    """The nodes of the trie of all conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens long, ends_sha256 string.

    turns: (conv_id, idx, a, b, bytes) as ordered_turns gives them; conversations: (conv_id, total) with the number of turns of
    each, once, such without turns too. No conversation: no node, not even the root.
    """
    deepest = conversations.agg(F.max("total")).first()[0]
    layers = 0 if deepest is None else deepest // segment + 1
    seg = F.expr(f"idx div {segment}")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, a, b = (batch.column(i).to_numpy() for i in (1, 2, 3))
            x = _mix(np.stack([a, b], axis=1), idx)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x[:, 0]), pa.array(x[:, 1])], ["conv_id", "idx", "a", "b", "bytes", "xa", "xb"])

    rows = turns.select("conv_id", "idx", "a", "b", "bytes").mapInArrow(keyed, "conv_id long, idx long, a long, b long, bytes int, xa long, xb long")
    grouped = rows.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("idx", "a", "b", "bytes"))).alias("s"), F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"))
    grouped = grouped.select("conv_id", "seg", F.expr(f"CAST(transform(s, x -> struct(x.a, x.b, x.bytes)) AS array<{TURN}>)").alias("seq"), "xa", "xb")
    empty = conversations.where(F.col("total") % segment == 0).select("conv_id", F.expr(f"total div {segment}").alias("seg"), F.expr(f"CAST(array() AS array<{TURN}>)").alias("seq"), F.lit(0).cast("long").alias("xa"), F.lit(0).cast("long").alias("xb"))
    parts = grouped.union(empty)
    if layers > 1:
        before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        parts = saved(parts)
        heads = parts.select("conv_id", "seg", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(r) for x, r in (("xa", "ra"), ("xb", "rb"))])
        parts = parts.join(heads, ["conv_id", "seg"])
    else:
        parts = parts.withColumns({"ra": F.lit(0).cast("long"), "rb": F.lit(0).cast("long")})
    parts = saved(parts.select("conv_id", "seg", "ra", "rb", F.expr("ra ^ xa").alias("ea"), F.expr("rb ^ xb").alias("eb"), "seq"))
    depth = F.col("seg") * segment + F.size("seq")
    ends = saved(_ends(parts.where(F.size("seq") < segment).select("conv_id", "ea", "eb", depth.alias("depth"))))
    distinct = parts.groupBy("seg", "ra", "rb", "ea", "eb", depth.alias("depth")).agg(F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    distinct = distinct.join(ends, ["ea", "eb", "depth"], "left")
    distinct = saved(distinct) if layers > 1 else distinct
    out, roots = None, None
    zero = F.lit(0).cast("long")
    for layer in range(layers - 1, -1, -1):
        own = distinct.where(F.col("seg") == layer)
        if roots is None:
            own = own.withColumns({"children": zero, "leaves": zero, "saved": zero})
        else:
            hung = roots.select(F.col("ka").alias("ea"), F.col("kb").alias("eb"), "depth", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("ends_sha256").alias("hung_sha"))
            own = own.join(hung, ["ea", "eb", "depth"], "left").fillna(0, ["children", "leaves", "saved"]).withColumn("ends_sha256", F.coalesce("ends_sha256", "hung_sha"))
        nodes, roots = _layer(own, layer * segment, shard_turns)
        nodes, roots = (saved(nodes), saved(roots)) if layer else (nodes, roots)
        out = nodes if out is None else out.union(nodes)
    none = hashlib.sha256(b"").hexdigest()
    if out is None:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return out.union(roots).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; see ordered_turns and prefix_trie."""
    turns = ordered_turns(conversations)
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("total")), segment, shard_turns)


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) as prefix_trie takes them: conversation c begins with the first h turns of c - c % family (the
    remainder has the sign of c), then has its own turns after its first h; h is the unsigned CRC-32 of c in decimal, modulo
    `most`. A conversation that is its own start stays as it is."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("n_base")).where(F.col("base") % family == 0)
    told = lengths.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    told = saved(told.select("conv_id", "base", "h", taken.alias("taken"), F.when(F.col("conv_id") == F.col("base"), F.col("own")).otherwise(taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))
    rest = turns.join(told.select("conv_id", "base", "h", "taken"), "conv_id").where("conv_id = base or idx >= h")
    rest = rest.select("conv_id", F.when(F.col("conv_id") == F.col("base"), F.col("idx")).otherwise(F.col("idx") - F.col("h") + F.col("taken")).alias("idx"), "a", "b", "bytes")
    begin = turns.where((F.col("conv_id") % family == 0) & (F.col("idx") < most - 1))
    begin = begin.select(F.col("conv_id").alias("base"), F.explode(F.array(*[F.try_add("conv_id", F.lit(i)) for i in range(1 - family, family) if i])).alias("conv_id"), "idx", "a", "b", "bytes")
    begin = begin.join(told.select("conv_id", "base", "h"), ["conv_id", "base"]).where("idx < h").select("conv_id", "idx", "a", "b", "bytes")
    return saved(rest.union(begin)), told.select("conv_id", "total")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(load(spark, sf_dir, "conversations"))))
