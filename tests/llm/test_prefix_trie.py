"""The trie of conversations against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docrecon.llm.prefix_trie import DoubleArray, conversation_trie, op13_prefix_trie, ordered_turns, prefix_trie, rebuilt


def in_order(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}


def rebuild(turns):
    out = {}
    for c, own in turns.items():
        base, h = c - (abs(c) % 5) * (1 if c > 0 else -1), zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(sequences):
    members = defaultdict(list)
    for c, t in sequences.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted([tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS a", "'x' AS IDX", "2 AS shard", "3 AS seq")


def conversations(n, seed):
    """Short turns of few kinds, so that prefixes branch at all depths; copies, one long conversation, nulls, repeats."""
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            rows.append((c, turn if rng.random() > 0.05 else None, rng.choice(["user", "user", None]), rng.choice(["a", "a", "a", "é", "", None])))
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(0, 40) for t in range(6)]
    rows += [(2000 + i, t, "user", f"long {t % 7}") for i in (0, 1) for t in range(60 + 3 * i)]
    rows += [(3000, 0, "user", "twice"), (3000, 0, "user", "twice"), (None, 0, "user", "nobody"), (None, 1, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, shard", [(1 << 18, 40), (20, 25)])
def test_against_prefixes(spark, segment, shard):
    rows = conversations(60, segment)
    df = frame(spark, rows).repartition(3)
    turns = in_order(rows)
    assert told(conversation_trie(df, segment, shard)) == brute(turns)
    assert told(prefix_trie(*rebuilt(ordered_turns(df)), segment=segment, shard_turns=shard)) == brute(rebuild(turns))


def test_small_tables(spark):
    assert conversation_trie(frame(spark, [])).count() == 0
    assert conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(7, 3, None, None), ((1 << 63) - 1, 0, "user", "x"), (-(1 << 63), 0, "user", "x")]
    assert told(conversation_trie(frame(spark, rows))) == brute(in_order(rows))
    # Rebuilt, 7 has the start of 5, which isn't there, and nothing of its own: a root with a member without turns.
    assert told(prefix_trie(*rebuilt(ordered_turns(frame(spark, rows))))) == brute(rebuild(in_order(rows)))


def test_hot_conversation_over_many_partitions(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(900)] + [(c, 0, "user", "x") for c in range(300)]
    out = told(prefix_trie(*rebuilt(ordered_turns(frame(spark, rows).repartition(6))), segment=400))
    assert out == brute(rebuild(in_order(rows)))


def test_long_texts(spark):
    rows = [(1, 0, "user", "y" * 2_000_000), (2, 0, "user", "y" * 2_000_000), (3, 0, "user", "y" * 1_999_999 + "z")]
    assert told(conversation_trie(frame(spark, rows))) == brute(in_order(rows))


def test_double_array():
    rng = np.random.default_rng(4)
    parent, symbol, seen = [0], [0], set()
    while len(parent) < 3000:
        pair = int(rng.integers(0, len(parent)) ** 2 // len(parent)), int(rng.zipf(1.3)) % 500
        if pair not in seen:
            seen.add(pair)
            parent.append(pair[0])
            symbol.append(pair[1])
    parent, symbol = np.array(parent), np.array(symbol)
    trie = DoubleArray(parent, symbol)
    assert len(set(trie.slot.tolist())) == len(parent) and len(trie.base) < 2 * len(parent) + 500
    assert (trie.child(trie.slot[parent[1:]], symbol[1:]) == trie.slot[1:]).all()
    kids = {(p, s): trie.slot[i] for i, (p, s) in enumerate(zip(parent, symbol)) if i}
    for node in range(0, 3000, 37):
        got = trie.child(np.full(500, trie.slot[node]), np.arange(500))
        assert all(got[s] == kids.get((node, s), -1) for s in range(500))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(op13_prefix_trie(spark, f"/root/testdata/{sf}")) == brute(rebuild(in_order(rows)))
