"""MinHash near-dedup with tensored banding.

A document's shingle set gives 2 * SMALL small hash collections of WIDTH MinHash values each, and a table key for each
pair of one of the first and one of the second half: SMALL ** 2 tables from 2 * SMALL * WIDTH hash functions, where plain
banding would compute SMALL ** 2 * 2 * WIDTH. With 8 and 2, at similarity 0.85 a pair is in no table once in 14,000.

    documents -> classes of equal sets -> keys -> stars around each key's least document -> groups that may be linked
              -> exact similarity on full sets within a group -> components

Groups are larger than the components to be found, so comparing each document with those of its group loses no link that
the keys found. Within a group documents are compared one with all (numpy), those already connected are skipped, and only
a spanning set of links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import NO_ID, WordHashes, load, of_stage, saved, split_batches, whole, windows, word_arrays
from docrecon.llm.graph import components

SMALL, WIDTH = 8, 2
#: Different sets that one task compares, and bytes of their shingles; larger groups are split.
GROUP, GROUP_BYTES = 4096, 24 << 20
#: Groups of several parts that are broadcast, at most.
FEW_GROUPS = 100_000


def shingle_sets(texts: list, words: int, hashes: WordHashes) -> list[np.ndarray]:
    """The distinct `words`-word shingles of each text, hashed, ascending. Shorter texts: one for the whole; no words: none."""
    flat, starts = word_arrays(texts, hashes, lower=True)
    rolled, (_, inside) = windows(flat, words), whole(starts, words)
    out = []
    for i, j in zip(starts, starts[1:]):
        if j - i >= words:
            out.append(np.unique(rolled[i : j - words + 1]))
        elif j > i:
            out.append(windows(flat[i:j], int(j - i)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: SMALL * 2 collection hashes each, and two hashes of the whole set."""
    at = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    rng = np.random.default_rng(20)
    lows = []
    for _ in range(2 * SMALL * WIDTH):
        a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
        x = flat * (a | np.uint64(1)) + b
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        lows.append(np.minimum.reduceat(x, at))
    lows = np.array(lows).T.reshape(len(sets), 2 * SMALL, WIDTH)
    keys = lows[:, :, 0] * np.uint64(0xD1B54A32D192ED03) + (lows[:, :, 1] ^ (lows[:, :, 1] >> np.uint64(31)))
    one = np.add.reduceat(flat * np.uint64(0xFF51AFD7ED558CCD), at)
    two = np.add.reduceat((flat ^ (flat >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53), at)
    return keys, np.stack([one, two], 1)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_stage("words", WordHashes)
        for parts in split_batches(batches, "text", 2 << 20):
            table = pa.Table.from_batches(parts)
            sets = shingle_sets(table.column("text").to_pylist(), words, hashes)
            full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            keys, whole_set = np.zeros((len(sets), 2 * SMALL), np.uint64), np.zeros((len(sets), 2), np.uint64)
            if len(full):
                keys[full], whole_set[full] = _signature([sets[i] for i in full])
            n = np.array([len(s) for s in sets])
            offsets = pa.array(np.arange(len(sets) + 1) * 2 * SMALL, pa.int32())
            yield pa.RecordBatch.from_arrays([
                table.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(n, pa.int64()), pa.array(whole_set[:, 0].view(np.int64)), pa.array(whole_set[:, 1].view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], ["doc_id", "n_shingles", "set1", "set2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, keys array<long>")


class _Sets:
    """Sets of one task, as places in one list of all their shingles."""

    def __init__(self, ids: np.ndarray, blobs: list[bytes]):
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        self.ids, self.size = np.asarray(ids, np.int64), np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.at = np.cumsum([0, *self.size])
        self.space, self.flat = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(self.space), bool)

    def central(self) -> np.ndarray:
        """Places by how common their shingles are here, most common first: such a one is linked with the most others."""
        common = np.bincount(self.flat)[self.flat]
        return np.argsort(-np.add.reduceat(common, self.at[:-1]) / self.size, kind="stable")

    def linked(self, shingles: np.ndarray, size: int, among: np.ndarray, percent: int) -> np.ndarray:
        """Which of the places `among` are linked with a set given as places in space (those outside left out)."""
        among = among[(100 * np.minimum(self.size[among], size) >= percent * np.maximum(self.size[among], size))]
        if not len(among):
            return among
        self.mark[shingles] = True
        if 2 * len(among) > len(self.size):
            both = np.add.reduceat(self.mark[self.flat], self.at[:-1], dtype=np.int64)[among]
        else:
            both = np.array([np.count_nonzero(self.mark[self.flat[self.at[i] : self.at[i + 1]]]) for i in among])
        self.mark[shingles] = False
        return among[100 * both >= percent * (self.size[among] + size - both)]


def _within(s: _Sets, percent: int) -> np.ndarray:
    """For each set the place of its component's root, all links within s used."""
    label = np.arange(len(s.ids))
    for x in s.central():
        rest = np.flatnonzero(label != label[x])
        if not len(rest):
            break
        for y in s.linked(s.flat[s.at[x] : s.at[x + 1]], s.size[x], rest, percent):
            if label[y] != label[x]:
                a, b = sorted((label[x], label[y]))
                label[label == b] = a
    return label


def _solve(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = _Sets(rows["id"].to_numpy(), rows["shingles"].tolist())
        label = _within(s, percent)
        low = pd.Series(s.ids).groupby(label).transform("min").to_numpy()
        score = np.zeros(len(label))
        order = s.central()
        score[order] = np.arange(len(order), 0, -1) / len(order)
        return pd.DataFrame({"id": s.ids, "root": low, "group": rows["group"].to_numpy(), "part": rows["part"].to_numpy(), "parts": rows["parts"].to_numpy(), "score": score})

    return run


def _across(percent: int):
    """Queries against the members of one part: a link for each local component that a query is linked with."""

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(members) and len(queries):
            s, roots = _Sets(members["m_id"].to_numpy(), members["m_shingles"].tolist()), members["m_root"].to_numpy()
            for q, root, blob in zip(queries["q_id"], queries["q_root"], queries["q_shingles"]):
                own = np.frombuffer(blob, np.uint64)
                near = np.searchsorted(s.space, own)
                near = near[(near < len(s.space)) & (s.space[np.minimum(near, len(s.space) - 1)] == own)]
                found = s.linked(near, len(own), np.flatnonzero(roots != root), percent)
                out += [(q, r) for r in set(roots[found].tolist())]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _pieces(rows: DataFrame) -> DataFrame:
    """(group, needed): of rows (group, shingles), the groups that are more than one task's work, and how many."""
    size = F.greatest(F.count("*") / GROUP, F.sum(F.octet_length("shingles")) / GROUP_BYTES)
    return rows.groupBy("group").agg(F.ceil(size).cast("int").alias("needed")).where("needed > 1")


def _few(groups: DataFrame) -> DataFrame:
    """A saved table of groups, broadcast if its rows are few."""
    groups = saved(groups)
    return F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups.hint("merge")


def _dealt(rows: DataFrame, pieces: DataFrame, part: str, parts: str) -> DataFrame:
    """rows (group, id, ...) with their part in the group, 0 to parts - 1."""
    count = F.coalesce("needed", F.lit(1))
    return rows.join(pieces, "group", "left").withColumns({part: F.pmod(F.xxhash64("id"), count).cast("int"), parts: count}).drop("needed")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each group of sets (group, id, shingles)."""
    large = _few(_pieces(sets))
    dealt = _dealt(sets, large, "part", "parts")
    local = saved(dealt.groupBy("group", "part").applyInPandas(_solve(percent), "id long, root long, group long, part int, parts int, score double"))
    links = local.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if not large.take(1):
        return links
    # Groups of several parts: first the most central set of the group is compared with all parts; then those that are still
    # apart from it, with all parts. No set of the group is left out of the second comparison.
    rooted = saved(dealt.drop("parts").join(local.where("parts > 1").select("id", "root", "group", "part", "parts", "score"), ["id", "group", "part"]))

    def compare(queries: DataFrame) -> DataFrame:
        """Each query with each part of its group, piece by piece of the queries: a task has one part and one piece."""
        dealt = _dealt(queries, _few(_pieces(queries)), "piece", "pieces")
        pieces = dealt.select("group", "pieces").distinct()
        members = rooted.join(pieces, "group").select("group", "part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), *[F.col(c).alias(f"m_{c}") for c in ("id", "root", "shingles")])
        asked = dealt.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"), *[F.col(c).alias(f"q_{c}") for c in ("group", "piece", "id", "root", "shingles")])
        return saved(members.groupBy("group", "part", "piece").cogroup(asked.groupBy("q_group", "q_part", "q_piece")).applyInPandas(_across(percent), "a long, b long"))

    pivots = rooted.groupBy("group").agg(F.max_by("id", F.struct("score", "id")).alias("id"))
    first = compare(rooted.drop("part", "score").join(pivots, ["group", "id"]))
    reached = links.join(rooted.select(F.col("id").alias("a")), "a", "left_semi").union(first)
    labels = components(reached)
    placed = saved(rooted.drop("part", "score").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    main = placed.join(pivots, ["group", "id"]).select("group", F.col("component").alias("main"))
    apart = placed.join(main, "group").where("component <> main")
    return links.union(first).union(compare(apart.drop("component", "main")))


def near_dedup(docs: DataFrame, similarity: float = 0.85, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles long, component_id long, kept boolean), one row for each row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= 100 * similarity * union of their sets of `words`-word shingles (A-Z
    lower-cased, words split at ASCII white space); component_id is the smallest doc_id reachable. A text of fewer words is
    one shingle; null and texts without words have no shingles and no links. Rows that repeat a doc_id are one node with the
    links of each. A null doc_id counts as larger than any other and is returned as null. Other columns of docs are left out.
    """
    spark, percent = docs.sparkSession, round(100 * similarity)
    docs = docs.select("doc_id", "text").withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))))
    signed = saved(_signed(docs, words))
    full = signed.where("n_shingles > 0")
    classes = saved(full.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("id"), F.max("keys").alias("keys")))
    a, b = F.slice("keys", 1, SMALL), F.slice("keys", SMALL + 1, SMALL)
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.xxhash64(x, y, i * SMALL + j))))
    keyed = classes.select("id", F.explode(pairs).alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least")
    # None of these sides has a bound, so none may be broadcast; Spark splits skewed partitions of a merge join.
    stars = keyed.join(least.hint("merge"), "key").where("id <> least").select("id", "least")
    maybe = components(stars)
    member = saved(maybe.union(maybe.select(F.col("component").alias("node"), "component").distinct()).toDF("id", "group"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_stage("words", WordHashes)
        for parts in split_batches(batches, "text", 2 << 20):
            table = pa.Table.from_batches(parts)
            blobs = [s.tobytes() for s in shingle_sets(table.column("text").to_pylist(), words, hashes)]
            for batch in table.select(["group", "id"]).append_column("shingles", pa.array(blobs, pa.binary())).combine_chunks().to_batches():
                yield batch.filter(pc.greater(pc.binary_length(batch.column("shingles")), 0))

    texts = docs.withColumnRenamed("doc_id", "id").join(member.hint("merge"), "id").select("group", "id", "text")
    links = _links(saved(texts.mapInArrow(sets, "group long, id long, shingles binary")), percent)
    # Rows that repeat a doc_id tie the classes of their texts together.
    repeated = full.join(classes.select("set1", "set2", "n_shingles", "id").hint("merge"), ["set1", "set2", "n_shingles"]).select("doc_id", "id")
    found = components(links.union(repeated.where("doc_id <> id")))
    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
    real = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents"))
