"""Best-fit packing of token sequences by linear grouping.

Only counts of lengths (as many rows as a sequence has tokens, whatever the corpus) reach the driver, and only a plan
comes back: for a length, which ranks go to which sequences, at which place. Documents never leave the executors.

    tokenise, cut -> counts by length -> plan -> rank of each piece among those of its length -> place by the plan

The plan: pieces longer than a third of the room are put in order of length and rounded up within GROUPS groups of equal
numbers. For these few sizes, patterns of sizes that fill a sequence are chosen by a linear program (columns made by a
knapsack, as for cutting stock); its whole parts are used, the rest is packed best-fit. The places of a group then take its
actual pieces, and the room that patterns and rounding left takes the small pieces, longest first, where they fit best. As
far as there are small pieces to fill it, patterns leave some room free: gaps of a few tokens would stay empty.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import load, saved, task_number
from docrecon.llm.tokens import packed, vocabulary

GROUPS, SHARE = 48, 3
ROUNDS = 400
FREE = 4


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The multiset of sizes within room with the largest value. sizes: distinct."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    lowest = int(sizes.min())
    order = np.argsort(sizes)
    small = sizes[order]
    for c in range(lowest, room + 1):
        k = int(np.searchsorted(small, c, side="right"))
        options = best[c - small[:k]] + values[order[:k]]
        i = int(np.argmax(options))
        best[c], last[c] = (options[i], order[i]) if options[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    out, c = Counter(), room
    while c >= lowest:
        if last[c] < 0:
            c -= 1
        else:
            out[int(last[c])] += 1
            c -= int(sizes[last[c]])
    return float(best[room]), dict(out)


def configurations(sizes: np.ndarray, need: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(pattern: place in sizes -> number, times), the whole parts of a solution of the linear program."""
    k = len(sizes)
    columns = [{i: int(room // s)} for i, s in enumerate(sizes)]
    basis = np.diag([float(room // s) for s in sizes])
    for step in range(rounds):
        if step % 50 == 0:
            inverse = np.linalg.inv(basis)
        amount = inverse @ need
        value, pattern = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-6:
            break
        column = np.zeros(k)
        for i, n in pattern.items():
            column[i] = n
        way = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            limit = np.where(way > 1e-9, np.maximum(amount, 0) / way, np.inf)
        out = int(np.argmin(limit))
        basis[:, out], columns[out] = column, pattern
        inverse[out] /= way[out]
        rest = np.arange(k) != out
        inverse[rest] -= np.outer(way[rest], inverse[out])
    amount = np.linalg.solve(basis, need)
    return [(c, int(np.floor(a + 1e-9))) for c, a in zip(columns, amount) if a >= 1]


class _Plan:
    """Classes of sequences with the same contents: [room left, number of sequences, [(length, first rank), ...]]."""

    def __init__(self, count: Counter, room: int):
        self.left, self.next, self.room = Counter(count), Counter(), room
        self.open: dict[int, list] = defaultdict(list)  # room left -> classes
        self.rooms: list[int] = []  # a heap isn't needed: at most `room` values

    def put(self, contents: list[tuple[int, int]], n: int) -> None:
        self.open[self.room - sum(x for x, _ in contents)].append((n, contents))

    def take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return first

    def best_fit(self, lengths: list[int]) -> None:
        """All that is left of these lengths, longest first, each to the fullest sequence with room for it."""
        for x in sorted(lengths, reverse=True):
            while self.left[x] > 0:
                gap = min((g for g in self.open if g >= x and self.open[g]), default=None)
                if gap is None:
                    each = self.room // x
                    # As many as fit one sequence share a class; what does not fill one more is a class of its own.
                    n, rest = divmod(self.left[x], each)
                    if n:
                        self.put([(x, self.take(x, n)) for _ in range(each)], n)
                    if rest:
                        self.put([(x, self.take(x, 1)) for _ in range(rest)], 1)
                    continue
                n, contents = self.open[gap].pop()
                used = min(n, self.left[x])
                if used < n:
                    self.open[gap].append((n - used, [(y, f + used) for y, f in contents]))
                self.put([*contents, (x, self.take(x, used))], used)


def plan(count: dict[int, int], room: int, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, sequence of the first rank, offset): rank r goes to sequence + r - first rank."""
    p = _Plan(Counter(count), room)
    if full := p.left[room]:
        p.put([(room, p.take(room, full))], full)
    small = sum(x * n for x, n in p.left.items() if x <= room // SHARE)
    big = sum(x * n for x, n in p.left.items() if room // SHARE < x < room)
    free = int(min(room // FREE, room * small / max(1, small + big) / 2))
    for x in [x for x in p.left if room - free < x < room and p.left[x]]:
        n = p.left[x]
        p.put([(x, p.take(x, n))], n)
    large = sorted((x for x in p.left if room // SHARE < x <= room - free and p.left[x]), reverse=True)
    total = sum(p.left[x] for x in large)
    if total >= 4 * groups:
        # Groups of equal numbers: runs of (length, number), the group's size is its longest.
        share, runs, sizes, fill = -(-total // groups), [[]], [], 0
        for x in large:
            n = p.left[x]
            while n:
                take = min(n, share - fill)
                runs[-1].append([x, take])
                fill, n = fill + take, n - take
                if fill == share:
                    runs.append([])
                    fill = 0
        runs = [r for r in runs if r]
        merged: dict[int, list] = {}
        for r in runs:
            merged.setdefault(r[0][0], []).extend(r)
        sizes = np.array(list(merged))
        queues = [merged[s] for s in sizes]
        need = np.array([float(sum(n for _, n in q)) for q in queues])
        for pattern, times in configurations(sizes, need, room - free):
            slots = [i for i, n in sorted(pattern.items()) for _ in range(n)]
            while times:
                # A stretch of sequences whose slots all take one length each.
                heads, at = [], Counter()
                for i in slots:
                    q, skip = queues[i], at[i]
                    heads.append((i, skip))
                    at[i] += 1
                stretch = times
                for i, uses in at.items():
                    queues[i] = [r for r in queues[i] if r[1]]
                    if not queues[i]:
                        stretch = 0
                    else:
                        stretch = min(stretch, queues[i][0][1] // uses)
                mixed = stretch == 0
                stretch = max(stretch, 1)
                contents, short = [], False
                for i in slots:
                    queues[i] = [r for r in queues[i] if r[1]]
                    if not queues[i]:
                        short = True
                        continue
                    run = queues[i][0]
                    take = 1 if mixed else stretch
                    contents.append((run[0], p.take(run[0], take)))
                    run[1] -= take
                if contents:
                    p.put(contents, stretch)
                if short and all(not any(r[1] for r in queues[i]) for i in set(slots)):
                    break
                times -= stretch
    p.best_fit([x for x in p.left if p.left[x]])
    rows, number = [], 0
    for gap in sorted(p.open):
        for n, contents in p.open[gap]:
            offset = 0
            for length, first in contents:
                rows.append((length, first, first + n, number, offset))
                offset += length
            number += n
    return rows


def pieces(docs: DataFrame, vocabulary_file: str, end_id: int, room: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): rank among the pieces of this length that the same task cut. Saved."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, seen = packed(told.value).ids, struct.pack("<I", end_id), task_number(), Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for k, i in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[i : i + 4 * room]
                    n = len(own) // 4
                    rows.append((doc, k, i // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"))


def pack(docs: DataFrame, vocabulary_file: str = "word_bpe_49k.json", end_id: int = 0, room: int = 2048) -> DataFrame:
    """(doc_id, piece int, start, length, ids_crc32, sequence_id, offset long), a row for each piece.

    A document is its token ids and end_id; only longer ones than `room` are cut, into pieces of `room` ids, the last may be
    shorter. A null text is empty, so each row of docs has a piece. Rows that repeat a doc_id are documents of their own.
    """
    cut = pieces(docs, vocabulary_file, end_id, room)
    by_part = saved(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    lengths = by_part.groupBy("length").agg(F.sum("n").alias("n"))
    rows = plan({r["length"]: r["n"] for r in lengths.toLocalIterator()}, room)  # at most `room` rows
    bases = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    shared = cut.sparkSession.sparkContext.broadcast(np.array(sorted(rows), np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        starts = p[:, 0] << 48 | p[:, 1] if len(p) else p[:, 0]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("base").to_numpy() + batch.column("rank").to_numpy()
            row = p[np.searchsorted(starts, length << 48 | rank, side="right") - 1]
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*keep.schema.names, "sequence_id", "offset"])

    return cut.join(bases, ["part", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
