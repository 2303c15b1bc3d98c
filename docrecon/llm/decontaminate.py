"""Benchmark decontamination by one Aho-Corasick automaton over the benchmark's items.

Texts are normalised to words: A-Z lower-cased, everything but ASCII letters, digits and characters beyond ASCII is a
separator. Every window of an item holds, whole, one of the anchors of ANCHOR words that start at each STRIDE-th word of the
item; the automaton has the anchors only, so it is small. A text is scanned once. Where an anchor is found, the windows around
it are looked up by hash and compared word for word; hits are mapped back to character places of the original text.

Words are written as three letters of three alphabets, by their number in the benchmark, so that a node of the automaton has
few children and matches begin and end with words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import WordHashes, free_names, load, of_stage, saved, windows

TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
#: Words of an anchor, at most.
ANCHOR = 4
#: Letters of an alphabet; three of them number 2,097,152 words, more than fit into a block.
LETTERS = 128
UNKNOWN = "   "
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned for in several blocks.
BLOCK_BYTES = 4 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class Windows:
    """The windows of items (id or None, text): `window` words in a row, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.items = [i for i, _ in items]
        self.letters: dict[bytes, str] = {}
        self.hashes = WordHashes()
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        anchor, lines, found = min(ANCHOR, window), [], {}
        self.window, self.stride, at = window, window - anchor + 1, 0
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            line = "".join(map(self.number, words))
            lines.append(line)
            for i in range(0, max(1, len(words) - anchor + 1), self.stride):
                self.machine.add_word(line[3 * i : 3 * (i + anchor)])
            length = min(window, len(words))
            own = windows(self.hashed(words), length)
            found.setdefault(length, []).append((own, np.arange(at, at + len(own)), np.full(len(own), number)))
            at += len(words)
        self.line = "".join(lines)
        # By length: hashes of distinct windows, a place in line of each, and where the numbers of its items are.
        self.tables = {}
        for length, parts in found.items():
            own, places, numbers = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((numbers, own))
            own, places, numbers = own[order], places[order], numbers[order]
            first = np.flatnonzero(np.diff(own, prepend=own[0] - np.uint64(1)) != 0)
            self.tables[length] = own[first], places[first], np.append(first, len(own)), numbers
        if self.tables:
            self.machine.make_automaton()

    def number(self, word: bytes) -> str:
        if word not in self.letters:
            n = len(self.letters)
            self.letters[word] = chr(256 + n % LETTERS) + chr(512 + n // LETTERS % LETTERS) + chr(1024 + n // LETTERS**2)
        return self.letters[word]

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def search(self, words: list[bytes]) -> tuple[set[int], set[int]]:
        """(places of the words that a window holds, numbers of the items with such a window)."""
        hit: set[int] = set()
        items: set[int] = set()
        if not self.tables:
            return hit, items
        line = "".join([self.letters.get(w, UNKNOWN) for w in words])
        starts = {(end + 1 - length) // 3 for end, length in self.machine.iter(line)}
        if not starts:
            return hit, items
        flat = self.hashed(words)
        for length, (known, places, ends, numbers) in self.tables.items():
            # The anchor of a short item is its beginning.
            back = self.stride if length == self.window else 1
            likely = np.array(sorted({s - k for s in starts for k in range(back)}), np.int64)
            likely = likely[(likely >= 0) & (likely + length <= len(words))]
            own = windows(flat, length)[likely]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            for start, i in zip(likely[known[at] == own].tolist(), at[known[at] == own].tolist()):
                if line[3 * start : 3 * (start + length)] == self.line[3 * places[i] : 3 * (places[i] + length)]:
                    hit.update(range(start, start + length))
                    items.update(numbers[ends[i] : ends[i + 1]].tolist())
        return hit, items


def in_order(ids: Iterable[str | None]) -> list[str | None]:
    """Distinct ids; a null id is kept, as the empty place at the end."""
    names = set(ids)
    return sorted(x for x in names if x is not None) + [None] * (None in names)


def spans_of(text: str | None, hit: list[int]) -> list[dict]:
    """The characters of runs of hit words."""
    if not hit:
        return []
    raw, out = text.encode(), []
    at = [m.span() for m in WORD.finditer(raw)]
    cut = [0, *(np.flatnonzero(np.diff(hit) > 1) + 1).tolist(), len(hit)]
    for i, j in zip(cut, cut[1:]):
        a, b = at[hit[i]][0], at[hit[j - 1]][1]
        begin = len(raw[:a].decode())
        out.append({"begin": begin, "end": begin + len(raw[a:b].decode())})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items long, item_ids array<string> (sorted), items_sha256 string (of the ids, joined by
    commas), spans array<struct<begin int, end int>> (characters of the original text, runs of hit words) and
    contaminated boolean. Columns of docs with one of these names are replaced, all others kept.

    A window is `window` words of an item in a row; an item of fewer words is one window, an item without words none.
    Null texts have no words; items that repeat count once; an item with a null id is no id, but hits and is counted. The
    benchmark is dealt into blocks of about block_bytes of text (an item is within one), which the driver reads one at a time
    and broadcasts; beyond one block, docs are read once for each, what was found is written for each text with hits, and
    joined to docs by the text's digest at the end.
    """
    docs = free_names(docs, ["n_words", "n_hit", "n_items", "item_ids", "items_sha256", "spans", "contaminated"])
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    if blocks > 1:
        items = saved(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")))
    plain = docs.columns
    taken, state = {c.lower() for c in plain}, []
    for name in ("key", "hit", "item"):
        while name in taken:
            name += "_"
        state.append(name)
    key, hit, item = state
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<begin: int, end: int>>"

    def outcome(batch: pa.RecordBatch, texts: list, n: list, hits: list, ids: list) -> pa.RecordBatch:
        base, span = batch.select(plain), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        more = {"n_words": pa.array(n, pa.int64()), "n_hit": pa.array([*map(len, hits)], pa.int64()), "n_items": pa.array([*map(len, ids)], pa.int64()), "item_ids": pa.array([[x for x in i if x is not None] for i in ids], pa.list_(pa.string())), "spans": pa.array([*map(spans_of, texts, hits)], span)}
        return pa.RecordBatch.from_arrays([*base.columns, *more.values()], [*plain, *more])

    def searched(texts: list, known: Windows) -> tuple[list, list, list]:
        n, hits, ids = [], [], []
        for text in texts:
            words = words_of(text)
            places, numbers = known.search(words)
            n.append(len(words))
            hits.append(sorted(places))
            ids.append(in_order(known.items[i] for i in numbers))
        return n, hits, ids

    found = []
    for block in range(blocks):
        own = items.where(F.col("block") == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in own.select("item_id", "text").orderBy("item_id", "text").collect()])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
            known = of_stage(f"windows {block}", lambda: Windows(shared.value, window))
            for batch in batches:
                texts = batch.column("text").to_pylist()
                n, hits, ids = searched(texts, known)
                if blocks == 1:
                    yield outcome(batch, texts, n, hits, ids)
                    continue
                rows = np.flatnonzero([len(h) > 0 for h in hits])
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array([hits[i] for i in rows], pa.list_(pa.int32())), pa.array([ids[i] for i in rows], pa.list_(pa.string()))], state)

        if blocks == 1:
            docs = docs.mapInArrow(scan, schema)
        else:
            # A hit is a matter of the text alone: equal texts are told once, by their digest. Only texts with hits are written.
            texts = docs.where("text is not null").select(F.sha2("text", 256).alias(key), "text")
            found.append(saved(texts.mapInArrow(scan, f"`{key}` string, `{hit}` array<int>, `{item}` array<string>").dropDuplicates([key])))
    if blocks > 1:
        told = reduce(DataFrame.union, found).groupBy(key).agg(F.flatten(F.collect_list(hit)).alias(hit), F.flatten(F.collect_list(item)).alias(item))
        # Null texts match nothing; they are spread, not gathered.
        digest = F.coalesce(F.sha2("text", 256), F.monotonically_increasing_id().cast("string"))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [sorted(set(h or ())) for h in batch.column(hit).to_pylist()]
                texts = batch.column("text").to_pylist()
                yield outcome(batch, texts, [len(words_of(t)) for t in texts], hits, [in_order(i or ()) for i in batch.column(item).to_pylist()])

        docs = docs.withColumn(key, digest).join(told, key, "left").select(*plain, hit, item).mapInArrow(finish, schema)
    return docs.withColumns({"items_sha256": F.sha2(F.array_join("item_ids", ","), 256), "contaminated": F.col("n_hit") > 0})


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
