"""Substring dedup: words covered by a passage that an earlier document also has are removed.

A passage is `window` words of one document. Comparing every window of the corpus would shuffle one row for each word.
Instead, anchors of 7 words are hashed at cover positions only: {0, 1, 3} is a difference cover modulo 7, so two
equal passages of 13 words or more, wherever they begin, have an equal anchor at the same distance from their beginnings.
Windows without an anchor that a second document has can't repeat; only the others are hashed in full and compared.

    chunks -> anchor keys by bucket -> bits: which anchors a second document has
           -> full windows around those, by bucket -> bits: which windows a smaller doc_id has -> words removed

Keys go to buckets once for each chunk (equal keys of a chunk are merged first), so a passage that a third of the corpus
shares is one key a chunk. The answers are bits. No pairs of documents are made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import WordHashes, chunked, free_names, from_blob, ids_of, of_stage, parallelism, saved, whole, windows, word_arrays

PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Chunk:
    """The words of a chunk's documents and, step by step, what is known of them. Made anew in each step; the same each time."""

    def __init__(self, blob: bytes, text: str, doc_id: str, window: int, buckets: int, hashes: WordHashes):
        self.rows, self.window, self.buckets = from_blob(blob), window, buckets
        self.texts = self.rows.column(text).cast(pa.large_binary()).to_pylist()
        self.ids = ids_of(self.rows, doc_id)
        self.words, self.starts = word_arrays(self.texts, hashes)

    def anchors(self) -> None:
        """keys: bucket << 32 | 32 bits, distinct and ascending; of: the anchor positions' places in keys; many: more than one doc_id here has it."""
        doc, inside = whole(self.starts, ANCHOR)
        place = np.arange(len(doc)) - self.starts[doc] if len(doc) else np.empty(0, np.int64)
        at = np.flatnonzero(inside & np.isin(place % PERIOD, COVER) & ((self.starts[doc + 1] - self.starts[doc]) >= self.window)) if len(doc) else np.empty(0, np.int64)
        h = windows(self.words, ANCHOR)[at]
        key = ((h >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        self.at = at
        self.keys, self.of = np.unique(key, return_inverse=True)
        ids = self.ids[doc[at]] if len(at) else np.empty(0, np.int64)
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, ids)
        np.maximum.at(high, self.of, ids)
        self.many = high > low

    def candidates(self, shared: np.ndarray) -> None:
        """The windows that hold a shared anchor. cand: their places; k1, k2: keys, distinct, in order of bucket; low: the smallest doc_id here."""
        flag = np.zeros(len(self.words) + 1, np.int64)
        flag[self.at[shared[self.of]]] = 1
        seen = np.concatenate([[0], np.cumsum(flag)])
        doc, inside = whole(self.starts, self.window)
        reach = self.window - ANCHOR + 1
        i = np.arange(len(doc))
        self.cand = np.flatnonzero(inside & (seen[np.minimum(i + reach, len(seen) - 1)] > seen[i])) if len(doc) else i
        self.doc = doc
        a, b = windows(self.words, self.window, 1)[self.cand], windows(self.words, self.window, 2)[self.cand]
        bucket = (a >> np.uint64(32)) % np.uint64(self.buckets)
        k1, k2 = bucket << np.uint64(32) | (a & np.uint64(0xFFFFFFFF)), b >> np.uint64(16)
        order = np.lexsort((k2, k1))
        new = np.ones(len(order), bool)
        new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        self.win_of = np.empty(len(order), np.int64)
        self.win_of[order] = np.cumsum(new) - 1
        self.k1, self.k2 = k1[order][new], k2[order][new]
        self.low = np.full(len(self.k1), np.iinfo(np.int64).max)
        if len(order):
            np.minimum.at(self.low, self.win_of, self.ids[doc[self.cand]])

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        own = self.ids[self.doc[self.cand]] if len(self.cand) else np.empty(0, np.int64)
        hit = self.cand[earlier[self.win_of] | (self.low[self.win_of] < own)] if len(self.cand) else self.cand
        delta = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(delta, hit, 1)
        np.add.at(delta, hit + self.window, -1)
        return np.cumsum(delta)[:-1] > 0


def _bits(answers, keys: np.ndarray) -> np.ndarray:
    """The bits of all buckets, in the order of keys (which begin with the bucket)."""
    out = np.zeros(len(keys), bool)
    if len(keys) == 0 or answers is None:
        return out
    for a in answers:
        lo, hi = np.searchsorted(keys, np.array([a["bucket"] << 32, (a["bucket"] + 1) << 32], np.uint64))
        out[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    buckets = (keys >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(keys)]):
        if hi > lo:
            yield int(buckets[lo]), int(lo), int(hi)


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of anchors: for each chunk's keys, whether a second document has them."""
    keys = [np.frombuffer(x, np.uint32) for x in rows["keys"]]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["many"], sizes)])
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    group = np.cumsum(new) - 1
    known = (np.bincount(group) > 1) | (np.bincount(group, weights=many[order]) > 0)
    out = np.empty(len(every), bool)
    out[order] = known[group]
    bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": bits})


def _earlier(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of windows: for each chunk's windows, whether another chunk has them under a smaller doc_id."""
    k1 = [np.frombuffer(x, np.uint32) for x in rows["k1"]]
    sizes = [len(k) for k in k1]
    k1 = np.concatenate(k1)
    low16 = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["k2a"]]).astype(np.uint64)
    k2 = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["k2b"]]).astype(np.uint64) << np.uint64(16) | low16
    low = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + b if w else np.frombuffer(x, np.int64) for x, b, w in zip(rows["low"], rows["base"], rows["narrow"])])
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(low[order], np.flatnonzero(new))
    out = np.empty(len(order), bool)
    out[order] = least[group] < low[order]
    bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": bits})


def _cut(text: bytes, gone: np.ndarray) -> str:
    """The text without the words marked gone, each with the white space after it."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    return b"".join([text[: starts[0]], *(text[starts[i] : starts[i + 1]] for i in np.flatnonzero(~gone))]).strip().decode()


def substring_dedup(docs: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n_words, n_removed long, kept_sha256 string (of the kept words, joined by one space) and kept_text string.

    A word is removed if one of the windows of `window` words that cover it also begins in a document with a smaller
    doc_id. window: 13 or more, so that each window holds a full period of anchors. A null text has no words, and a null
    doc_id counts as larger than any other. Rows that repeat a doc_id don't remove from each other. A text that loses
    nothing is its own kept_text; null stays null. Columns of docs under one of the four names are replaced.
    """
    if window < PERIOD + ANCHOR - 1:
        raise ValueError(f"window must be at least {PERIOD + ANCHOR - 1}")
    docs = free_names(docs, ["n_words", "n_removed", "kept_sha256", "kept_text"])
    spark, kinds = docs.sparkSession, docs.schema
    chunks = chunked(docs, text)
    buckets = max(parallelism(spark), chunks.count() // 8)

    def anchor_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = of_stage("words", WordHashes)
        for part in parts:
            for chunk, blob in zip(part["chunk"], part["blob"]):
                c = _Chunk(blob, text, doc_id, window, buckets, hashes)
                c.anchors()
                low = (c.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows = [(b, chunk, low[i:j].tobytes(), np.packbits(c.many[i:j]).tobytes()) for b, i, j in _slices(c.keys)]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "many"])

    def gathered(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    answers = saved(chunks.mapInPandas(anchor_rows, "bucket long, chunk long, keys binary, many binary").groupBy("bucket").applyInPandas(_shared, "chunk long, bucket long, bits binary"))
    known = chunks.join(gathered(answers, "shared"), "chunk", "left")

    def window_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = of_stage("words", WordHashes)
        for part in parts:
            for chunk, blob, shared in zip(part["chunk"], part["blob"], part["shared"]):
                c = _Chunk(blob, text, doc_id, window, buckets, hashes)
                c.anchors()
                c.candidates(_bits(shared, c.keys))
                rows = []
                for b, i, j in _slices(c.k1):
                    base = int(c.low[i:j].min())
                    narrow = int(c.low[i:j].max()) - base < 2**32
                    low = (c.low[i:j] - base).astype(np.uint32) if narrow else c.low[i:j]
                    k1, k2 = (c.k1[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32), c.k2[i:j]
                    rows.append((b, chunk, k1.tobytes(), (k2 & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), (k2 >> np.uint64(16)).astype(np.uint32).tobytes(), low.tobytes(), base, narrow))
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "k1", "k2a", "k2b", "low", "base", "narrow"])

    found = saved(known.mapInPandas(window_rows, "bucket long, chunk long, k1 binary, k2a binary, k2b binary, low binary, base long, narrow boolean").groupBy("bucket").applyInPandas(_earlier, "chunk long, bucket long, bits binary"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n_words long", "n_removed long", "kept_sha256 string", "kept_text string"])

    def result_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_stage("words", WordHashes)
        for part in parts:
            for row in part.to_pylist():
                c = _Chunk(row["blob"], text, doc_id, window, buckets, hashes)
                c.anchors()
                c.candidates(_bits(row["shared"], c.keys))
                gone = c.removed(_bits(row["earlier"], c.k1))
                n, lost, sha, kept = [], [], [], []
                for t, i, j in zip(c.texts, c.starts, c.starts[1:]):
                    g = gone[i:j]
                    words = t.split() if t else []
                    cut = int(g.sum())
                    left = words if not cut else [words[k] for k in np.flatnonzero(~g)]
                    n.append(len(words))
                    lost.append(cut)
                    sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
                    kept.append(None if t is None else _cut(t, g) if cut else t.decode())
                more = [pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
                table = c.rows
                for name, column in zip(["n_words", "n_removed", "kept_sha256", "kept_text"], more):
                    table = table.append_column(name, column)
                yield from table.combine_chunks().to_batches()

    return known.join(gathered(found, "earlier"), "chunk", "left").mapInArrow(result_rows, schema)


def op1_substring(spark, sf_dir: str) -> DataFrame:
    from docrecon.llm.common import load

    return substring_dedup(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
