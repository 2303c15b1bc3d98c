"""I-Match document fingerprints with randomised lexicons.

The lexicon is the terms within a band of inverse document frequency over all documents, that is, of document frequency
relative to the number of documents. LEVELS times SUBSETS random subsets of it, drawn term by term, keep a half of its terms,
a quarter and so on. For the whole lexicon and each subset a fingerprint has a hash of the sorted distinct terms of the text
that are in it. An edit changes the hashes of the subsets that hold a changed term: of texts of U terms together that differ
in D, the subsets of about log2(U / D) levels have terms and equal hashes. So the likeness of two fingerprints is
1 - 2 ** -(equal hashes / SUBSETS), which estimates 1 - D / U.

Terms are words hashed to LEXICON_BITS bits, and a term's document frequency is exact for its hash; so the lexicon is a bit
map of known size, which may be broadcast whatever the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import NO_ID, WordHashes, load, mixed, of_stage, parallelism, word_arrays

LEXICON_BITS = 22
SEGMENTS = 256
LEVELS, SUBSETS = 12, 16
#: The band: terms in this share of the documents at least (and in LEAST documents) and in this share at most.
LEAST, RARE, MOST = 2, 1e-4, 0.2
#: Texts whose fingerprints are made together.
BATCH = 64


def lexicon(docs: DataFrame) -> np.ndarray:
    """A bit for each hashed term: whether its document frequency is within the band. 2 ** LEXICON_BITS bits."""
    size = (1 << LEXICON_BITS) // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, n = of_stage("words", WordHashes), np.zeros(1 << LEXICON_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    total[np.unique(word_arrays([text], hashes, True)[0] >> np.uint64(64 - LEXICON_BITS))] += 1
        if n:
            parts = [total[i * size : (i + 1) * size].astype("<i4").tobytes() for i in range(SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(SEGMENTS)], pa.int32()), pa.array([n] * SEGMENTS, pa.int64()), pa.array([pa.compress(p, "zstd", asbytes=True) for p in parts], pa.binary())], ["segment", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs_seen: dict[int, int] = {}
        for batch in batches:
            for s, n, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums[s] = sums.get(s, 0) + np.frombuffer(pa.decompress(c, 4 * size, "zstd", asbytes=True), "<i4").astype(np.int64)
                docs_seen[s] = docs_seen.get(s, 0) + n
        for s, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits((x >= max(LEAST, RARE * docs_seen[s])) & (x <= max(LEAST, MOST * docs_seen[s]))).tobytes()], pa.binary())], ["segment", "bits"])

    rows = docs.select("text").mapInArrow(count, "segment int, n long, counts binary").repartition("segment").mapInArrow(add, "segment int, bits binary")
    out = np.zeros(1 << LEXICON_BITS, bool)
    for r in rows.collect():  # SEGMENTS rows
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out


def fingerprints_of(texts: list[str], known: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """A row for each text: the hashes (0 for no terms) of its terms in the lexicon, then of those in each subset, by level."""
    words, starts = word_arrays(texts, hashes, True)
    words_known = known[words >> np.uint64(64 - LEXICON_BITS)]
    lists = [np.unique(words[i:j][words_known[i:j]]) for i, j in zip(starts, starts[1:])]
    terms, owner, n = np.concatenate([*lists, np.empty(0, np.uint64)]), np.repeat(np.arange(len(lists)), list(map(len, lists))), len(lists)
    out = np.zeros((n, 1 + LEVELS * SUBSETS), np.uint16)

    def hashed(terms: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """A hash of each group's terms; groups stand one after the other."""
        ends, whole_list = np.cumsum(np.bincount(group, minlength=groups) * 8).tolist(), terms.tobytes()
        return np.array([1 + xxhash.xxh3_64_intdigest(whole_list[i:j]) % 0xFFFF if j > i else 0 for i, j in zip([0, *ends], ends)], np.uint16)

    out[:, 0] = hashed(terms, owner, n)
    # A term is in a subset of level k if its draw for the subset has k leading zeros.
    drawn = mixed(terms[None, :] ^ mixed(np.arange(1, SUBSETS + 1, dtype=np.uint64))[:, None])
    subset, at = np.nonzero(drawn >> np.uint64(63) == 0)
    drawn = drawn[subset, at]
    for level in range(1, LEVELS + 1):
        inside = drawn >> np.uint64(64 - level) == 0
        subset, at, drawn = subset[inside], at[inside], drawn[inside]
        first = 1 + (level - 1) * SUBSETS
        out[:, first : first + SUBSETS] = hashed(terms[at], subset * n + owner[at], SUBSETS * n).reshape(SUBSETS, n).T
    return out


def written(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of fingerprints: the estimated share of common terms among those of the two, 0 to 1; equal fingerprints: 1."""
    equal = ((a == b) & (a > 0))[:, 1:].sum(1)
    return np.where((a == b).all(1), 1.0, 1 - 0.5 ** (equal / SUBSETS))


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(pid, doc_id, text, ghost): documents dealt by ranges of doc_id, and in each range the first document of the next one (of
    the last range: the first of all) as a ghost. Bounds and firsts are one row a range."""
    spark, parts = docs.sparkSession, parallelism(docs.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(docs.agg(F.percentile_approx("key", shares, 20 * parts)).first()[0] or ())) if shares else []
    # The range of a key by binary search over the bounds, as one expression.
    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") >= bounds[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    dealt = docs.withColumn("pid", search(0, len(bounds)).cast("int"))
    firsts = [(r["pid"], r["key"]) for r in dealt.groupBy("pid").agg(F.min("key").alias("key")).orderBy("pid").collect()]
    moved = [(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))]
    ghosts = spark.createDataFrame(moved or [(0, 0)], "to int, key long")
    first = dealt.join(F.broadcast(ghosts), "key").groupBy("key", "to").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    # min() passes over null texts, and a null text is empty and first of all.
    return dealt.select("pid", "key", "doc_id", "text", F.lit(False).alias("ghost")).union(first.select(F.col("to").alias("pid"), "key", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("ghost"))), len(bounds) + 1


def fingerprints(docs: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double) for docs (doc_id,
    text), each with its edit: the last half of its characters replaced by as many of the next document, by doc_id (then by
    text), after the last the first. Null texts are empty; a null doc_id counts as larger than any other; rows that repeat are
    each other's next. A single document is its own next. Equal texts have equal fingerprints; a text without a term of the
    lexicon has one without hashes. Other columns of docs are left out.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(lexicon(docs) if known is None else known))
    rows, parts = with_next(docs)
    dealt = rows.repartitionByRange(parts, "pid").sortWithinPartitions("pid", "ghost", "key", "text")

    names, kinds = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.unpackbits(shared.value).astype(bool), of_stage("words", WordHashes)
        held: list[tuple] = []  # the last row of those before, with its fingerprint

        def told(rows: list[tuple]) -> pa.RecordBatch | None:
            made = fingerprints_of([r[2] for r in rows], bits, hashes)
            known, own = held + rows, np.concatenate([*(h[4][None, :] for h in held), made])
            pairs = [i for i in range(len(known) - 1) if known[i][0] == known[i + 1][0] and not known[i][3]]
            held[:] = [(*rows[-1][:4], made[-1])]
            if not pairs:
                return None
            texts = [(known[i][2], known[i + 1][2]) for i in pairs]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in texts]
            f, e = own[pairs], fingerprints_of(edited, bits, hashes)
            columns = [known[i][1] for i in pairs], [len(t) for t, _ in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [*map(written, f)], [*map(written, e)], likeness(f, e), likeness(f, own[[i + 1 for i in pairs]])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "text", "ghost"))))
            for i in range(0, len(rows), BATCH):
                if out := told(rows[i : i + BATCH]):
                    yield out

    return dealt.select("pid", F.col("doc_id").cast("long").alias("doc_id"), "text", "ghost").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "long", "string", "string", "string", "double", "double"))))


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))
