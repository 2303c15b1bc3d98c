"""What the operators of this folder share: scratch tables, chunks of documents, word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a chunk, the unit that one step of Python work holds in memory.
CHUNK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only where that is unset (a local
    session, as in tests) a temporary folder of this machine is set for it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/docrecon-{uuid.uuid4().hex}"


#: Folders written by this driver that are still there.
_scratch: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: later steps survive lost executors, and rows
    whose keys come from a partition number keep them."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession, since: int) -> None:
    """Delete the scratch folders written after the first `since` ones, but for the last. Only for those that no DataFrame in use
    reads any more."""
    for path in _scratch[since:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _scratch[since:-1]


def scratch_count() -> int:
    return len(_scratch)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def to_blob(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def split_batches(batches: Iterator[pa.RecordBatch], text: str, target: int = CHUNK_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Regroup Arrow batches into runs of rows of about `target` bytes of text. One longer row makes a run of its own."""
    held, size = [], 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in batch.column(text).cast(pa.large_binary()).to_pylist()], np.int64)
        start = 0
        while start < n:
            room = target - size
            fits = int(np.searchsorted(np.cumsum(sizes[start:]), room, side="right"))
            if fits == 0 and not held:
                fits = 1
            if fits:
                held.append(batch.slice(start, fits))
                size += int(sizes[start : start + fits].sum())
                start += fits
            if start < n:
                yield held
                held, size = [], 0
    if held:
        yield held


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """(chunk long, blob binary): the rows of docs, whole and with all columns, in compressed runs of about CHUNK_BYTES of
    text. Saved, so that a chunk keeps its number in each later step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = task_number() << 32
        for i, part in enumerate(split_batches(batches, text)):
            yield pa.RecordBatch.from_arrays([pa.array([base + i], pa.int64()), pa.array([to_blob(part)], pa.binary())], ["chunk", "blob"])

    return saved(docs.mapInArrow(run, "chunk long, blob binary"))


_held: dict = {"stage": None, "items": {}}


def of_stage(name: str, make: Callable):
    """An object that the tasks of one stage share in a Python worker; what earlier stages held is let go."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _held["stage"]:
        _held.update(stage=stage, items={})
        pa.default_memory_pool().release_unused()
    if name not in _held["items"]:
        _held["items"][name] = make()
    return _held["items"][name]


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; emptied when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_arrays(texts: list, hashes: WordHashes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, one after the other, and the n + 1 places where texts
    begin and end. Null has no words."""
    parts, ends = [], [0]
    for t in texts:
        if t:
            b = t if isinstance(t, bytes) else t.encode()
            words = (b.lower() if lower else b).split()
            parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            ends.append(ends[-1] + len(words))
        else:
            ends.append(ends[-1])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(ends, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n words in a row (also of those that cross from one text into the next)."""
    count = max(0, len(words) - n + 1)
    acc = np.full(count, (n * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1), np.uint64)
    factor = np.uint64((0x9FB21C651E98DF25 + 2 * seed * 0x2545F4914F6CDD1D) & (2**64 - 1) | 1)
    for k in range(n):
        acc = acc * factor + words[k : k + count]
    return mixed(acc)


def whole(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For all places of the concatenated words: the text it is in, and whether n words from there stay in it."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return doc, np.arange(len(doc)) + n <= starts[doc + 1] if len(doc) else np.empty(0, bool)


def ids_of(table: pa.Table, name: str) -> np.ndarray:
    """The ids as int64; null counts as larger than any other."""
    return table.column(name).cast(pa.int64()).fill_null(int(NO_ID)).to_numpy().astype(np.int64)


def grouped(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandas(run, schema)


def free_names(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that a result is about to add under the same names (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def count_if(c) -> F.Column:
    return F.sum(c.cast("long"))
