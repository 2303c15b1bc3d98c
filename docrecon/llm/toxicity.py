"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes.

All terms of all examples are indexed. A term's weight is its inverse document frequency, times how surely its presence
moves the share of toxic examples, plus FLOOR, so that no term is without weight: by IDF alone the neighbours of a text are
those of its subject. Examples stand in blocks of BLOCK, such with the same strongest term together. A block's bound for a
text has the largest weight in the block of each frequent term, and what rare terms give exactly; blocks that can't hold a
nearer example than the NEIGHBOURS found are passed over, so the neighbours are the exact ones. Votes are weighted by cosine
and turned into a score by a logistic curve, fitted on votes for examples of each half by a model of the other half.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import WordHashes, free_names, load, of_stage, saved

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the model is fitted on, at most (those with the least hashes of their doc_id).
MAX_EXAMPLES = 4_096
NEIGHBOURS, BLOCK = 64, 128
#: Least relevance of a term; terms in this share of the examples or more are kept as dense rows.
FLOOR, DENSE = 0.1, 1 / 16
THRESHOLD = 0.7
#: Texts that are looked up together, and of these such whose postings are.
BATCH, PART = 128, 8
#: Cosines are compared in steps of 1 / SCALE, on a tie the first place wins. Places need PLACE bits.
SCALE, PLACE = 1_000_000, 20


def terms_of(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(distinct terms of a text as ascending hashes, how often each occurs, where it occurs first, the words)."""
    words = WORD.findall(text.lower()) if text else []
    flat = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    terms, first, counts = np.unique(flat, return_index=True, return_counts=True)
    return terms, counts, first, words


def relevance(n: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """How far the toxic share of n examples is surely (Wilson bounds of 95 %) above or below the rate; 0 to 1."""
    z = 1.96
    middle, spread = (toxic + z * z / 2) / (n + z * z), z / (n + z * z) * np.sqrt(toxic * (n - toxic) / n + z * z / 4)
    above, below = (middle - spread - rate) / (1 - rate), (rate - middle - spread) / rate
    return np.maximum(0, np.maximum(above, below))


@dataclass
class Model:
    rate: float  # share of toxic examples
    curve: tuple[float, float]  # slope and offset of the logistic curve over the log odds of the vote
    ids: np.ndarray
    toxic: np.ndarray
    terms: np.ndarray  # hashes, ascending
    weight: np.ndarray  # of each term
    row: np.ndarray  # of each term: its dense row, or -1
    dense: np.ndarray  # rows of frequent terms: weight in each example
    highest: np.ndarray  # the largest of each block in those rows
    start: np.ndarray  # of each rare term: where its postings start
    place: np.ndarray
    posted: np.ndarray

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For texts as (places of known terms, weights of length 1): places and cosines of their nearest examples, nearest first."""
        n, size = len(texts), self.dense.shape[1]
        blocks = size // BLOCK
        owner = np.repeat(np.arange(n), [len(t) for t, _ in texts])
        term, weight = np.concatenate([t for t, _ in texts]), np.concatenate([w for _, w in texts])
        often = self.row[term] >= 0
        query = np.zeros((n, len(self.dense)), np.float32)
        query[owner[often], self.row[term[often]]] = weight[often]
        rare = np.zeros((n, blocks, BLOCK), np.float32)
        term, own, w = term[~often], owner[~often], weight[~often]
        cuts = np.searchsorted(own, np.arange(0, n + PART, PART))
        for first, i, j in zip(range(0, n, PART), cuts, cuts[1:]):
            length = self.start[term[i:j] + 1] - self.start[term[i:j]]
            at = np.repeat(self.start[term[i:j]] - np.cumsum(length) + length, length) + np.arange(length.sum())
            some = min(PART, n - first)
            rare[first : first + some] = np.bincount(np.repeat(own[i:j] - first, length) * size + self.place[at], np.repeat(w[i:j], length) * self.posted[at], some * size).reshape(some, blocks, BLOCK)
        bound = np.rint((rare.max(2) + query @ self.highest) * SCALE).astype(np.int64) + 2
        # A candidate is one number: its cosine in steps, then its place, the first one highest.
        last = np.int64((1 << PLACE) - 1)
        best = np.full((n, NEIGHBOURS), -1, np.int64)
        for b in np.argsort(-bound.mean(0)):
            rows = np.flatnonzero((bound[:, b] >= best[:, 0] >> PLACE) & (bound[:, b] > 2))
            if len(rows):
                cosine = rare[rows, b] + query[rows] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
                found = (np.rint(cosine * SCALE).astype(np.int64) << PLACE) | (last - np.arange(b * BLOCK, (b + 1) * BLOCK))
                # The least of those kept comes first.
                best[rows] = np.partition(np.concatenate([best[rows], found], 1), BLOCK, 1)[:, BLOCK:]
        best.sort(1)
        places, cosines = [], []
        for found in best[:, ::-1]:
            found = found[found >> PLACE > 0]
            places.append(last - (found & last))
            cosines.append((found >> PLACE) / SCALE)
        return places, cosines

    def known(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the known ones among the terms of a text, their places in the model, weights of length 1)."""
        at = np.searchsorted(self.terms, terms)
        own = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.empty(0, np.int64)
        at = at[own]
        w = (1 + np.log(counts[own])) * self.weight[at]
        return own, at, w / math.sqrt((w * w).sum()) if len(w) else w

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The votes for texts (places of known terms, weights), and the places of their nearest examples."""
        if not len(self.terms):
            return np.full(len(texts), self.rate), [np.empty(0, np.int64)] * len(texts)
        places, cosines = self.nearest(texts)
        # The rate votes as a far example does, so that a text without any has the rate.
        return np.array([(float((c * self.toxic[p]).sum()) + 0.1 * self.rate) / (float(c.sum()) + 0.1) for p, c in zip(places, cosines)]), places

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * odds(votes) + self.curve[1])))


def odds(votes: np.ndarray) -> np.ndarray:
    votes = np.clip(votes, 1e-6, 1 - 1e-6)
    return np.log(votes / (1 - votes))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and offset of the most likely logistic curve, by Newton's method, slightly drawn to slope 1, offset 0."""
    points, beta = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-points @ beta))
        step = np.linalg.solve((points * (p * (1 - p))[:, None]).T @ points + np.eye(2), points.T @ (y - p) + np.array([1.0, 0.0]) - beta)
        beta = np.clip(beta + step, [0.0, -20.0], [20.0, 20.0])
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def index(examples: pa.Table) -> Model:
    """A model of examples (doc_id, toxic, terms, counts), with the curve of the plain vote."""
    n = examples.num_rows
    toxic = examples.column("toxic").to_numpy().astype(float)
    rate = float(toxic.mean()) if n else 0.0
    nothing = np.empty(0, np.int64)
    if not 0 < rate < 1:
        return Model(rate, (1.0, 0.0), nothing, np.empty(0), np.empty(0, np.uint64), np.empty(0), nothing, np.empty((0, 0)), np.empty((0, 0)), nothing, nothing, np.empty(0))
    lists = examples.column("terms").combine_chunks()
    length = np.asarray(lists.value_lengths())
    owner = np.repeat(np.arange(n), length)
    terms, flat = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    tf = 1 + np.log(examples.column("counts").combine_chunks().flatten().to_numpy())
    df, share = np.bincount(flat, minlength=len(terms)), np.bincount(flat, toxic[owner], len(terms))
    weight = (np.log((1 + n) / (1 + df)) + 1) * (FLOOR + relevance(df, share, rate))
    w = tf * weight[flat]
    w /= np.sqrt(np.bincount(owner, w * w, n))[owner]
    # Examples with the same strongest term that others have too stand together: their blocks have tight bounds.
    strongest = np.full(n, -1)
    order = np.lexsort((flat, np.where(df[flat] > 1, w, 0)))
    strongest[owner[order]] = flat[order]
    ids = examples.column("doc_id").to_numpy()
    new = np.lexsort((ids, strongest))
    moved = np.empty(n, np.int64)
    moved[new] = np.arange(n)
    place, size = moved[owner], -(-n // BLOCK) * BLOCK
    often = df >= max(2, DENSE * n)
    row = np.where(often, np.cumsum(often) - 1, -1)
    dense = np.zeros((int(often.sum()), size), np.float32)
    dense[row[flat[often[flat]]], place[often[flat]]] = w[often[flat]]
    rare = np.flatnonzero(~often[flat])
    rare = rare[np.lexsort((place[rare], flat[rare]))]
    start = np.searchsorted(flat[rare], np.arange(len(terms) + 1))
    return Model(rate, (1.0, 0.0), ids[new], toxic[new], terms, weight, row, dense, dense.reshape(len(dense), size // BLOCK, BLOCK).max(2), start, place[rare].astype(np.int32), w[rare].astype(np.float32))


EXAMPLES = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


@dataclass
class Fitted:
    """A model as bytes, and its curve."""

    blob: bytes
    curve: tuple[float, float]

    def model(self) -> Model:
        m = pickle.loads(self.blob)
        m.curve = self.curve
        return m


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Fitted:
    """A model from rows of labels (doc_id, toxic) whose crc32(doc_id as text) mod 3 isn't 1, at most max_examples of them.

    The chosen ids are broadcast, one task indexes their texts, and the model's bytes reach the driver (max_examples bounds all). Labels that are
    null or without a document teach nothing; of labels that disagree the toxic one holds; of documents that repeat a doc_id
    the text that sorts last is the example's. Without toxic or without other examples all scores are the rate.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_stage("words", WordHashes)
        for batch in batches:
            found = [terms_of(t, hashes)[:2] for t in batch.column("text").to_pylist()]
            lists = [pa.array([x[i].view(np.int64) for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic"), *lists], ["doc_id", "toxic", "terms", "counts"])

    examples = saved(texts.mapInArrow(counted, "doc_id long, toxic int, terms array<long>, counts array<long>"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), EXAMPLES).sort_by("doc_id")
        even = np.arange(table.num_rows) % 2 == 0
        for name, part in (("all", table), ("even", table.filter(pa.array(even))), ("odd", table.filter(pa.array(~even)))):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pickle.dumps(index(part))], pa.binary())], ["name", "model"])

    # One task indexes the bounded sample, so the driver holds models as bytes only.
    built = saved(examples.coalesce(1).mapInArrow(build, "name string, model binary"))
    blob = lambda name: bytes(row["model"]) if (row := built.where(F.col("name") == name).first()) else pickle.dumps(index(EXAMPLES.empty_table()))
    ids = np.sort(np.array([r[0] for r in examples.select("doc_id").collect()], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast((blob("even"), blob("odd"), ids))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, every = of_stage("halves", lambda: [*map(pickle.loads, shared.value[:2])]), shared.value[2]
        for batch in batches:
            terms, counts = ([np.array(x) for x in batch.column(c).to_pylist()] for c in ("terms", "counts"))
            first = np.searchsorted(every, batch.column("doc_id").to_numpy()) % 2 == 0
            for own, m in ((first, models[1]), (~first, models[0])):
                rows = np.flatnonzero(own) if len(m.terms) else []
                for i in range(0, len(rows), BATCH):
                    part = rows[i : i + BATCH]
                    votes, _ = m.votes([m.known(terms[j].astype(np.int64).view(np.uint64), counts[j])[1:] for j in part])
                    yield pa.RecordBatch.from_arrays([pa.array(votes), batch.column("toxic").take(pa.array(part)).cast(pa.float64())], ["vote", "toxic"])

    found = sorted((r["vote"], r["toxic"]) for r in examples.repartition(16).mapInArrow(crossed, "vote double, toxic double").collect())
    shared.destroy()
    curve = logistic(odds(np.array([v for v, _ in found])), np.array([t for _, t in found])) if found else (1.0, 0.0)
    return Fitted(blob("all"), curve)


def score_toxicity(docs: DataFrame, model: Fitted, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out boolean, score double (0 to 1), predicted int (1 from the threshold on), evidence array<string> (the
    terms with the most weight), examples array<long> (doc_ids of the nearest three). Null and empty texts, and such without
    a term of any example, have no neighbours and the score of the plain rate. Equal texts have equal neighbours; of examples
    that are equally near the first in the index counts. Columns of docs with one of these names are replaced. The model
    is broadcast; its size is bounded by MAX_EXAMPLES texts."""
    docs = free_names(docs, ["held_out", "score", "predicted", "evidence", "examples"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double, evidence array<string>, examples array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = of_stage("model", lambda: shared.value.model()), of_stage("words", WordHashes)
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, BATCH):
                batch = whole_batch.slice(i, BATCH)
                vectors, evidence = [], []
                for text in batch.column("text").to_pylist():
                    terms, counts, first, words = terms_of(text, hashes)
                    own, at, w = m.known(terms, counts)
                    vectors.append((at, w))
                    top = np.lexsort((terms[own], -w))[:5] if len(w) < 6 else np.argpartition(-w, 5)[:5]
                    evidence.append([words[first[own[j]]] for j in top[np.lexsort((terms[own[top]], -w[top]))]])
                votes, places = m.votes(vectors)
                more = {"score": pa.array(m.score(votes)), "evidence": pa.array(evidence, pa.list_(pa.string())), "examples": pa.array([m.ids[p[:3]] for p in places], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    return docs.mapInArrow(run, schema).withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit(docs, load(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
