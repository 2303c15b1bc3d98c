"""The pipeline: each stage against brute force on what the stage before it kept, and as a whole."""

import random
import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from docrecon.llm import common
from docrecon.llm.tokens import vocabulary
from docrecon.llm.toxicity import fit, score_toxicity
from test_llm import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "which of these twelve words of a question is known to be the answer"


def rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: text(rng.choice([1, 4, 30, 80])) for i in range(80)}
    for i in range(80, 100):  # toxic
        texts[i] = f"{text(20)} vile {text(9)} awful nasty {text(9)}"
    passage = text(60)
    for i in range(100, 106):
        texts[i] = f"{text(50)} {passage} {text(50)}"
    texts[106] = " ".join(passage.split()[3:50])  # nothing is left of it
    for i in range(110, 118):  # near copies
        base = texts[3 if len(texts[3].split()) > 20 else 100].split()
        base[i % 5] = f"edit{i}"
        texts[i] = " ".join(base)
    texts |= {120: f"{text(30)} {ITEM.upper()} {text(30)}", 121: ITEM, 130: None, 131: "", 132: " \n", 133: texts[101], 134: text(5000)}
    out = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return [*out, out[5], out[5], (140, None, None, None, None), (None, text(40), None, None, None), (None, texts[100], None, None, None), (150, "one " * 9, "x", "y", 1), (150, "another text", "x", "y", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).selectExpr("*", "1 as Score", "'x' as hit").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(80 <= i < 100)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q1", ITEM), ("q2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain(df):
    return sorted((tuple(r) for r in df.select(*p.COLUMNS).collect()), key=repr)


def test_stages(spark, folder):
    docs = common.load(spark, folder, "documents")
    # Toxicity: what the scores say (tests of op4 hold them against a full scan); all toxic ones go, all clean ones stay.
    out = common.saved(p.toxicity(spark, docs, folder))
    scores = score_toxicity(docs.select(*p.COLUMNS), fit(docs, common.load(spark, folder, "labels")))
    assert plain(out) == plain(scores.where("score < 0.7")) and out.columns == p.COLUMNS
    assert {r[0] for r in plain(docs)} - {r[0] for r in plain(out)} == set(range(80, 100))
    # Near duplicates: the least of each component of all pairs; one of equal rows.
    docs = out
    out = common.saved(p.near_duplicates(spark, docs, folder))
    before = plain(docs)
    kept = {i for i, _, _, k in brute_components([(10**6 if r[0] is None else r[0], r[1], None) for r in before], 80) if k}
    assert plain(out) == sorted({r for r in before if r[0] is None or r[0] in kept}, key=repr) and len(before) > out.count() + 8
    # Passages: words of 13-word windows that a smaller doc_id has are gone; a document without words left too.
    docs, first = out, {}
    out = common.saved(p.repeated_passages(spark, docs, folder))
    before = plain(docs)
    for r in sorted(before, key=lambda r: 10**6 if r[0] is None else r[0]):
        w = (r[1] or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), r[0])
    want = []
    for r in before:
        w = (r[1] or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            owner = first[tuple(w[k : k + 13])]
            if owner is not None and (r[0] is None or owner < r[0]):
                gone[k : k + 13] = [True] * 13
        if w and all(gone):
            continue
        want.append((r[0], (r[1] or "").split() if not any(gone) else [x for x, g in zip(w, gone) if not g]))
    assert sorted(((r[0], (r[1] or "").split()) for r in plain(out)), key=repr) == sorted(want, key=repr)
    assert 106 not in {r[0] for r in plain(out)} and all(r[4] == (None if r[1] is None else len(r[1])) for r in plain(out))
    # Benchmark: documents with ten words in a row of an item go.
    docs = out
    out = common.saved(p.benchmark_leaks(spark, docs, folder))
    item = ITEM.split()
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}

    def leaks(text):
        w = re.findall("[a-z0-9]+", (text or "").lower())
        return any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))

    assert plain(out) == [r for r in plain(docs) if not leaks(r[1])] and {120, 121} <= {r[0] for r in plain(docs) if leaks(r[1])}
    # Packing: every token of every document, in pieces without gaps, none in two places.
    docs, lib = out, Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    got = p.packing(spark, docs, folder).collect()
    lengths = Counter((r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in plain(docs))
    want = Counter()
    for (i, n), times in lengths.items():
        for k in range(0, n, 2048):
            want[(i, k // 2048, k, min(2048, n - k))] += times
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        ends = [0, *(a + b for a, b in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    # The whole is its stages one after the other, and leaves one scratch folder.
    left = common.scratch_count()
    whole = p.run(spark, folder)
    assert sorted((r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in got)
    assert common.scratch_count() == left + 1


def test_stages_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        common.load(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
    none = common.load(spark, folder, "documents").limit(0)
    assert all(stage(spark, none, folder).collect() == [] for _, stage in p.STAGES)
    # Without labels or items nothing is dropped by their stages.
    docs = common.load(spark, folder, "documents")
    assert plain(p.toxicity(spark, docs, str(tmp_path))) == plain(p.benchmark_leaks(spark, docs, str(tmp_path))) == plain(docs)
