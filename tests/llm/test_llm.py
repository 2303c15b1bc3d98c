"""The operators of docrecon.llm against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docrecon.llm import toxicity as tox
from docrecon.llm.common import WordHashes, mixed
from docrecon.llm.decontaminate import Windows, decontaminate
from docrecon.llm.fingerprint import LEVELS, SUBSETS, fingerprints
from docrecon.llm.html_text import OTHER, blocks_of, extract_text, shared_runs
from docrecon.llm.licences import ANY, HINTS, KNOWN, scan_licences
from docrecon.llm.near_dup import near_dedup
from docrecon.llm.packing import pack, plan
from docrecon.llm.shards import shard_documents, shard_of, tree
from docrecon.llm.substring import substring_dedup
from docrecon.llm.tokens import Packed, vocabulary
from docrecon.llm.wavelet import WaveletMatrix, encode_shard, read_shards, token_shards

DOCS = "doc_id long, text string, N_WORDS string"


def made(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "naïve."]
    text = lambda k: rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(k))
    passage = text(30)
    out = [(i, text(rng.choice([0, 1, 3, 12, 13, 40, 90])), "x") for i in range(n)]
    out += [(100 + i, f"{text(5)} {passage} {text(4)}", None) for i in range(6)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(12):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(120)] = "edit%d" % rng.randrange(9)
        out.append((200 + i, " ".join(copy), "x"))
    return [*out, (300, None, None), (301, "", "x"), (302, out[3][1], "x"), (303, out[70][1], "x"), (303, out[70][1], "x"), (304, "long " + text(3000), "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_substring(spark, docs, none):
    rows = sorted(made(), key=lambda r: r[0])
    first = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    out = substring_dedup(docs)
    assert sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(want)
    assert sum(w[2] for w in want) > 100
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept[300]["kept_text"] is None and hashlib.sha256(b" ".join(kept[104]["kept_text"].encode().split())).hexdigest() == kept[104]["kept_sha256"]
    assert substring_dedup(none).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(docs, 12)


def brute_components(rows, percent):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("group", [4096, 5])
def test_near_dup(spark, docs, none, monkeypatch, group):
    """With groups of 5 the comparison across parts is at work, also of several pieces of queries; hubs have 4 links."""
    import docrecon.llm.graph as g
    import docrecon.llm.near_dup as m

    monkeypatch.setattr(m, "GROUP", group)
    monkeypatch.setattr(g, "HUB", group - 1)
    rows = made()
    if group == 5:
        monkeypatch.setattr(m, "FEW_GROUPS", 0)
        rng = random.Random(2)
        base = [f"b{i}" for i in range(60)]
        for i in range(40):  # pairs of near copies that share much with all others
            own = [f"v{i // 2}x{k}" if k % 6 == 0 else w for k, w in enumerate(base)]
            own[rng.randrange(60)] = "edit"
            rows.append((500 + i, " ".join(own[:59] + [f"z{i}"]), None))
    assert sorted(tuple(r) for r in near_dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()) == brute_components(rows, 85)
    if group > 5:
        assert near_dedup(none).collect() == []


def test_decontaminate(spark, docs, none):
    items = [("10", made()[62][1]), ("9", "W1 w2"), (None, None), ("a", "!!"), ("b", made()[5][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    known = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            known[tuple(w[k : k + 10])].add(i)
    want = []
    for i, t, _ in made():
        w = word.findall(low(t))
        hit, ids = set(), set()
        for q, owners in known.items():
            for k in range(len(w) - len(q) + 1):
                if tuple(w[k : k + len(q)]) == q:
                    hit.update(range(k, k + len(q)))
                    ids |= owners
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    texts = {i: t for i, t, _ in made()}
    named = docs.withColumnsRenamed({"N_WORDS": "HIT"}).withColumns({"item": F.lit(1), "Spans": F.lit("x")})
    # In one automaton, and in one for each item or so.
    for source, size in ((docs, 1 << 20), (named, 60)):
        out = decontaminate(source, bench.union(bench), block_bytes=size)
        got = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans").collect()
        assert sorted(tuple(r)[:6] for r in got) == sorted(want) and sum(w[5] for w in want) > 3
        for r in got:
            assert sum(len(word.findall(texts[r["doc_id"]][s["begin"] : s["end"]])) for s in r["spans"]) == r["n_hit"]
    assert {"HIT", "item", "spans"} <= set(out.columns)
    assert decontaminate(none, bench).collect() == [] and not decontaminate(docs, bench.limit(0)).where("contaminated or n_items > 0").count()
    one = decontaminate(docs.where("doc_id = 102"), spark.createDataFrame([(None, made()[62][1])], bench.schema)).first()
    assert one["n_hit"] == one["n_words"] and one["n_items"] == 1 and one["item_ids"] == []


def test_windows_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        some = lambda n: [rng.choice("abc") for _ in range(n)]
        items, window = [some(rng.choice([0, 1, 2, 4, 6, 30])) for _ in range(5)], rng.choice([1, 2, 5, 7])
        machine = Windows([(str(i), " ".join(t)) for i, t in enumerate(items)], window)
        for _ in range(5):
            text = some(40)
            hit, found = set(), set()
            for i, t in enumerate(items):
                for k in range(max(1, len(t) - window + 1) if t else 0):
                    w = t[k : k + window]
                    for at in [at for at in range(40 - len(w) + 1) if text[at : at + len(w)] == w]:
                        hit.update(range(at, at + len(w)))
                        found.add(i)
            assert machine.search([w.encode() for w in text]) == (hit, found)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_library_s(name):
    own, lib = Packed(vocabulary(name)), Tokenizer.from_str(vocabulary(name))
    rng = random.Random(3)
    bits = ["a", "Bc", " ", "  ", "\n", "\t", "\x1c", " ", "　", "\xa0", "'s", "'", "!", "12", "É", "é", "Σ", "ς", "İ", "ß", "<|endoftext|>", "|", "的", "😀", "\x00", "²", "ª", "ſ"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        assert own.ids(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_words_before_marks_and_lines_need_no_pattern():
    own, lib = Packed(vocabulary("byte_bpe_50k.json")), Tokenizer.from_str(vocabulary("byte_bpe_50k.json"))
    same = lambda text: own.ids(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    pattern, own.pattern = own.pattern, None
    assert same("Ouanque ouanque, ouanque. été!!\nÉté ouanque.\nOuanque,!! ouanque\nouanque")
    assert set(own) >= {"ouanque", "été"} and own["ouanque."] == own["ouanque"] + own.merged["."]
    own.pattern = pattern
    rng = random.Random(4)
    bits = ["ab", "Été", "of", "the", " ", " ", " ", "\n", "\r\n", "\n\n", "\t", "\x00", "\x1f", ".", ",", "!!", "'", "'s", "'ll", "’", "_", "$", "1", "½", "e\u0301", "\u2028"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert same(text), repr(text)


def test_wavelet(spark, docs, none):
    lib = Tokenizer.from_str(vocabulary("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t, _ in sorted(made(), key=lambda r: (r[0], r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    shards = token_shards(docs, shard_tokens=500)
    assert shards.count() > 5 and sorted(tuple(r) for r in read_shards(shards).collect()) == sorted(want)
    assert read_shards(token_shards(none)).collect() == []
    a = np.random.default_rng(0).zipf(1.3, 70_000) % 50_000
    m = WaveletMatrix(encode_shard(a.astype(np.uint32), [1], [len(a)]))
    assert (m.all() == a).all() and [m.access(i) for i in (0, 65_535, 65_536, 69_999)] == a[[0, 65_535, 65_536, 69_999]].tolist()
    for token in (1, 2, 30, 49_999):
        at = np.flatnonzero(a == token)
        assert m.count(token) == len(at) and m.count(token, 100, 66_000) == ((at >= 100) & (at < 66_000)).sum()
        assert [m.locate(token, k) for k in range(0, len(at), max(1, len(at) // 3))] == at[:: max(1, len(at) // 3)].tolist()


def test_packing(spark, docs, none):
    lib = Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    want = []
    for i, t, _ in made():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = pack(docs).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(none).collect() == []


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1.2, 20_000).astype(int) + 1, 2048)
    count = Counter(lengths.tolist())
    rows = plan(count, 2048)
    placed, full = Counter(), Counter()
    for length, lo, hi, sequence, _ in rows:
        placed[length] += hi - lo
        for k in range(hi - lo):
            full[sequence + k] += length
    assert placed == count and max(full.values()) <= 2048
    assert len(full) <= 1.005 * -(-lengths.sum() // 2048) + 1


def test_sharding(spark, docs, none):
    out = shard_documents(docs).toPandas()
    texts = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in made())
    assert Counter(zip(out["doc_id"], out["size"], out["text_crc32"])) == texts
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert shard_documents(none).count() == 0
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    uneven = [(r, k, 3.0 if r == "r0" else w) for r, k, w in tree(24)]
    x = keys.select(shard_of(F.col("k"), tree(24)).alias("a"), shard_of(F.col("k"), tree(25)).alias("b"), shard_of(F.col("k"), uneven).alias("c")).toPandas()
    assert set(x["b"][x["a"] != x["b"]]) == {24} and x["a"].nunique() == 24 and x["a"].value_counts().max() < 1.25 * len(x) / 24
    moved = x[x["a"] != x["c"]]
    assert len(moved) and (moved["c"] < 8).all()  # only into the region whose weight grew


def test_html(spark):
    chrome = "<nav><a>Home</a><a>About us</a></nav><div class='cookie-notice'>We use cookies</div>"
    plain = [f"<html><body>{chrome}<div>site of many pages here</div><p>unique text number{i} of page{i} {'x' * i}y</p><footer>end</footer></body></html>" for i in range(4)]
    article = f"<head><title>t</title></head><body>{chrome}<article><h1>T&eacute;st  &amp; more</h1><script>var a='</p>';</script><p>One <b>two</b>\n three<br>four<!-- no --><p>Five<div id=comments>bad</div></article>"
    rows = [*((i, "http://A.example/x", p) for i, p in enumerate(plain)), (9, "http://b.example/", article), (10, None, None), (11, "nonsense", "")]
    got = {r["page_id"]: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9]["text"] == "Tést & more\nOne two three four\nFive" and got[10]["text"] == got[11]["text"] == "" and got[10]["n_chars"] == 0
    assert [got[i]["text"] for i in range(4)] == [f"unique text number{i} of page{i} {'x' * i}y" for i in range(4)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert shared_runs(np.array([1, 2, 3, 4, -1, 9, 1, 2, 3, 4, -1]), np.array([0] * 5 + [1] * 6), 3, 2).tolist() == [True] * 4 + [False, False] + [True] * 4 + [False]


def page_rows():
    say = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    return say, "page_id long, url string, html string"


def test_html_host_in_groups(spark):
    say, schema = page_rows()
    # Of 300 pages three share a long run and three a short block; groups of a few pages hold them once or twice.
    page = lambda i: f"<div>{say(f'own{i}x', 30)} {say('both', 25) if i in (7, 150, 290) else ''} {say(f'end{i}x', 5)}</div>" + ("<p>Three have this</p>" if i in (3, 99, 201) else "<p>Two have this</p>" if i < 2 else "")
    rows = [*((i, "http://hot.example/", page(i)) for i in range(300)), (900, "http://cold.example/", page(7)), (901, None, None)]
    frame = spark.createDataFrame(rows, schema).repartition(5)
    whole, dealt = ({r["page_id"]: r["text"] for r in extract_text(frame, b).collect()} for b in (8 << 20, 4096))
    assert whole == dealt and len(dealt) == 302
    assert dealt[7] == f"{say('own7x', 30)} {say('end7x', 5)}" and "both24" in dealt[900]
    assert "Three" not in dealt[99] and "Two have this" in dealt[1]


@pytest.mark.parametrize("size", [8 << 20, 4096])
def test_html_repeated_rows_and_mirrors(spark, size):
    """Rows that repeat a page_id are one page, with other html too; a page all of which others have keeps its text; pages of no host,
    and such without page_id, aren't compared; other columns may have any names."""
    say, schema = page_rows()
    note = say("note", 30)
    page = lambda tag: f"<div>{say(tag, 60)}</div><p>{note}</p>"
    rows = [(1, "http://a/", page("one"))] * 3 + [(2, "http://a/", page("two")), (2, "http://a/", page("two") + "<p>x</p>"), (3, "http://a/", page("three"))]
    rows += [(10 + i, f"http://m/{i}", page("same")) for i in range(4)] + [(20 + i, None if i % 2 else "/x", page(f"p{i}q")) for i in range(6)]
    rows += [(None, "http://n/", page(f"n{i}q")) for i in range(3)] + [(40, "http://big/", f"<div>{say('long', 40_000)}</div>")] + [(50 + i, "http://a/", page(f"z{i}z")) for i in range(12)]
    out = extract_text(spark.createDataFrame(rows, schema).selectExpr("*", "1 AS host", "2 AS TEXT", "3 AS part").repartition(3), size).collect()
    texts = {}
    for r in out:
        texts.setdefault(r["page_id"], []).append(r["text"])
    assert len(out) == len(rows) and texts[1] == [say("one", 60)] * 3 and sorted(texts[2]) == [say("two", 60), say("two", 60) + "\nx"]
    assert all(texts[10 + i] == [f"{say('same', 60)}\n{note}"] for i in range(4)) and all(texts[20 + i] == [f"{say(f'p{i}q', 60)}\n{note}"] for i in range(6))
    assert sorted(texts[None]) == sorted(say(f"n{i}q", 60) for i in range(3)) and texts[40] == [say("long", 40_000)]


def test_html_hidden_and_named_parts():
    page = "<article>Kept<p hidden>no</p><div style='display: none'>no</div><div class='user-comment-list'>no</div><div class='post-ad-slot'>no</div><p class='hidden-gem' data-hidden-x='1'>too</p></article><div id='copyright'>no</div><div class='content-sidebar-wrap'>Body</div>"
    assert [text for kind, text in blocks_of(page) if kind != OTHER] == ["Kept", "too", "Body"]


def test_html_long_repeats(spark):
    say, schema = page_rows()
    note = say("note", 30)
    # A phrase of four words that pages share stays in their prose; a long note goes, also out of an article; a copied article stays.
    rows = [(i, "http://a.example/", f"<body><div>{say(f'a{i}x', 9)} as we have seen {say(f'b{i}x', 9)}</div><p>{note}</p></body>") for i in range(4)]
    rows += [(10 + i, "http://b.example/", f"<article><p>{say(f'c{i}x', 90)}</p><p>{note}</p></article>") for i in range(4)]
    rows += [(20 + i, "http://c.example/", f"<article><p>{note}</p><p>{note}</p></article>") for i in range(4)]
    for size in (8 << 20, 600):
        got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, schema), size).collect()}
        assert [got[i] for i in range(4)] == [f"{say(f'a{i}x', 9)} as we have seen {say(f'b{i}x', 9)}" for i in range(4)]
        assert [got[10 + i] for i in range(4)] == [say(f"c{i}x", 90) for i in range(4)] and got[20] == f"{note}\n{note}"
    rng = random.Random(3)
    for _ in range(20):
        tokens = np.array([rng.choice([1, 1, 1, 2, -1]) for _ in range(80)])
        page, run = np.sort(np.array([rng.randrange(5) for _ in range(80)])), rng.choice([1, 2, 3, 5, 7])
        page[1:] = np.maximum.accumulate(page)[1:]
        having = defaultdict(set)
        at = [i for i in range(80 - run + 1) if -1 not in tokens[i : i + run]]
        for i in at:
            having[tuple(tokens[i : i + run])].add(page[i])
        want = np.zeros(80, bool)
        for i in at:
            want[i : i + run] |= len(having[tuple(tokens[i : i + run])]) >= 3
        assert shared_runs(tokens, page, run, 3).tolist() == want.tolist()


@pytest.mark.parametrize("page", [
    "<body class='page has-sidebar'><main><p>Kept</p></main></body>",
    "<body><div id='content-sidebar-wrap'><main><p>Kept</p></main></div></body>",
    "<body><div id='content-sidebar-wrap'><p>Kept</p></div></body>",
    "<article class='post has-comments'><p>Kept</p><div id='comments'><article>Thanks</article></div></article>",
    "<div class='search-page'><p>Kept</p></div>",
    "<form id='all'><div class='sidebar'><article>Teaser</article></div><article><p>Kept</p><div class='sidebar-left'>x</div></article></form>",
    "<head><title>t</title><body><p>Kept</p><nav><article>Menu</article></nav><div class='ad-box'>x</div><div class='cookie-notice'>y</div>",
])
def test_html_names(page):
    assert [text for kind, text in blocks_of(page) if kind != OTHER] == ["Kept"]


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(60)] + (rng.sample(["vile", "awful", "nasty"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (700, None), (701, ""), (0, rows[0][1])], "doc_id long, text string")
    model = tox.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    out = tox.score_toxicity(docs, model).collect()
    assert len(out) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    empty = tox.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in tox.score_toxicity(docs, empty).collect()} == {0}
    # Other columns stay, but for those with the names of results; rows that repeat, and texts of any length, have scores.
    odd = spark.createDataFrame([(1, "vile " * 50_000, "a", 1), (1, "vile " * 50_000, "a", 1), (None, "vile awful", None, 2)], "doc_id long, text string, SCORE string, more int")
    out = tox.score_toxicity(odd, model).collect()
    assert len({r["score"] for r in out[:2]}) == 1 and min(r["score"] for r in out) > 0.7 and out[0]["more"] == 1 and len(out[0]) == 8
    assert tox.score_toxicity(odd.limit(0), model).collect() == []


def test_toxicity_against_a_full_scan(spark):
    """Term weights, cosines, neighbours and votes in plain Python, on more examples than blocks hold."""
    rng = random.Random(6)
    words = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'xyz'[i // 100]}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 30, 300])]) for _ in range(rng.randrange(1, 40))) + (" vile" if i % 5 == 0 else "") for i in range(400)]
    texts[7] = texts[8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = tox.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 5 = 0) toxic"))
    model = fitted.model()
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(model.ids.tolist()) == known and model.dense.shape[1] // tox.BLOCK > 1 and len(model.dense)
    rate, n = sum(i % 5 == 0 for i in known) / len(known), len(known)
    df, bad = Counter(w for i in known for w in set(texts[i].split())), Counter(w for i in known if i % 5 == 0 for w in set(texts[i].split()))

    def weight(w):
        k, t, z = df[w], bad[w], 1.96
        center, spread = (t + z * z / 2) / (k + z * z), z / (k + z * z) * (t * (k - t) / k + z * z / 4) ** 0.5
        return (np.log((1 + n) / (1 + k)) + 1) * (0.1 + max(0, (center - spread - rate) / (1 - rate), (rate - center - spread) / rate))

    def vector(text):
        v = {w: (1 + np.log(c)) * weight(w) for w, c in Counter(text.split()).items() if w in df}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    own = {i: vector(texts[i]) for i in known}
    got = {r["doc_id"]: r for r in tox.score_toxicity(docs, fitted).collect()}
    for i in range(0, 400, 7):
        v = vector(texts[i])
        cosines = sorted(((sum(x * own[k].get(w, 0) for w, x in v.items()), k) for k in known), reverse=True)
        near = [(c, k) for c, k in cosines[: tox.NEIGHBOURS] if c > 1e-6]
        terms, counts, _, _ = tox.terms_of(texts[i], WordHashes())
        votes, places = model.votes([model.known(terms, counts)[1:]])
        found = [(sum(x * own[k].get(w, 0) for w, x in v.items()), k) for k in model.ids[places[0]].tolist()]
        assert np.allclose([c for c, _ in found], [c for c, _ in near], atol=2e-5)
        # Neighbours that tie for the last place may differ.
        if cosines[tox.NEIGHBOURS - 1][0] - cosines[tox.NEIGHBOURS][0] > 2e-5:
            vote = (sum(c * (k % 5 == 0) for c, k in near) + 0.1 * rate) / (sum(c for c, _ in near) + 0.1)
            assert abs(votes[0] - vote) < 1e-4 and abs(got[i]["score"] - 1 / (1 + np.exp(-(model.curve[0] * np.log(vote / (1 - vote)) + model.curve[1])))) < 1e-3


def brute_fingerprint(text, band):
    terms = sorted({xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()} & band)
    draw = lambda t, s: int(mixed(np.uint64([t ^ int(mixed(np.uint64([s]))[0])]))[0])
    lists = [terms] + [[t for t in terms if draw(t, s + 1) >> (64 - level) == 0] for level in range(1, LEVELS + 1) for s in range(SUBSETS)]
    return "".join(f"{1 + xxhash.xxh3_64_intdigest(np.array(x, '<u8').tobytes()) % 0xFFFF if x else 0:04x}" for x in lists)


@pytest.mark.parametrize("nulls", [0, 2])
def test_fingerprints(spark, docs, none, nulls):
    """nulls: of every so many rows one has no doc_id."""
    rng = random.Random(4)
    more = [(400 + i, " ".join(f"r{rng.randrange(90)}" for _ in range(30)), None) for i in range(20)]
    made_rows = [(None if nulls and k % nulls == 0 else i, t) for k, (i, t, _) in enumerate(made() + more)]
    order = sorted(made_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    df = Counter(h for _, t in made_rows for h in {xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().lower().split()})
    assert len({h >> 42 for h in df}) == len(df)  # no collisions of 22 bits among these words
    band = {h for h, n in df.items() if 2 <= n <= max(2, 0.2 * len(made_rows))}
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e, a = (brute_fingerprint(x, band) for x in (t, edited, after))
        like = lambda x, y: 1.0 if x == y else 1 - 0.5 ** (sum(x[k : k + 4] == y[k : k + 4] != "0000" for k in range(4, len(x), 4)) / SUBSETS)
        want.append((-1 if i is None else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, like(f, e), like(f, a)))
    source = spark.createDataFrame(made_rows, "doc_id long, text string").withColumn("pid", F.lit(1)).repartition(3)
    got = fingerprints(source).na.fill(-1).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(band) > 20
    assert fingerprints(none).collect() == []
    one = fingerprints(docs.where("doc_id = 304")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len(made()[-1][1])


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT License.\nAll rights reserved."), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."), (5, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.")]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["licences"] for i in range(1, 6)] == ["MIT|Proprietary", "", "", "Apache-2.0", ""]
    assert got[1]["sentence_ids"] == "mit|rights" and got[5]["n_sentences"] == 1 and got[2]["n_sentences"] == 0


def test_licences_in_their_usual_forms(spark):
    lines = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
    holders = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS"
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [
        ("This project is licensed under the MIT License.", "MIT"),
        (lines("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including the rights to use. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", " * "), "MIT"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache-2.0"),
        (bsd + holders, "BSD|BSD-2-Clause"),
        (bsd + "3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + holders, "BSD|BSD-3-Clause"),
        (lines(gnu.format("program", "", "3"), "# "), "GPL-3.0-or-later"),
        (lines(gnu.format("program", "", "2"), "// "), "GPL-2.0-or-later"),
        (gnu.format("library", "Lesser ", "2.1"), "LGPL-2.1-or-later"),
        (gnu.format("program", "Affero ", "3"), "AGPL-3.0-or-later"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "MPL-2.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided", "ISC"),
        ("The text is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("It was licensed under the\n\nMIT license", ""), ("licensed under cc by 4.05", ""), ("", ""),
    ]
    out = scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {cases[r["doc_id"]][0]: r["licences"] for r in out} == dict(cases)
    assert all(re.search("|".join(HINTS), s) and re.fullmatch(ANY, s) for s in KNOWN)
