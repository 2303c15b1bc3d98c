"""Main text of HTML pages, with boilerplate found by a suffix array over the pages of a host.

Markup says of a block that it is text (in article or main), isn't (in navigation, footers, adverts, forms, notices,
comments) or leaves it undecided. The token streams of all blocks of a host's pages are put one after the other, and runs of
MIN_RUN words or more that MIN_PAGES distinct pages share, within a block, found as neighbours in the suffix array, are
boilerplate. They are cut out of undecided blocks, and those of any length that MIN_PAGES pages have as a whole go too. Of an
article, blocks go that are such a run as a whole, unless runs are much of it: then it is a copy, and the text of its page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import WordHashes, load, mixed, of_stage, saved, whole, windows, word_arrays

#: Words of a run that counts as repeated, and pages that must share it.
MIN_RUN, MIN_PAGES = 20, 3
#: Repeated blocks of an article are cut if one in so many of its words at most is repeated.
COPIED = 3
#: Words of an anchor, by which the runs of a large host are told before they are counted.
ANCHOR = 8
#: Bytes of html of one host that one task looks at together; a larger host is dealt into several such groups.
HOST_BYTES = 8 << 20
#: Hosts of several groups that are broadcast, at most.
FEW_HOSTS = 50_000

PART = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
# Elements and names that the markup of pages uses.
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form menu dialog head button".split())
NAMES = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer menu modal nav navbar navigation newsletter notice pagination popup promo related search share sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo respond".split())
ARTICLE = frozenset(["article", "main"])
#: Elements whose names say something about the page, not about what they hold.
WHOLE = frozenset(["html", "body", "main"])
#: A name that begins so tells of something beside the element; parts that may follow the telling one.
BESIDE = frozenset("has with without no is".split())
AFTER = frozenset("area bar block bottom box container inner item items left link links list outer right section top wrap wrapper".split())
#: Parts that may follow a telling one in the middle of a name.
WITHIN = frozenset("block box form item items link links list placeholder slot unit zone".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
BODY, TEXT, OTHER = 0, 1, 2


@lru_cache(maxsize=1 << 16)
def said(attributes: str) -> tuple[bool, bool]:
    """Whether attributes hint at something beside the text, and whether they hide the element; pages repeat few of them."""
    return telling(attributes), bool(HIDDEN.search(attributes))


def telling(attributes: str) -> bool:
    """Whether a class, id or role is one of NAMES, ends in one (cookie-notice), is one with a common part after it (sidebar-left) or
    has one with a part of something small after it (user-comment-list); page-wide ones such as has-sidebar,
    content-sidebar-wrap or search-page aren't."""
    for value in NAMED.findall(attributes):
        for name in value.strip("\"'").lower().split():
            parts = [p for p in SPLIT.split(name) if p]
            if not parts or parts[0] in BESIDE:
                continue
            if parts[-1] in NAMES or parts[0] in NAMES and all(p in AFTER or p.isdigit() for p in parts[1:]):
                return True
            last = max((i for i, p in enumerate(parts) if p in NAMES), default=len(parts))
            if last < len(parts) and all(p in WITHIN or p.isdigit() for p in parts[last + 1 :]):
                return True
    return False


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(TEXT, OTHER or BODY for undecided; text of the block), in page order, without empty ones.

    A form or a name only hints: an article or main within is text after all, if no article of the page has fewer hints around
    it (so comments and teasers that are articles stay out). Within navigation, footers and the like it isn't.
    """
    out: list[tuple[int, str, int]] = []
    if not page:
        return out
    held: list[str] = []
    # Element, state, hints around it, whether more than hints say OTHER.
    stack: list[tuple[str, int, int, bool]] = []
    top = ("", BODY, 0, False)

    def state() -> int:
        return (stack[-1] if stack else top)[1]

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((state(), text, stack[-1][2] if stack else 0))

    at, n = 0, len(page)
    while at < n:
        m = PART.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at, closing, tag, attributes = m.end(), m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "body" and not any(x[0] == "body" for x in stack):
            stack.clear()  # the end tag of head may be left out
        _, now, hints, firm = stack[-1] if stack else top
        beside, hidden = said(attributes) if attributes else (False, False)
        hint = tag == "form" or tag not in WHOLE and beside
        hints += hint
        if tag in CHROME and tag != "form" or tag == "header" and now != TEXT or hidden:
            now, firm = OTHER, True
        elif tag in ARTICLE and not firm:
            now = TEXT
        elif hint:
            now = OTHER
        if tag in INLINE:
            if now != state() and held:
                flush()
            if now == state():
                continue
        stack.append((tag, now, hints, firm))
    flush()
    least = min((h for kind, _, h in out if kind == TEXT), default=0)
    return [(OTHER if kind == TEXT and h > least else kind, text) for kind, text, h in out]


def squeezed(blocks: list[str]) -> bytes:
    """Blocks as they are shuffled and saved; they hold no line ends."""
    return zstandard.compress("\n".join(blocks).encode("utf-8", "surrogatepass"), 3) if blocks else b""


def unsqueezed(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode("utf-8", "surrogatepass").split("\n") if data else []


def shared_runs(tokens: np.ndarray, page: np.ndarray, run: int = MIN_RUN, pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens are in a run of `run` or more tokens that `pages` pages or more share. A token of -1 ends a block.

    A longer run is covered by its parts of `run` tokens, which the same pages share, so suffixes that differ only later
    needn't be told apart.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < run:
        return covered
    # Suffixes by their first 1, 2, 4 ... `run` tokens; a rank is the first place of equal ones in the suffix array, and only
    # those that are still equal to another are sorted further. Ends of blocks equal nothing.
    tied, rank = np.arange(n), np.zeros(n, np.int64)
    second = tokens.astype(np.int64)
    second[tokens == -1] = second.max() + 1 + np.arange(np.count_nonzero(tokens == -1))
    length = 0
    while length < run and len(tied):
        step = min(length, run - length)
        if length:
            second = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        order = np.lexsort((second, rank[tied]))
        tied, second, at = tied[order], second[order], np.arange(len(tied))
        old = rank[tied]
        group = np.diff(old, prepend=-1) != 0
        new = group | (np.diff(second, prepend=second[0] - 1) != 0)
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        length += step or 1
    if not len(tied):
        return covered
    suffixes = tied[np.lexsort((page[tied], rank[tied]))]
    new_rank = np.diff(rank[suffixes], prepend=-1) != 0
    new_page = new_rank | (np.diff(page[suffixes], prepend=-1) != 0)
    group = np.cumsum(new_rank) - 1
    return spread(suffixes[np.bincount(group, weights=new_page)[group] >= pages], n, run)


def spread(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n tokens are in a run that starts at one of the places."""
    delta = np.zeros(n + run + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + run, -1)
    return np.cumsum(delta)[:n] > 0


def cut(blocks: list[tuple[int, str]], covered: np.ndarray, repeated: list[bool]) -> str:
    """The text of a page. covered: for the words of all its blocks, one after the other, whether a long run that other pages
    share holds them. repeated: whether other pages have the block as a whole."""
    at, places = 0, []
    for _, text in blocks:
        places.append((at, at := at + text.count(" ") + 1))
    article = [covered[i:j] for (i, j), (kind, _) in zip(places, blocks) if kind == TEXT]
    # A page of which repeats would leave nothing is a copy (a print version, a mirror), and keeps its undecided blocks.
    undecided = [(covered[i:j].all() or whole_block) for (i, j), (kind, _), whole_block in zip(places, blocks, repeated) if kind == BODY]
    mirror = bool(undecided) and all(undecided) and not article
    # An article that copies another shares much of it; that is the page's text all the same.
    copied = sum(int(x.sum()) for x in article) * COPIED > sum(map(len, article))
    kept = []
    for (i, j), (kind, text), whole_block in zip(places, blocks, repeated):
        if kind == BODY and mirror:
            kept.append(text)
            continue
        if kind == OTHER or whole_block and kind == BODY or whole_block and covered[i:j].all() and not copied:
            continue
        if kind == BODY and covered[i:j].any():
            text = " ".join(w for w, c in zip(text.split(" "), covered[i:j]) if not c)
        if text:
            kept.append(text)
    return "\n".join(kept)


def main_texts(pages: list[list[tuple[int, str]]], run: int = MIN_RUN, least: int = MIN_PAGES, ids: list | None = None) -> list[str]:
    """The texts of a host's pages, given as blocks. ids: rows that repeat one are one page; such without an id are pages of their own."""
    number: dict = {}
    page = [number.setdefault(("row", p) if ids is None or ids[p] is None or ids[p] != ids[p] else ids[p], len(number)) for p in range(len(pages))]
    words: dict[str, int] = defaultdict()
    words.default_factory = words.__len__
    stream, owner = [], []
    having = Counter(text for _, text in {(page[p], t) for p, blocks in enumerate(pages) for _, t in blocks})
    for p, blocks in enumerate(pages):
        for _, text in blocks:
            stream.extend(map(words.__getitem__, text.split(" ")))
            stream.append(-1)
        owner += [p] * (len(stream) - len(owner))
    tokens, owners = np.array(stream, np.int64), np.array(owner, np.int64)
    covered = shared_runs(tokens, np.array(page, np.int64)[owners] if len(owners) else owners, run, least)[tokens != -1]
    ends = np.searchsorted(owners[tokens != -1], np.arange(len(pages) + 1))
    return [cut(b, covered[ends[p] : ends[p + 1]], [having[t] >= least for _, t in b]) for p, b in enumerate(pages)]


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x, width = np.minimum(x[:-step], x[step:]), width + step
    return x


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Page:
    """A page of a large host by hashes that are the host's own: of its blocks; of each MIN_RUN words within a block, 0 for other
    places; and anchors, for each such run the least hash of ANCHOR words in it, so equal runs have equal ones."""

    def __init__(self, blocks: list[str], host: int, hashes: WordHashes):
        self.seed = mixed(np.uint64([host & (2**64 - 1)]))[0]
        self.words, starts = word_arrays(blocks, hashes)
        self.blocks = mixed(np.array([xxhash.xxh3_64_intdigest(t.encode()) for t in blocks], np.uint64) ^ self.seed)
        self.within = whole(starts, MIN_RUN)[1]

    def placed(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words), np.uint64)
        out[: len(hashes)] = mixed(hashes ^ self.seed) | np.uint64(1)
        out[~self.within] = 0
        return out

    def runs(self) -> np.ndarray:
        return self.placed(windows(self.words, MIN_RUN))

    def anchors(self) -> np.ndarray:
        return self.placed(least(windows(self.words, ANCHOR, 1), MIN_RUN - ANCHOR + 1) if len(self.words) >= MIN_RUN else np.empty(0, np.uint64))


def extract_text(pages: DataFrame, host_bytes: int = HOST_BYTES) -> DataFrame:
    """(page_id, url, text string, n_chars long), one row for each row of pages (page_id, url, html).

    Null or empty html gives an empty text. A page whose url names no host is a host of its own. Rows that repeat a page_id count
    as one page and have a text each; pages without page_id count one by one. A host with more than host_bytes of html is dealt
    into groups of about that size by a hash of page_id and html, so no group grows with the corpus, and its repeats are
    counted over the whole host: blocks and runs by 64-bit hashes, runs in two steps. First pages count for the anchors of
    their runs, an eighth of the words or so; then for the runs whose anchor enough pages have. The groups get back what
    enough pages share. So the result doesn't depend on the groups.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    alone = F.concat(F.lit("#"), F.xxhash64("page_id", "url", "html").cast("string"))
    rows = pages.select("page_id", "url", "html").withColumn("host", F.when(host != "", host).otherwise(alone))
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 100) / host_bytes).alias("groups"))
    kind, url = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()
    result = f"page_id {kind}, url {url}, text string, n_chars long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("html")
            found = [blocks_of(x) for x in batch.column("html").to_pylist()]
            kinds, texts = [[k for k, _ in x] for x in found], [squeezed([t for _, t in x]) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(kinds, pa.list_(pa.int32())), pa.array(texts, pa.binary())], [*(x for x in batch.schema.names if x != "html"), "kinds", "blocks"])

    def texts_of(x: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    def group(x: pd.DataFrame) -> pd.DataFrame:
        return texts_of(x, main_texts([list(zip(k, unsqueezed(b))) for k, b in zip(x["kinds"], x["blocks"])], ids=[None if pd.isna(i) else i for i in x["page_id"]]))

    # Only hosts of several groups need their number; they are broadcast if they are few.
    large = saved(sizes.where("groups > 1"))
    n_large = large.count()
    hosts = F.broadcast(large) if n_large <= FEW_HOSTS else large.hint("merge")
    small = rows if not n_large else rows.join(hosts, "host", "left_anti")
    small = small.select("page_id", "url", "html", "host").mapInArrow(parse, f"page_id {kind}, url {url}, host string, kinds array<int>, blocks binary")
    out = small.groupBy("host").applyInPandas(group, result)
    if not n_large:
        return out

    # The seed of a host keeps its hashes apart from other hosts'; a group is a host's rows with one remainder.
    seed, part = F.xxhash64("host"), F.pmod(F.xxhash64("page_id", "html"), F.col("groups"))
    dealt = rows.join(hosts, "host")
    # Of rows that repeat a page_id one counts. They are few, if there are any; only they are sorted.
    again = dealt.where("page_id is not null").groupBy("host", "page_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if again.take(1):
        first = Window.partitionBy("host", "page_id").orderBy("html", "url")
        both = dealt.join(again, ["host", "page_id"]).withColumn("counts", F.row_number().over(first) == 1).select(*dealt.columns, "counts")
        dealt = dealt.join(again, ["host", "page_id"], "left_anti").withColumn("counts", F.lit(True)).select(*dealt.columns, "counts").union(both)
    else:
        dealt = dealt.withColumn("counts", F.lit(True))
    dealt = dealt.select("page_id", "url", "html", "counts", seed.alias("seed"), F.xxhash64("host", part).alias("part"))
    # Three steps read the blocks; they are parsed once.
    dealt = saved(dealt.mapInArrow(parse, f"page_id {kind}, url {url}, counts boolean, seed long, part long, kinds array<int>, blocks binary"))
    counts = "part long, of_block boolean, key long, n int"

    def counted(found: Counter, part: int, of_block: bool) -> dict:
        return {"part": [part] * len(found), "of_block": [of_block] * len(found), "key": list(found.keys()), "n": list(found.values())}

    def counted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_stage("words", WordHashes)
        for batch in batches:
            found: dict = {}
            for g, s, once, blocks in zip(*(batch.column(c).to_pylist() for c in ("part", "seed", "counts", "blocks"))):
                page = Page(unsqueezed(blocks), s, hashes)
                anchors = page.anchors()
                for of_block, keys in ((True, page.blocks), (False, anchors[anchors != 0])):
                    found.setdefault((g, of_block), Counter()).update(dict.fromkeys(np.unique(keys).view(np.int64).tolist(), int(once)))
            for (g, of_block), keys in found.items():
                columns = counted(keys, g, of_block)
                yield pa.RecordBatch.from_arrays([pa.array(columns["part"], pa.int64()), pa.array(columns["of_block"], pa.bool_()), pa.array(columns["key"], pa.int64()), pa.array(columns["n"], pa.int32())], ["part", "of_block", "key", "n"])

    def shared(found: DataFrame) -> DataFrame:
        """(part, of_block, key): for each group what it has and MIN_PAGES pages of its host have. A key has as many rows as its host
        has groups at most."""
        enough = found.groupBy("of_block", "key").agg(F.sum("n").alias("n"), F.collect_set("part").alias("parts")).where(F.col("n") >= MIN_PAGES)
        return saved(enough.select(F.explode("parts").alias("part"), "of_block", "key"))

    def keys_of(y: pd.DataFrame, of_block: bool) -> np.ndarray:
        return np.sort(y.loc[y["of_block"] == of_block, "key"].to_numpy(np.int64).view(np.uint64))

    def second(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        hashes, wanted, found = of_stage("words", WordHashes), keys_of(y, False), []
        if len(x) and len(wanted):
            for s, once, blocks in zip(x["seed"], x["counts"], x["blocks"]):
                page = Page(unsqueezed(blocks), s, hashes)
                likely = among(page.anchors(), wanted)
                if likely.any():
                    runs = np.unique(page.runs()[likely])
                    found.append((runs, np.full(len(runs), int(once))))
        keys, back = np.unique(np.concatenate([r for r, _ in found]) if found else np.empty(0, np.uint64), return_inverse=True)
        n = np.bincount(back, np.concatenate([w for _, w in found]), len(keys)) if found else np.empty(0)
        return pd.DataFrame({"part": np.full(len(keys), x["part"].iloc[0] if len(x) else 0), "of_block": np.zeros(len(keys), bool), "key": keys.view(np.int64), "n": n.astype(np.int32)})

    def last(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        hashes, runs_shared, blocks_shared, texts = of_stage("words", WordHashes), keys_of(y, False), keys_of(y, True), []
        for s, kinds, blocks in zip(x["seed"], x["kinds"], x["blocks"]):
            blocks = unsqueezed(blocks)
            page = Page(blocks, s, hashes)
            at = np.flatnonzero(among(page.runs(), runs_shared)) if len(runs_shared) else np.empty(0, np.int64)
            texts.append(cut(list(zip(kinds, blocks)), spread(at, len(page.words), MIN_RUN), among(page.blocks, blocks_shared).tolist()))
        return texts_of(x, texts)

    anchors = shared(dealt.select("seed", "part", "counts", "blocks").mapInArrow(counted_keys, counts))
    runs = shared(dealt.select("seed", "part", "counts", "blocks").groupBy("part").cogroup(anchors.where("not of_block").groupBy("part")).applyInPandas(second, counts))
    known = runs.union(anchors.where("of_block"))
    return out.union(dealt.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(last, result))


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))
