"""Zones, cells and pages of scanned documents, and runs of a key's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.operators.core import latest


def run_starts(batch: pd.DataFrame, key: list[str]) -> np.ndarray:
    """The places in a sorted batch where the rows of another key begin; nulls are a key."""
    fresh = np.zeros(len(batch), bool)
    fresh[0] = True
    for k in key:
        c, before = batch[k], batch[k].shift()
        fresh |= ((c != before) & ~(c.isna() & before.isna())).to_numpy(bool)
    return np.flatnonzero(fresh)


def by_runs(df: DataFrame, key: list[str], order: list[str], solve: Callable, schema: str) -> DataFrame:
    """df, all columns, with a column of the values of solve(state, rows) -> (values, state): rows are those of one key in a batch, in
    order, state is what the key's rows before left, None for the first.

    Rows pass in batches of a sorted partition and only the state is carried over, so a key may hold any number of rows.
    The order must be total, so that a task that runs again gives the same rows.
    """
    name = schema.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            starts = run_starts(batch, key)
            values = []
            for i, j in zip(starts, [*starts[1:], len(batch)]):
                now = tuple(None if pd.isna(x) else x for x in batch[key].iloc[i])
                out, state = solve(state if now == last else None, batch.iloc[i:j])
                last = now
                values.append(out)
            yield batch.assign(**{name: np.concatenate(values)})

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), schema])
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, fields)


def row_numbers(y: np.ndarray, tolerance: float, anchor: float | None = None, row: int = 0) -> tuple[np.ndarray, float, int]:
    """For ascending y, the row of each, the last row's first y and number: a row ends before the next y that is more than tolerance
    beyond its first. One search a row, none a cell."""
    out = np.empty(len(y), np.int64)
    at = 0
    while at < len(y):
        if anchor is None or y[at] > anchor + tolerance:
            anchor, row = y[at], row + 1
        end = max(at + 1, int(np.searchsorted(y, anchor + tolerance, side="right")))
        out[at:end] = row
        at = end
    return out, anchor, row


def rows_of_pages(y: np.ndarray, starts: np.ndarray, tolerance: float, anchor: float | None = None, row: int = 0) -> tuple[np.ndarray, float, int]:
    """As row_numbers, for many pages that begin at `starts`; anchor and row are what rows before left of the first page. All pages
    take a step at once: a binary search for the end of the row that each of them is in. What is no number begins no row but a page's
    first."""
    if anchor is not None and pd.isna(anchor):
        y = y.astype(float)
    ends, at, anchors = np.append(starts[1:], len(y)), starts, y[starts]
    begins = np.zeros(len(y), np.int64)
    begins[starts] = 1
    if anchor is not None and not y[0] > anchor + tolerance:
        begins[0], anchors[0] = 0, anchor
    last = anchors[-1]
    while len(at):
        limit, low, high = anchors + tolerance, at + 1, ends
        # Few pages, such as one that fills the batch, are faster one by one.
        if len(at) < 16:
            low = high = np.array([i + np.searchsorted(y[i:j], most, side="right") for i, j, most in zip(low, high, limit)])
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(y) - 1)
            beyond = (y[middle] > limit) | pd.isna(y[middle]) & ~pd.isna(limit)
            low, high = np.where((low < high) & ~beyond, middle + 1, low), np.where((low < high) & beyond, middle, high)
        more = (low < ends) & (y[np.minimum(low, len(y) - 1)] > limit)
        at, ends = low[more], ends[more]
        begins[at], anchors = 1, y[at]
        if len(ends) and ends[-1] == len(y):
            last = anchors[-1]
    out = np.cumsum(begins)
    # Counted over all pages; each begins anew.
    out -= np.repeat(out[starts] - 1, np.diff(np.append(starts, len(y))))
    if anchor is not None:
        out[: starts[1] if len(starts) > 1 else len(y)] += row - 1 + begins[0]
    return out, last, int(out[-1])


def group_cells(cells: DataFrame, tolerance: int = 14) -> DataFrame:
    """cells (page, id, x, y) with row: a new one begins where y is more than `tolerance` from the row's first cell.

    As by_runs, rows pass in batches of a sorted partition; a batch is grouped as a whole, for pages are many and small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, anchor, row = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            pages = batch["page"]
            now, end = (None if pd.isna(pages.iloc[i]) else pages.iloc[i] for i in (0, -1))
            if last != (now,):
                anchor, row = None, 0
            out, anchor, row = rows_of_pages(batch["y"].to_numpy(), run_starts(batch, ["page"]), tolerance, anchor, row)
            last = (end,)
            yield batch.assign(row=out)

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields), "row long"])
    return cells.repartition("page").sortWithinPartitions("page", "y", "x", "id").mapInPandas(run, fields)


def zone_overlaps(zones: DataFrame, cell: int = 32) -> DataFrame:
    """(page, a, b), each pair of zones (page, id, x1, y1, x2, y2) that strictly overlap, once.

    Zones meet in the cells of a grid; a pair is reported in the one cell that holds the corner where its overlap begins.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    dealt = zones.withColumn("gx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("gy", F.explode(F.sequence(at("y1"), at("y2"))))
    a, b = dealt.alias("a"), dealt.alias("b")
    c = F.col
    meet = (c("a.page") == c("b.page")) & (c("a.gx") == c("b.gx")) & (c("a.gy") == c("b.gy")) & (c("a.id") < c("b.id"))
    over = (c("a.x1") < c("b.x2")) & (c("a.x2") > c("b.x1")) & (c("a.y1") < c("b.y2")) & (c("a.y2") > c("b.y1"))
    here = (F.floor(F.greatest("a.x1", "b.x1") / cell) == c("a.gx")) & (F.floor(F.greatest("a.y1", "b.y1") / cell) == c("a.gy"))
    return a.join(b, meet & over & here).select(c("a.page").alias("page"), c("a.id").alias("a"), c("b.id").alias("b"))


def best_candidates(attempts: DataFrame, key: list[str], order: list[Column], threshold: float = 0.9) -> DataFrame:
    """One attempt (.., valid, confidence) of each key: the first that is valid and sure enough, else the best score."""
    score = F.round(F.when(F.col("valid"), 1.45).otherwise(0.0) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), 4)
    scored = attempts.withColumn("score", score)
    stop = F.col("valid") & (F.col("confidence") >= threshold)
    return latest(scored, key, [stop.desc(), F.when(~stop, F.col("score")).desc_nulls_last(), *order])


def merge_pages(pages: DataFrame, order: list[str]) -> DataFrame:
    """Pages (doc, first_field, last_field, flag, quality, text) as one row for each doc: the first and the last value that is
    not blank, all flags, sum and mean of quality, texts in order."""
    place = F.struct(*order)
    full = lambda c: F.when(F.trim(c) != "", place)
    return pages.groupBy("doc").agg(
        F.min_by("first_field", full("first_field")).alias("first_field"), F.max_by("last_field", full("last_field")).alias("last_field"), F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"),
        F.sum("quality").alias("quality_sum"), (F.sum("quality") / F.count("quality")).alias("quality_mean"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda p: p["text"]), "|").alias("text"))


def batch_outcome(files: DataFrame) -> DataFrame:
    """(batch, n, done, failed, first_error) of files (batch, id, error): a failed file keeps the text of its error and fails no job."""
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("id")))
    return files.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("done"), F.count("error").alias("failed"), first.alias("first_error"))


# Headings of chapters and of numbered sections.
CHAPTER, SECTION = r"^\s*(?:chapitre|chapter)\s+([0-9IVXLC]+)\b[:\s-]*(.*)$", r"^\s*(\d+(?:\.\d+){0,4})\s+(.{3,120})$"


def outline(pages: DataFrame, lines: int = 8) -> DataFrame:
    """(doc_id, n, kind chapter or section, line): the headings among the first non-empty lines of pages (doc_id, text). Null and empty
    texts have none."""
    every = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")
    first = pages.select("doc_id", F.posexplode_outer(F.slice(every, 1, lines)).alias("n", "line"))
    chapter = F.col("line").rlike("(?i)" + CHAPTER)
    section = F.col("line").rlike(SECTION) & ~F.regexp_extract("line", SECTION, 2).rlike("(?i)^(figure|tableau)")
    return first.where(chapter | section).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.when(chapter, "chapter").otherwise("section").alias("kind"), "line")
