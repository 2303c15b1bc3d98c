"""Request limits, failed logins, revoked tokens and ingestion, each over streams; where a batch query does the same work on
tables, both share the rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docrecon.operators.declaration import parse_declarations
from docrecon.operators.layout import by_runs


def admit(times: np.ndarray, stamps: np.ndarray, limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the requests at ascending times pass, where stamps are the last ones (limit at most) that passed before; and the last
    ones that passed after these. A request passes if fewer than limit that passed are at most window old.

    The request that passes `limit` after another is the first one later than that and the window. So a block of as many is found by
    one search of the block before, and what is rejected between is never looked at.
    """
    n, ok = len(times), np.zeros(len(times), bool)
    # With fewer before than the limit, the missing ones were long ago.
    block = np.concatenate([np.full(limit - len(stamps), np.iinfo(np.int64).min // 2), stamps])
    at = 0
    while at < n:
        after = np.searchsorted(times, block + window, side="right")
        steps = np.arange(limit)
        places = np.maximum.accumulate(np.maximum(after, at) - steps) + steps
        places = places[places < n]
        ok[places] = True
        block = np.concatenate([block[len(places) :], times[places]])
        if len(places) < limit:
            break
        at = int(places[-1]) + 1
    return ok, block[block > np.iinfo(np.int64).min // 2]


def rate_limit(requests: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """requests (route, ip, id, micros) with accepted. A key's state is at most `limit` stamps."""

    def solve(state, rows: pd.DataFrame) -> tuple:
        return admit(rows["micros"].to_numpy(np.int64), np.empty(0, np.int64) if state is None else state, limit, seconds * 1_000_000)

    return by_runs(requests, ["route", "ip"], ["micros", "id"], solve, "accepted boolean")


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their time (micros, then id) however they arrive: they wait in the state until the watermark has
    passed them, when no earlier one can come any more. A timer wakes a key whose rows wait. What is left of the rows before is a
    list of stamps; solve(times, stamps) -> (values, stamps)."""

    def __init__(self, solve: Callable, columns: list[str], name: str, kept: int):
        self.solve, self.columns, self.name, self.kept = solve, columns, name, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, micros long")
        self.stamps = handle.getListState("stamps", "at long")

    def _passed(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        limit = timers.getCurrentWatermarkInMs() * 1000
        rows = sorted({(int(m), int(i)) for i, m in self.waiting.get()}) if self.waiting.exists() else []
        now, later = [r for r in rows if r[0] < limit], [r for r in rows if r[0] >= limit]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if later:
            self.waiting.put([(i, m) for m, i in later])
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        stamps = np.array([s[0] for s in self.stamps.get()], np.int64) if self.stamps.exists() else np.empty(0, np.int64)
        if now:
            times = np.array([m for m, _ in now], np.int64)
            values, stamps = self.solve(times, stamps)
            yield pd.DataFrame({**{c: [v] * len(now) for c, v in zip(self.columns, key)}, "id": [i for _, i in now], "micros": times, self.name: values})
        stamps = stamps[stamps >= limit - self.kept]
        if len(stamps):
            self.stamps.put([(int(s),) for s in stamps])
            if not later:  # to let them go when they are too old
                self.handle.registerTimer(int(stamps[-1] + self.kept) // 1000 + 1)
        else:
            self.stamps.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            if len(frame):
                self.waiting.appendList(list(zip(frame["id"].astype(int).tolist(), frame["micros"].astype(int).tolist())))
        yield from self._passed(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._passed(key, timerValues)

    def close(self) -> None:
        pass


#: The state store that stateful processors need; set it in the session before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: DataFrame, columns: list[str], solve: Callable, schema: str, late: str, kept: int) -> DataFrame:
    rows.sparkSession.conf.set(*STORE)
    keyed = rows.select(*columns, "id", "micros", F.timestamp_micros("micros").alias("at")).withWatermark("at", late).groupBy(*columns)
    fields = ", ".join(f"{c} string" for c in columns) + f", id long, micros long, {schema}"
    return keyed.transformWithStateInPandas(InOrder(solve, columns, schema.split()[0], kept), fields, "Append", "EventTime")


def rate_limit_stream(requests: DataFrame, limit: int = 10, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """rate_limit over a stream whose requests arrive in any order, `late` behind the latest at most (later ones are dropped): the same
    decisions. A request is decided when the watermark has passed it; stamps that are too old to count go with a timer."""
    window = seconds * 1_000_000
    return _in_order(requests, ["route", "ip"], lambda times, stamps: admit(times, stamps, limit, window), "accepted boolean", late, window)


def recent_failures(times: np.ndarray, stamps: np.ndarray, window: int = 900_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For each time, how many of all times and the stamps before are at most window old, itself and its equals included."""
    every = np.concatenate([stamps, times])
    n = np.searchsorted(every, times, side="right") - np.searchsorted(every, times - window, side="left")
    return n, every


def failed_login_stream(logins: DataFrame, late: str = "20 minutes") -> DataFrame:
    """(email, ip, id, micros, n): for each failed login of logins (id, email, ip, failed, at) how many there were in the 15 minutes to
    it, as failed_login_15m counts them, whatever the order of arrival."""
    rows = logins.where("failed").select(F.coalesce(F.lower(F.trim("email")), F.lit("")).alias("email"), "ip", "id", F.unix_micros("at").alias("micros"))
    return _in_order(rows, ["email", "ip"], recent_failures, "n long", late, 900_000_000)


def failed_logins(logins: DataFrame, failures: int = 5) -> DataFrame:
    """(start, email, ip, n): windows of 15 minutes, one a minute, with at least `failures` failed logins. Also for streams."""
    keyed = logins.where("failed").withWatermark("at", "20 minutes").groupBy(F.window("at", "15 minutes", "1 minute"), F.lower(F.trim("email")).alias("email"), "ip")
    return keyed.agg(F.count("*").alias("n")).where(F.col("n") >= failures).select(F.col("window.start").alias("start"), "email", "ip", "n")


def revoked_tokens(revocations: DataFrame, now) -> DataFrame:
    """(jti, revoked_at, expires_at): the first revocation of each token that hasn't expired."""
    first = revocations.groupBy("jti").agg(F.min_by(F.struct("revoked_at", "expires_at"), F.struct("revoked_at", "expires_at")).alias("f"))
    return first.select("jti", "f.revoked_at", "f.expires_at").where(F.col("expires_at") >= now)


def revocation_stream(revocations: DataFrame, keep: str = "1 day") -> DataFrame:
    """The first revocation of each token; state older than a token's life goes."""
    return revocations.withWatermark("revoked_at", keep).dropDuplicatesWithinWatermark(["jti"])


def declaration_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The rows that new declarations (id, text) give: header (fields, score, quality, flags, reasons), articles, taxes."""
    parsed = parse_declarations(documents.select("id", "text")).drop("text")
    return {
        "header": parsed.drop("articles", "taxes"), "articles": parsed.select("id", F.posexplode("articles").alias("position", "a")).select("id", "position", "a.*"),
        "taxes": parsed.select("id", F.posexplode("taxes").alias("position", "t")).select("id", "position", "t.*"),
    }


def ingest(documents: DataFrame, folder: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]] = declaration_tables):
    """Start a stream of documents (id, text) into the tables that each batch gives. A batch overwrites its own folders only, so one
    that runs again leaves no row twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in tables(batch).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
