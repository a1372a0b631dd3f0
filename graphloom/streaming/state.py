"""Keyed state on streams: a cache whose entries expire, pending questions, and compaction of long threads.

Each is a ``StatefulProcessor``: Spark keeps a key's values, lists and maps in
its state store, with the offsets, so a stream goes on from its checkpoint.
Rows of a key are taken in order within a batch; batches come in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.lineage import work_dir

#: Seconds that a cache entry lives; messages and characters from which a thread is compacted, messages that stay, messages and characters of its digest (fixed values).
TTL, MESSAGES, CHARS, RECENT, DIGEST, LINE = 3600, 24, 12_000, 10, 14, 140
EMPTY = "压缩段无可用文本摘要。"
SNAPSHOT = "[CompactionSnapshot] "
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ends(at: pd.Timestamp) -> int:
    """When an entry ends, in ms."""
    return int(at.timestamp() * 1000) + TTL * 1000


class ExpiringCache(StatefulProcessor):
    """A look-up an event: a hit while its key's entry is younger than ``TTL``; otherwise the entry is set anew.

    An entry's event-time timer removes it once the watermark has passed its
    end, so keys that are asked no more keep no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at timestamp")
        self.stats = handle.getMapState("stats", "what string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """State is read and written once a key and batch: each access is a call to the store, which rows are too many for."""
        was = pd.Timestamp(self.entry.get()[0]) if self.entry.exists() else None
        stats = {k: v for (k,), (v,) in self.stats.iterator()}
        held, before, out = was, dict(stats), []
        table = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for user, kind, event, ts in zip(*(table[c].tolist() for c in ("user_id", "event_type", "event_id", "ts")), strict=True):
            hit = held is not None and ts - held < timedelta(seconds=TTL)
            if not hit:
                held = ts
            what = "hit" if hit else "miss"
            stats[what] = stats.get(what, 0) + 1
            out.append((user, kind, event, what, stats[what]))
        if held != was:
            if was is not None:
                self.handle.deleteTimer(_ends(was))
            self.entry.update((held.to_pydatetime(),))
            self.handle.registerTimer(_ends(held))
        for what, n in stats.items():
            if n != before.get(what):
                self.stats.updateValue((what,), (n,))
        yield pd.DataFrame(out, columns=["user_id", "event_type", "event_id", "outcome", "n"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and pd.Timestamp(self.entry.get()[0]).timestamp() * 1000 + TTL * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


class PendingQuestions(StatefulProcessor):
    """The latest question of a conversation until an answer closes it; a row for each change, numbered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "turn long, text string")
        self.changes = handle.getValueState("changes", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out, n = [], self.changes.get()[0] if self.changes.exists() else 0
        for r in pd.concat(list(rows)).sort_values("turn").itertuples():
            if r.role == "user":
                self.pending.update((int(r.turn), r.text))
            elif r.role == "assistant" and self.pending.exists():
                self.pending.clear()
            else:
                continue
            n += 1
            out.append((r.conv_id, n, "pending" if r.role == "user" else "answered", int(r.turn), r.text))
        if out:
            self.changes.update((n,))
        yield pd.DataFrame(out, columns=["conv_id", "n", "status", "turn", "text"])

    def close(self) -> None:
        pass


def digest(messages: list[tuple[str, str]]) -> str:
    """The last messages (role, text), a line each."""
    lines = [f"{(role or '').strip() or 'unknown'}: {text.strip()[:LINE]}" for role, text in messages[-DIGEST:] if text and text.strip()]
    return "\n".join(lines) or EMPTY


class Compaction(StatefulProcessor):
    """A thread's messages; when they are many and long, all but the recent ones give way to a snapshot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "role string, text string")
        self.seen = handle.getValueState("seen", "messages long, snapshots long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in self.messages.get()]
        seen, done = self.seen.get() if self.seen.exists() else (0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("place").itertuples():
            held.append((r.role, r.text))
            seen += 1
            if len(held) >= MESSAGES and sum(len(t or "") for _, t in held) >= CHARS and len(held) > RECENT + 1:
                old, held = held[:-RECENT], held[-RECENT:]
                done += 1
                summary = digest(old)
                held.insert(0, ("system", SNAPSHOT + summary))
                out.append((key[0], done, seen, len(old), summary))
        self.messages.put([(a, b) for a, b in held])
        self.seen.update((int(seen), int(done)))
        yield pd.DataFrame(out, columns=["thread", "snapshot", "message", "compressed", "summary"])

    def close(self) -> None:
        pass


def cache(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, event_type, event_id, outcome, n) of a stream of look-ups; ``n`` counts the key's outcomes of that kind."""
    keyed = events.select("user_id", "event_type", "event_id", "ts").withWatermark("ts", late).groupBy("user_id", "event_type")
    return keyed.transformWithStateInPandas(ExpiringCache(), "user_id long, event_type string, event_id long, outcome string, n long", "Append", "EventTime")


def pending_changes(messages: DataFrame) -> DataFrame:
    """(conv_id, n, status, turn, text) of a stream of messages (conv_id, turn, role, text)."""
    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(PendingQuestions(), "conv_id long, n long, status string, turn long, text string", "Append", "None")


def latest_pending(changes: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of the questions that no answer has closed."""
    last = changes.groupBy("conv_id").agg(F.max_by(F.struct("status", "turn", "text"), "n").alias("x"))
    return last.where("x.status = 'pending'").select("conv_id", "x.turn", "x.text")


def compacted(messages: DataFrame) -> DataFrame:
    """(thread, snapshot, message, compressed, summary) of a stream of messages (thread, place, role, text)."""
    return messages.select("thread", "place", "role", "text").groupBy("thread").transformWithStateInPandas(Compaction(), "thread long, snapshot long, message long, compressed long, summary string", "Append", "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed lists, maps and timers need, for the streams that start within."""
    was = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, was) if was else spark.conf.unset(_STORE)


def run_to_end(spark: SparkSession, stream: Callable[[], DataFrame], base: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote; with the same ``base`` it goes on from its checkpoint."""
    base = base or f"{work_dir(spark)}/graphloom-streams/{uuid.uuid4().hex}"
    with state_store(spark):
        df = stream()
        df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
