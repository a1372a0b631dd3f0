"""Queries that run as streams over the events, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.book import Tables, query
from graphloom.sources.bindings import with_
from graphloom.streaming import flows, state


def _events(t):
    return flows.event_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("st_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_tumbling(t):
    return flows.drained(flows.tumbling(_events(t), "1 day"), "complete")


@query("st_sliding", "WITH s AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) SELECT start, count(*) AS n FROM s GROUP BY start")
def st_sliding(t):
    return flows.drained(flows.sliding(_events(t), "2 days", "1 day"), "complete")


@query("st_sessions", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def st_sessions(t):
    return flows.drained(flows.sessions(_events(t), "2 hours"), "complete")


@query("st_append_log", with_("log") + "SELECT key, seq, event_id FROM log")
def st_append_log(t):
    return flows.drained(flows.numbered(_events(t)))


@query("sink_sse", with_("log") + "SELECT 'id: ' || seq || chr(10) || 'event: ' || type || chr(10) || 'data: ' || '{\"key\":' || key || ',\"event_id\":' || event_id || '}' || chr(10) || chr(10) AS frame FROM log")
def sink_sse(t):
    from graphloom.sources import bindings as B

    return flows.server_sent(B.event_log(t.events).select("key", "seq", "event_id", "type"))


@query("st_state_progress", "SELECT user_id, count(*) AS done, round(count(*) * 100.0 / (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)), 4)::DOUBLE AS pct FROM events GROUP BY user_id")
def st_state_progress(t):
    n = t.events.groupBy("user_id").agg(F.count("*").alias("done"))
    top = F.broadcast(n.agg(F.max("done").alias("m")))
    return n.join(top).select("user_id", "done", F.round(F.col("done") * 100.0 / F.col("m"), 4).alias("pct"))


def _messages(t: Tables) -> DataFrame:
    """The conversations as a stream."""
    return flows.table_stream(t.spark, f"{t.sf_dir}/conversations.parquet")


@query("st_pending_question", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn > c.turn) GROUP BY conv_id")
def st_pending_question(t):
    """Questions that no answer has closed, from a stream of messages with keyed state."""
    return state.latest_pending(state.run_to_end(t.spark, lambda: state.pending_changes(_messages(t))))


@query("st_ttl_cache", "WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events), after AS (SELECT a.user_id, a.event_type, a.i, min(b.i) AS next FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts >= a.ts + INTERVAL 3600 SECOND GROUP BY ALL), miss(user_id, event_type, i) AS (SELECT user_id, event_type, 1::BIGINT FROM e WHERE i = 1 UNION ALL SELECT m.user_id, m.event_type, a.next FROM miss m JOIN after a USING (user_id, event_type, i)) SELECT user_id, event_type, event_id, CASE WHEN m.i IS NULL THEN 'hit' ELSE 'miss' END AS outcome, count(*) OVER (PARTITION BY user_id, event_type, m.i IS NULL ORDER BY e.i) AS n FROM e LEFT JOIN miss m USING (user_id, event_type, i)")
def st_ttl_cache(t):
    """Hits and misses of a cache whose entries live an hour, from a stream of events with keyed state and timers."""
    return state.run_to_end(t.spark, lambda: state.cache(flows.event_stream(t.spark, f"{t.sf_dir}/events.parquet")))


_COMPACT = f"""WITH RECURSIVE m AS (SELECT conv_id // 10 AS thread, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) AS i, role, text FROM conversations),
r(thread, i, held, done, old) AS (
  SELECT DISTINCT thread, 0::BIGINT, []::STRUCT(role VARCHAR, text VARCHAR)[], 0::BIGINT, NULL::STRUCT(role VARCHAR, text VARCHAR)[] FROM m
  UNION ALL
  SELECT thread, i, CASE WHEN c THEN list_prepend({{'role': 'system', 'text': '{state.SNAPSHOT}' || digest}}, held[len(held) - {state.RECENT - 1}:]) ELSE held END, done + c::INT, CASE WHEN c THEN held[:len(held) - {state.RECENT}] END
  FROM (SELECT *, array_to_string(list_transform(list_filter(held[greatest(1, len(held) - {state.RECENT + state.DIGEST - 1}):len(held) - {state.RECENT}], lambda x: trim(x.text, E' \n\r\t') <> ''), lambda x: x.role || ': ' || substr(trim(x.text, E' \n\r\t'), 1, {state.LINE})), chr(10)) AS digest
    FROM (SELECT *, len(held) >= {state.MESSAGES} AND list_sum(list_transform(held, lambda x: length(x.text))) >= {state.CHARS} AS c FROM (SELECT r.thread, r.i + 1 AS i, list_append(held, {{'role': m.role, 'text': m.text}}) AS held, done FROM r JOIN m ON m.thread = r.thread AND m.i = r.i + 1))))
SELECT thread, done AS snapshot, i AS message, len(old)::BIGINT AS compressed, array_to_string(list_transform(list_filter(old[greatest(1, len(old) - {state.DIGEST - 1}):], lambda x: trim(x.text, E' \n\r\t') <> ''), lambda x: x.role || ': ' || substr(trim(x.text, E' \n\r\t'), 1, {state.LINE})), chr(10)) AS summary FROM r WHERE old IS NOT NULL"""


@query("st_compaction", _COMPACT)
def st_compaction(t):
    """Snapshots of long threads (ten neighbouring conversations each), from a stream of messages with keyed state."""
    m = _messages(t)
    return state.run_to_end(t.spark, lambda: state.compacted(m.select(F.floor(F.col("conv_id") / 10).alias("thread"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("place"), "role", "text")))
