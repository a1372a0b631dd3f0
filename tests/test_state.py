"""Streams with keyed state: several batches, a restart from the checkpoint, equal to a plain pass over all rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from graphloom.streaming import state

MESSAGES = "thread long, place long, conv_id long, turn long, role string, text string"


def written(spark, path, rows, schema, parts):
    """The rows in files of ever later ones."""
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def messages():
    r = random.Random(6)
    rows = []
    for i in range(240):
        c = r.randint(0, 2)
        text = r.choice([None, " ", "short", "x" * 900, "  padded \n", "y" * 500 + " tail"])
        rows.append((c, i, c, i, r.choice(["user", "assistant", "system", None]), text))
    return rows


def plain_compaction(rows):
    out, held, seen, done = [], defaultdict(list), defaultdict(int), defaultdict(int)
    for thread, _, _, _, role, text in rows:
        m = held[thread]
        m.append((role, text))
        seen[thread] += 1
        if len(m) >= 24 and sum(len(t or "") for _, t in m) >= 12_000:
            old = m[:-10]
            done[thread] += 1
            lines = [f"{role or 'unknown'}: {t.strip()[:140]}" for role, t in old[-14:] if (t or "").strip()]
            summary = "\n".join(lines) or state.EMPTY
            held[thread] = [("system", "[CompactionSnapshot] " + summary), *m[-10:]]
            out.append((thread, done[thread], seen[thread], len(old), summary))
    return sorted(out)


def plain_pending(rows):
    open_ = {}
    for _, _, conv, turn, role, text in rows:
        if role == "user":
            open_[conv] = (conv, turn, text)
        elif role == "assistant":
            open_.pop(conv, None)
    return sorted(open_.values())


def test_compaction_and_questions_over_batches_and_a_restart(spark, tmp_path):
    rows, path = messages(), str(tmp_path / "messages")
    written(spark, path, rows[:160], MESSAGES, 3)
    bases = [f"file://{tmp_path}/{n}" for n in ("compacted", "pending")]
    runs = [lambda: state.compacted(stream(spark, path, MESSAGES)), lambda: state.pending_changes(stream(spark, path, MESSAGES))]
    first = [state.run_to_end(spark, run, base) for run, base in zip(runs, bases, strict=True)]
    assert sorted(map(tuple, first[0].collect())) == plain_compaction(rows[:160])
    assert sorted(map(tuple, state.latest_pending(first[1]).collect())) == plain_pending(rows[:160])
    written(spark, path, rows[160:], MESSAGES, 2)  # what comes later, by streams that start again
    again = [state.run_to_end(spark, run, base) for run, base in zip(runs, bases, strict=True)]
    want = plain_compaction(rows)
    assert len(want) > len(plain_compaction(rows[:160])) > 1
    assert sorted(map(tuple, again[0].collect())) == want
    assert sorted(map(tuple, state.latest_pending(again[1]).collect())) == plain_pending(rows)
    assert spark.conf.get(state._STORE, None) != state._ROCKS


def test_cache_expires(spark, tmp_path):
    r, start = random.Random(3), datetime(2024, 1, 1)
    at, rows = start, []
    for i in range(200):
        at += timedelta(seconds=r.choice([0, 60, 600, 3599, 3600, 90_000]))
        rows.append((r.randint(1, 3), r.choice("ab"), i, at))
    schema, path = "user_id long, event_type string, event_id long, ts timestamp", str(tmp_path / "events")
    entry, n, want = {}, defaultdict(int), []
    for user, kind, i, ts in rows:
        hit = (user, kind) in entry and ts - entry[user, kind] < timedelta(hours=1)
        if not hit:
            entry[user, kind] = ts
        what = "hit" if hit else "miss"
        n[user, kind, what] += 1
        want.append((user, kind, i, what, n[user, kind, what]))
    base = f"file://{tmp_path}/cache"
    run = lambda: state.cache(stream(spark, path, schema), "1 hour")
    written(spark, path, rows[:120], schema, 3)
    assert sorted(map(tuple, state.run_to_end(spark, run, base).collect())) == sorted(want[:120])
    written(spark, path, rows[120:], schema, 2)
    assert sorted(map(tuple, state.run_to_end(spark, run, base).collect())) == sorted(want)
    assert {"hit", "miss"} == {w[3] for w in want}


def test_digest():
    assert state.digest([]) == state.EMPTY and state.digest([("user", " "), (None, None)]) == state.EMPTY
    assert state.digest([(None, " a "), ("user", "b" * 200)]) == "unknown: a\nuser: " + "b" * 140
