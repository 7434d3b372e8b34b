"""Streaming forms give what the batch forms give, however their input is cut and ordered, and keep nothing at the end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import governor, history, render, replies
from tidewell.plans.live import LAST
from tidewell.streaming import live, ordered, stateful
from tidewell.streaming import replies as assembly
from tidewell.streaming.ordered import fold_rows, kept_states, run_to_end


def run(stream, name, spark, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


LOG = "engine string, ts long, ordinal long, kind string, status int, retry_after long"


def engine_rows():
    return [(f"e{i % 2}", 1000 * (i + 1) * 900, i, ["ok", "upstream", "challenge", "timeout"][i % 4 if i % 7 else 0], 503 if i % 4 == 1 else None, None) for i in range(40)]


def test_suspensions(spark, tmp_path):
    """Rows in any order, in two runs on one checkpoint."""
    rows = engine_rows()
    random.Random(1).shuffle(rows)
    slices = [[r for r in rows if r[1] < 18_000_000], [*[r for r in rows if r[1] >= 18_000_000], ("end", 10**13, 0, "ok", None, None)]]
    out = run_to_end([spark.createDataFrame(x, LOG).repartition(2) for x in slices], live.live_suspensions, f"file://{tmp_path}/s").where("engine <> 'end'").collect()
    got = {r.ordinal: (r.until, r.reason) for r in out if r.decision == "ran"}
    assert got == {r.ordinal: (r.until, r.reason) for r in governor.suspensions(spark.createDataFrame(rows, LOG)).collect()}
    over = {(r.engine, r.ts) for r in out if r.decision == "over"}
    assert over and all(r.ts == r.until for r in out if r.decision == "over")


def test_suspended_requests_change_nothing():
    fold, rows = live.SuspensionFold(True), [(t * 1_000_000, 0, i, json.dumps({"kind": k, "status": s})) for i, (t, k, s) in enumerate([(0, "upstream", 503), (10, "ok", None), (20, "challenge", None), (30, "challenge", None), (31, "ok", None)])]
    state = fold.start()
    found = fold_rows(fold, state, rows, 40_000_000)
    assert [(a // 1_000_000, x["decision"], x["until"]) for a, _, x in found] == [(0, "ran", 30_000), (10, "suspended", 30_000), (20, "suspended", 30_000), (30, "over", 30_000), (30, "ran", 3_630_000), (31, "suspended", 3_630_000)]
    assert fold.wake(state) == 3_630_000_000


@pytest.mark.parametrize("seed", range(3))
def test_folds_do_not_depend_on_cuts(seed):
    r = random.Random(seed)
    rows = sorted((r.randrange(0, 60) * 60_000_000, r.randrange(2), i, json.dumps({"store": r.random() < 0.4, "short": r.random() < 0.5})) for i in range(80))
    rows = [(a, 0 if json.loads(x)["store"] else 1, s, x) for a, _, s, x in rows]
    rows.sort()
    fold = live.CacheFold(600_000_000, 1_500_000_000)
    whole, state, cut = fold_rows(fold, {}, rows, 10**12), {}, []
    for k in range(0, 60, 7):
        part = [x for x in rows if k * 60_000_000 <= x[0] < (k + 7) * 60_000_000]
        cut += fold_rows(fold, state, part, (k + 7) * 60_000_000 - 1)
    cut += fold_rows(fold, state, [], 10**12)
    assert cut == whole and state == {}
    stores = [(a, s, json.loads(x)["short"]) for a, _, s, x in rows if json.loads(x)["store"]]
    for at, seq, out in whole:
        last = max((x for x in stores if x[0] <= at), default=None)
        fresh = last is not None and at - last[0] <= (600_000_000 if last[2] else 1_500_000_000)
        assert out["store"] == (last[1] if fresh else None), seq


def test_progress(spark, tmp_path):
    """Lines as in the batch form, the end of a reply from its last attempt only, and no state once all sessions have ended."""
    data = lambda **x: json.dumps(x)
    events = [
        ("turn.started", data(final_turn=False)), ("model.delta", data(attempt=1, channel="text", text="lost ")), ("model.retry", data(attempt=1, delay_ms=800, reason="busy")),
        ("model.delta", data(attempt=2, channel="thinking", text="hm")), ("model.delta", data(attempt=2, channel="text", text="kept\n")), ("model.delta", data(attempt=2, channel="text", text="x" * 300)), ("model.replied", data(usage={"completion_tokens": 5})),
        ("answer.verified", data(bullets=3, cited=2, exact=2)), ("session.finished", data(outcome="ok", turns_used=1, turn_budget=4)),
    ]
    rows = [(s, seq, kind, d) for s in ("a", "b") for seq, (kind, d) in enumerate(events)]
    frame = spark.createDataFrame(rows, "session_id string, seq long, type string, data string")
    want = {(r.session_id, r.seq): (r.line, r.tone, r.status) for r in render.progress(frame).collect()}
    timed = frame.withColumn("at", F.timestamp_seconds(F.col("seq") * 60 + 60))
    end = spark.createDataFrame([("end", 0, "beat", "{}")], frame.schema).withColumn("at", F.lit(LAST).cast("timestamp"))
    slices = [timed.where("seq % 3 = 1"), timed.where("seq % 3 <> 1").unionByName(end)]
    folder = f"file://{tmp_path}/p"
    got = run_to_end(slices, lambda s: live.live_progress(s, "1 hour"), folder).where("session_id <> 'end'").collect()
    assert {(r.session_id, r.seq): (r.line, r.tone, r.status) for r in got} == want and len(got) == len(want)
    tails = {r.seq: (r.tail, r.chars) for r in got if r.session_id == "a"}
    assert tails[1] == ("lost ", 5) and tails[2] == ("", 0) and tails[3] == ("", 0) and tails[4] == ("kept ", 5) and tails[5] == (("kept " + "x" * 300)[-live.TAIL :], 305) and tails[6] == ("", 0)
    assert kept_states(spark, folder).where("key IN ('a', 'b')").count() == 0


def bodies(wire):
    js = json.dumps
    if wire == "openai":
        chat = lambda **d: js({"choices": [{"delta": d}]})
        call = lambda i, **f: chat(tool_calls=[{"index": i, "function": f, **({"id": f"c{i}"} if "name" in f else {})}])
        a = [chat(content="Grüße "), chat(reasoning_content="hm"), call(1, name="fetch", arguments='{"u'), call(0, name="search", arguments=""), call(1, arguments='rl"}'), chat(content="東京"), "not json", js({"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3}}), js({"choices": [], "usage": {"prompt_tokens": 4, "total_tokens": 9}}), "[DONE]"]
        b = [chat(refusal="no"), chat(refusal=" way"), js({"error": {"message": "broken"}})]
    else:
        block = lambda i, **c: js({"type": "content_block_start", "index": i, "content_block": c})
        delta = lambda i, **d: js({"type": "content_block_delta", "index": i, "delta": d})
        a = [js({"type": "message_start", "message": {"usage": {"input_tokens": 7, "output_tokens": 1}}}), block(0, type="thinking"), delta(0, thinking="hm"), block(1, type="text", text="Grüße "), delta(1, text="東京"), block(2, type="tool_use", id="t", name="search"), delta(2, partial_json='{"q"'), delta(2, partial_json=":1}"), js({"type": "message_delta", "delta": {"stop_reason": "tool_use"}, "usage": {"input_tokens": 0, "output_tokens": 12}}), js({"type": "message_stop"})]
        b = [block(0, type="text"), delta(0, text="cut"), js({"type": "error", "error": {"message": "overloaded"}})]
    frame = lambda events: b": hi\r\n\r\n" + b"".join(f"event: x\r\ndata: {e}\r\n\r\n".encode() for e in events)
    return {"a": frame(a), "b": frame(b), "c": b": nothing\n\n"}


@pytest.mark.parametrize("wire", ["openai", "anthropic"])
def test_replies(spark, tmp_path, wire):
    """Chunks of 1, 5 and 1000 bytes, in any order over three runs and some twice; cut replies come when nothing has come for long."""
    r = random.Random(7)
    chunks = [(f"{name}{width}", i, bytearray(body[a : a + width])) for name, body in bodies(wire).items() for width in (1, 5, 1000) for i, a in enumerate(range(0, len(body), width))]
    schema = "stream_id string, chunk_seq long, chunk binary"
    frame = spark.createDataFrame(chunks, schema)
    events = replies.joined_stream(frame).select("stream_id", F.posexplode(replies.sse_events(F.col("body"))).alias("seq", "data"))
    batch = (replies.openai_replies if wire == "openai" else replies.anthropic_replies)(events)
    slots = [[], [], []]
    for c in chunks:
        slots[r.randrange(3)].append(c)
    slots[2] += r.sample(chunks, 60)
    slices = [spark.createDataFrame(x, schema).withColumn("at", F.timestamp_seconds(F.lit(1000 + 60 * k))) for k, x in enumerate(slots)]
    end = spark.createDataFrame([("end", 0, bytearray())], schema).withColumn("at", F.lit(LAST).cast("timestamp"))
    folder = f"file://{tmp_path}/r"
    got = run_to_end([*slices, end], lambda s: assembly.live_replies(s, wire), folder).where("stream_id <> 'end'").collect()
    columns = [c for c in batch.columns if c in got[0].asDict()]
    assert {"output", "thinking", "tool_calls", "usage", "cut", "finish_reason", "error"} <= set(columns)
    want = {x.stream_id: tuple(x[c] for c in columns) for x in batch.collect()}
    found = {x.stream_id: tuple(x[c] for c in columns) for x in got}
    assert {k: found[k] for k in want} == want and len(got) == 9 and set(found) - set(want) == {"c1", "c5", "c1000"}
    assert kept_states(spark, folder, "at").where("key <> 'end'").count() == 0


def test_windows(spark, tmp_path):
    events = [(1, 1, "2024-01-01T00:00:01Z", 0, "s", 1, "search.started", "{}"), (1, 2, "2024-01-01T00:00:02Z", 0, "s", 1, "answer.verified", '{"bullets":3,"exact":2}'), (1, 3, "2024-01-01T01:00:02Z", 0, "s", 1, "model.delta", '{"attempt":2,"text":"a"}')]
    spark.createDataFrame(events, stateful.ENVELOPE).write.json(str(tmp_path / "ev"))
    counts = run(stateful.windowed_counts(stateful.read_events(spark, str(tmp_path / "ev"))), "windows", spark, tmp_path, "append").collect()
    assert {r.type for r in counts} <= {"search.started", "answer.verified", "model.delta"}


def test_attempts(spark, tmp_path):
    """What is in force equals the batch form; a repeat counts once, a delta of a lower attempt that comes late never, and no state stays."""
    deltas = [("a", 1, 1, 1), ("a", 2, 2, 1), ("a", 3, 3, 2), ("a", 4, 4, 1), ("a", 5, 5, 2), ("a", 6, 6, 3), ("b", 1, 7, 1), ("b", 2, 8, 1), ("c", 1, 9, 2), ("c", 2, 10, 1), ("d", 1, 11, None)]
    frame = spark.createDataFrame([*deltas, deltas[0], deltas[4], deltas[6], ("end", 10**6, 0, 1)], "turn_key string, minute long, seq long, attempt long")
    timed = frame.select("turn_key", F.timestamp_seconds(F.col("minute") * 60).alias("at"), "seq", "attempt")
    slices = [timed.where("seq % 2 = 1").repartition(2), timed.where("seq % 2 = 0").repartition(2)]
    out = run_to_end(slices, lambda s: live.live_attempts(s, idle=600_000_000), f"file://{tmp_path}/a").where("turn_key <> 'end'")
    got = sorted((r.seq, r.change, r.attempt, r.in_force) for r in live.in_force(out).collect())
    batch = {r.seq for r in history.last_attempts(spark.createDataFrame(deltas, "turn_key string, minute long, seq long, attempt long"), ["turn_key"]).collect()}
    assert {s for s, _, _, force in got if force} == batch == {6, 7, 8, 9}
    assert [(s, c) for s, c, _, _ in got] == [(1, "kept"), (2, "kept"), (3, "kept"), (3, "retracted"), (5, "kept"), (6, "kept"), (6, "retracted"), (7, "kept"), (8, "kept"), (9, "kept")]
    assert {r.key for r in kept_states(spark, f"file://{tmp_path}/a").collect()} <= {"end"}


@pytest.mark.parametrize("seed", range(3))
def test_attempts_do_not_depend_on_cuts(seed):
    r = random.Random(seed)
    rows = sorted((r.randrange(0, 60) * 60_000_000, 0, i, json.dumps({"attempt": r.choice([0, 1, 2, None])})) for i in range(80))
    rows = sorted(rows + rows[::7])
    fold, state, cut = live.AttemptFold(10**10), {}, []
    whole = fold_rows(fold, {}, rows, 10**12)
    for k in range(0, 60, 7):
        cut += fold_rows(fold, state, [x for x in rows if k * 60_000_000 <= x[0] < (k + 7) * 60_000_000], (k + 7) * 60_000_000 - 1)
    cut += fold_rows(fold, state, [], 10**12)
    assert cut == whole and state == {} and len({(s, x["change"]) for _, s, x in whole}) == len(whole)


def test_many_keys_share_a_call(spark, tmp_path, monkeypatch):
    """Keys, null and empty ones among them, are folded by buckets in small steps: rows of state do not grow with the keys."""
    monkeypatch.setattr(ordered, "BUCKETS", 3)
    monkeypatch.setattr(ordered, "STEP", 7)
    keys = [None, "", "=", *[f"k{i}" for i in range(40)]]
    deltas = [(k, 60 * n + 60, 100 * i + n, n % 3) for i, k in enumerate(keys) for n in range(5)]
    random.Random(2).shuffle(deltas)
    frame = lambda rows: spark.createDataFrame(rows, "turn_key string, s long, seq long, attempt long").withColumn("at", F.timestamp_seconds("s")).repartition(3)
    folder = f"file://{tmp_path}/m"
    out = run_to_end([frame([x for x in deltas if x[1] < 210]), frame([*[x for x in deltas if x[1] >= 210], ("end", 10**6, 0, 0)])], lambda s: live.live_attempts(s, idle=10**15), folder).where("turn_key IS DISTINCT FROM 'end'")
    want = {(k, 100 * i + n, "kept") for i, k in enumerate(keys) for n in (0, 1, 2)} | {(k, 100 * i + n, "retracted") for i, k in enumerate(keys) for n in (1, 2)}
    assert {(r.turn_key, r.seq, r.change) for r in out.collect()} == want
    assert {r.key for r in kept_states(spark, folder).collect()} >= set(keys)
    stored = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "state").load()
    assert 0 < stored.count() <= 3


def test_many_streams_share_a_call(spark, tmp_path, monkeypatch):
    """Replies of many streams, the first half of each in one run and the rest in the next: rows of state do not grow with the streams."""
    monkeypatch.setattr(ordered, "BUCKETS", 3)
    body = lambda i: b"".join(b"data: " + x + b"\n\n" for x in (json.dumps({"choices": [{"delta": {"content": f"said {i} ä"}}]}, ensure_ascii=False).encode(), b'{"choices":[{"delta":{"content":" more"}}]}', b"[DONE]"))
    chunks = [(f"s{i}", n, bytearray(body(i)[20 * n : 20 * n + 20])) for i in range(40) for n in range(-(-len(body(i)) // 20))]
    random.Random(3).shuffle(chunks)
    half = len(chunks) // 2
    schema = "stream_id string, chunk_seq long, chunk binary"
    frame = lambda rows, at: spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.lit(at)))
    folder = f"file://{tmp_path}/share"
    out = run_to_end([frame(chunks[:half] + chunks[:9], 1000), frame(chunks[half:] + chunks[:9], 1060)], lambda s: assembly.live_replies(s, "openai"), folder)
    assert {(r.stream_id, r.output, r.cut) for r in out.collect()} == {(f"s{i}", f"said {i} ä more", False) for i in range(40)} and out.count() == 40
    before = spark.conf.get(ordered.PROVIDER, None)
    spark.conf.set(ordered.PROVIDER, ordered.ROCKSDB)
    try:
        assert 0 < spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "at").load().count() <= 3
    finally:
        spark.conf.unset(ordered.PROVIDER) if before is None else spark.conf.set(ordered.PROVIDER, before)
