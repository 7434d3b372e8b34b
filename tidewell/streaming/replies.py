"""Streamed model replies, assembled as their bytes arrive in any cut and order.

Streams are dealt by hash into buckets (ordered.py), so that a call of the state store serves many of them. Chunks that
come too early wait in list state as packed tables. What events say is appended to list state (packed pieces of text), so
a long reply is not written again with each chunk; pieces are read when a stream of the bucket closes. A reply is given
when its stream closes, or, cut, when nothing has come for a while; its state goes then, all but a mark that drops chunks
repeated later until the same time has passed.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ordered import _bucket, _key, _name, _packed, _unpacked, within_pandas

#: Replies that are given at once.
GIVEN = 1000
EARLY = pa.schema([("key", pa.large_string()), ("seq", pa.int64()), ("chunk", pa.large_binary())])
PARTS = pa.schema([("key", pa.large_string()), ("kind", pa.string()), ("idx", pa.int32()), ("text", pa.large_string())])

STOPS = {"end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "tool_use": "tool_calls", "refusal": "content_filter"}


def closed_events(rest: bytes) -> tuple[list[str], bytes]:
    """The data of each event that a blank line has closed, and the bytes after the last; a carriage return at the end waits."""
    held = b"\r" if rest.endswith(b"\r") else b""
    *blocks, left = (rest[: len(rest) - len(held)].replace(b"\r\n", b"\n")).split(b"\n\n")
    found = []
    for block in blocks:
        data = [x[5:].removeprefix(b" ") if x.startswith(b"data:") else b"" for x in block.split(b"\n") if x.startswith(b"data:") or x == b"data"]
        if data:
            found.append(b"\n".join(data).decode("utf-8", "replace"))
    return found, left + held


class Wire:
    """What the events of one wire format say. meta: small facts; say: appends (kind, index, text); blocks: facts by index."""

    def read(self, data: str, meta: dict, say: list, blocks: dict) -> bool:
        """Takes one event; whether it closes the stream."""
        raise NotImplementedError

    def reply(self, meta: dict, parts: list[tuple[str, int, str]], blocks: dict[int, dict]) -> dict:
        raise NotImplementedError


def _object(data: str) -> dict:
    try:
        found = json.loads(data)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _joined(parts: list[tuple[str, int, str]], kind: str, index: int | None = None) -> str:
    return "".join(t for k, i, t in parts if k == kind and index in (None, i))


class OpenAi(Wire):
    def read(self, data, meta, say, blocks):
        if data.strip() == "[DONE]":
            meta["done"] = True
            return True
        j = _object(data)
        for name in ("usage", "error"):
            if j.get(name) is not None:
                meta[name] = j[name]
        choice = (j.get("choices") or [{}])[0] or {}
        delta = choice.get("delta") or {}
        for field, kind in (("content", "output"), ("reasoning_content", "thinking"), ("refusal", "refusal")):
            if delta.get(field) is not None:
                say.append((kind, 0, delta[field]))
        if choice.get("finish_reason") is not None:
            meta["finish_reason"] = choice["finish_reason"]
        for call in delta.get("tool_calls") or []:
            function = call.get("function") or {}
            block = blocks.setdefault(call.get("index"), {})
            block["id"] = block.get("id") or call.get("id") or None
            block["name"] = block.get("name") or function.get("name") or None
            if function.get("arguments") is not None:
                say.append(("call", call.get("index"), function["arguments"]))
        return False

    def reply(self, meta, parts, blocks):
        calls = [{"index": i, "id": b.get("id"), "name": b.get("name"), "arguments": _joined(parts, "call", i)} for i, b in sorted(blocks.items())]
        return {"output": _joined(parts, "output"), "thinking": _joined(parts, "thinking"), "refusal": _joined(parts, "refusal") or None, "finish_reason": meta.get("finish_reason"), "usage": meta.get("usage"), "error": meta.get("error"), "tool_calls": calls or None, "cut": not meta.get("done") and "finish_reason" not in meta}


class Anthropic(Wire):
    def read(self, data, meta, say, blocks):
        j = _object(data)
        for usage in (j.get("usage") or {}, (j.get("message") or {}).get("usage") or {}):
            for name, n in usage.items():
                if isinstance(n, int):  # counts never fall
                    meta.setdefault("usage", {})[name] = max(n, meta.get("usage", {}).get(name, n))
        if (j.get("error") or {}).get("message") is not None:
            meta["error"] = max(j["error"]["message"], meta.get("error", ""))
        delta = j.get("delta") or {}
        if delta.get("stop_reason") is not None:
            meta["stop"] = delta["stop_reason"]
        if j.get("index") is not None:
            block = blocks.setdefault(j["index"], {})
            for name, value in (j.get("content_block") or {}).items():
                if name in ("type", "id", "name", "text") and value is not None:
                    block[name] = max(value, block.get(name, value))
            for field in ("text", "thinking", "partial_json"):
                if delta.get(field) is not None:
                    say.append((field, j["index"], delta[field]))
        meta["done"] = meta.get("done", False) or j.get("type") == "message_stop"
        return j.get("type") == "message_stop"

    def reply(self, meta, parts, blocks):
        of = lambda kind: [i for i, b in sorted(blocks.items()) if b.get("type") == kind]
        calls = [{"index": i, "id": blocks[i].get("id"), "name": blocks[i].get("name"), "arguments": _joined(parts, "partial_json", i)} for i in of("tool_use")]
        output = "".join((blocks[i].get("text") or "") + _joined(parts, "text", i) for i in of("text"))
        thinking = "".join(_joined(parts, "thinking", i) for i in of("thinking"))
        return {"output": output if blocks else None, "thinking": thinking if blocks else None, "finish_reason": STOPS.get(meta.get("stop"), meta.get("stop")), "usage": meta.get("usage") or {}, "error": meta.get("error"), "tool_calls": calls if blocks else None, "cut": not meta.get("done")}


CALLS = "tool_calls array<struct<index:int,id:string,name:string,arguments:string>>"
WIRES = {
    "openai": (OpenAi(), f"output string, thinking string, refusal string, finish_reason string, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>, error struct<message:string>, {CALLS}, cut boolean"),
    "anthropic": (Anthropic(), f"output string, thinking string, finish_reason string, usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>, error string, {CALLS}, cut boolean"),
}


class Assembly(StatefulProcessor):
    """The replies of a bucket of streams. at: a JSON object of how far each stream is, by name; early and parts: packed tables."""

    def __init__(self, wire: Wire, idle_ms: int):
        self.wire, self.idle = wire, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "state string")
        self.early = handle.getListState("early", "rows binary")
        self.parts = handle.getListState("parts", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        states, new = self._states(), []
        for part in rows:
            if not len(part):
                continue
            new.append(pa.table([pa.array(part[c], f.type, from_pandas=True) for c, f in zip(("key", "chunk_seq", "chunk"), EARLY, strict=True)], EARLY))
            for stream, ms in zip(new[-1].column("key").to_pylist(), part["ms"], strict=True):
                state = states.setdefault(_name(stream), {"next": 0, "rest": "", "meta": {}, "blocks": [], "seen": 0, "closed": False})
                state["seen"] = max(state["seen"], int(ms))
        if new:
            said, closed = self._taken(pa.concat_tables(self._tables(self.early) + new), states)
            yield from self._replies(closed)
            if said:
                self.parts.appendValue((_packed(pa.Table.from_pylist(said, PARTS)),))
            self._keep(states, timerValues)

    def _taken(self, held: pa.Table, states: dict[str, dict]) -> tuple[list[dict], dict]:
        """Takes all chunks whose turn it is and keeps the others; gives what open streams have said, and closed ones as (meta, said, blocks) by name."""
        held = held.sort_by([("key", "ascending"), ("seq", "ascending")])
        stream = held.column("key").combine_chunks().dictionary_encode("encode")
        number, seq, chunk = stream.indices.to_numpy(), held.column("seq").to_numpy(), held.column("chunk").combine_chunks()
        names = [_name(x) for x in stream.dictionary.to_pylist()]
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        waits, say_all, closed = np.zeros(len(seq), dtype=bool), [], {}
        for first, end in zip(starts, np.append(starts[1:], len(seq)), strict=True):
            name = names[number[first]]
            state = states[name]
            if state["closed"]:
                continue
            at, ready = first + int(np.searchsorted(seq[first:end], state["next"])), []
            while at < end and seq[at] <= state["next"]:
                if seq[at] == state["next"]:
                    ready.append(chunk[at].as_py())
                    state["next"] += 1
                at += 1
            waits[at:end] = True
            waits[at + 1 : end] &= seq[at + 1 : end] != seq[at : max(at, end - 1)]
            if not ready:
                continue
            events, rest = closed_events(state["rest"].encode("latin-1") + b"".join(ready))
            say, blocks, done = [], dict(map(tuple, state["blocks"])), False
            for data in events:
                done = done or self.wire.read(data, state["meta"], say, blocks)
            if done:
                waits[first:end] = False
                closed[name] = state["meta"], say, blocks
                state |= {"rest": "", "meta": {}, "blocks": [], "closed": True}
            else:
                say_all += [{"key": _key(name), "kind": kind, "idx": index, "text": text} for kind, index, text in say]
                state |= {"rest": rest.decode("latin-1"), "blocks": list(blocks.items())}
        self._put(self.early, held.filter(pa.array(waits)))
        return say_all, closed

    def _states(self) -> dict[str, dict]:
        return json.loads(self.at.get()[0]) if self.at.exists() else {}

    @staticmethod
    def _tables(state) -> list[pa.Table]:
        return [_unpacked(bytes(x[0])) for x in state.get()] if state.exists() else []

    @staticmethod
    def _put(state, table: pa.Table) -> None:
        if table.num_rows:
            state.put([(_packed(table),)])
        elif state.exists():
            state.clear()

    def _keep(self, states: dict[str, dict], timerValues) -> None:  # noqa: N803
        if states:
            self.at.update((json.dumps(states),))
            self.handle.registerTimer(max(min(s["seen"] for s in states.values()) + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.at.clear()

    def _replies(self, ended: dict[str, tuple[dict, list, dict]]) -> Iterator[pd.DataFrame]:
        """The replies of streams that have ended, given as (meta, said last, blocks) by name; what they said before is taken out of the state."""
        if not ended:
            return
        before: dict[str, list] = {}
        if tables := self._tables(self.parts):
            parts = pa.concat_tables(tables)
            theirs = pc.is_in(parts.column("key"), pa.array([_key(x) for x in ended], pa.large_string()))
            own = parts.filter(theirs)
            for key, *piece in zip(*[own.column(c).to_pylist() for c in PARTS.names], strict=True):
                before.setdefault(_name(key), []).append(tuple(piece))
            self._put(self.parts, parts.filter(pc.invert(theirs)))
        found = iter(ended.items())
        while some := list(itertools.islice(found, GIVEN)):
            yield pd.DataFrame([(_key(name), json.dumps(self.wire.reply(meta, before.pop(name, []) + say, blocks))) for name, (meta, say, blocks) in some], columns=["stream_id", "out"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, states = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._states()
        due = {name: states.pop(name) for name in [n for n, s in states.items() if s["seen"] + self.idle <= now]}
        cut = {name: (s["meta"], [], dict(map(tuple, s["blocks"]))) for name, s in due.items() if not s["closed"]}
        yield from self._replies(cut)
        if cut and (tables := self._tables(self.early)):
            early = pa.concat_tables(tables)
            self._put(self.early, early.filter(pc.invert(pc.is_in(early.column("key"), pa.array([_key(x) for x in cut], pa.large_string())))))
        self._keep(states, timerValues)

    def close(self) -> None:
        pass


def live_replies(chunks: DataFrame, wire: str, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """chunks (stream_id, chunk_seq from 0, chunk, at: when it arrived) as a stream -> a row for each reply, as openai_replies or anthropic_replies give it."""
    read, result = WIRES[wire]
    timed = chunks.withColumn("at", within_pandas("at")).where("at IS NOT NULL AND chunk_seq IS NOT NULL AND chunk IS NOT NULL").withWatermark("at", late).select(F.col("stream_id").alias("key"), "at", F.unix_millis("at").alias("ms"), F.col("chunk_seq").cast("long").alias("chunk_seq"), "chunk").withColumn("bucket", _bucket()).groupBy("bucket")
    out = timed.transformWithStateInPandas(Assembly(read, idle_ms), "stream_id string, out string", "Append", "EventTime")
    return out.select("stream_id", F.from_json("out", result).alias("r")).select("stream_id", "r.*")
