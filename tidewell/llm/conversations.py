"""Repair the structure of conversations with the fewest edits.

A conversation is well formed if its roles are an optional system row and then user and assistant in turn, by the
first letter of the role. Rows without text and rows that repeat an earlier one must go, a row whose text breaks off
costs extra if it stays, and rows can be kept, given another role, deleted or put in.

Method: a conversation is a string of symbols (first letter of the role and fault of a row) that an automaton of
four states reads: nothing yet, after system, after user, after assistant. Forward and backward minimum costs tell
which arcs lie on a cheapest path (tight arcs); a walk through the tight arcs carries the set of states that the
letters so far can have reached and takes the least letter at each step, so of all cheapest edits it finds the one
that comes first in ASCII order.

Conversations that fit into memory are grouped once and their texts stay in the JVM: only the strings of symbols
go to Python. Longer ones (LIMIT_ROWS, LIMIT_BYTES) are cut into stretches by range of turn. A stretch is reduced to
a matrix of least costs, the few matrices of a conversation are multiplied from both ends, each stretch then tells
for each set of states where its walk would leave it, and a last pass walks every stretch from its own entry. Both
ways give the same rows.

Rows of one turn are ordered by role and text. Null turns come first; nulls in role and text count as one space.
A null conv_id is a conversation of its own. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Conversations of more rows or bytes of text than this are repaired in stretches.
LIMIT_ROWS, LIMIT_BYTES = 20_000, 16 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: Symbols of a row by fault; within each, the first letter of its role: s, u, a, other.
SYMBOLS = {"ok": "suax", "truncated": "SUAX", "blank": "0123", "duplicate": "4567"}
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
ADDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FAR = 1 << 60


@dataclass(frozen=True)
class Costs:
    """What each edit costs; truncated is added where a truncated row stays."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damage(conversations: DataFrame) -> DataFrame:
    """Break rows by the checksum of `conv_id:turn`: conv_id, turn, role, text, copies (0: the row is gone)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _symbol(duplicate: Column) -> Column:
    """The symbol of a row (role, text)."""
    at = F.when(F.col("role") == "", 4).otherwise(F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    kinds = F.when(bare == "", SYMBOLS["blank"]).when(duplicate, SYMBOLS["duplicate"]).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), SYMBOLS["truncated"]).otherwise(SYMBOLS["ok"])
    return F.substr(kinds, at, F.lit(1))


@lru_cache(maxsize=64)
def _arcs(symbol: str, costs: Costs) -> tuple[tuple[int, str, int, int], ...]:
    """Arcs of one row: from state, letter, to state, cost."""
    fault = next(k for k, v in SYMBOLS.items() if symbol in v)
    letter = SYMBOLS["ok"][SYMBOLS[fault].index(symbol)]
    out = [(q, "D", q, costs.delete) for q in range(4)]
    if fault in ("ok", "truncated"):
        more = costs.truncated if fault == "truncated" else 0
        out += [(q, "K", to, costs.keep + more) for q, to in NEXT[letter].items()]
        out += [(q, "R", to, costs.rerole + more) for q, to in ADDED.items()]
    return tuple(out)


def _with_inserts(cost: list[int], insert: int, backward: bool = False) -> list[int]:
    """Least costs at one place once any number of rows may be put in there."""
    cost = list(cost)
    for _ in range(3):
        for q, to in ADDED.items():
            a, b = (q, to) if backward else (to, q)
            cost[a] = min(cost[a], cost[b] + insert)
    return cost


def at_the_end(costs: Costs) -> list[int]:
    """Least cost from each state to a well-formed end."""
    return _with_inserts([0 if q in ENDS else FAR for q in range(4)], costs.insert, True)


def forward(symbols: str, entry: list[int], costs: Costs) -> list[list[int]]:
    """Least cost of reaching each state before each row and at the end; inserts before a row belong to it."""
    out, cost = [], list(entry)
    for s in symbols:
        cost = _with_inserts(cost, costs.insert)
        out.append(cost)
        step = [FAR] * 4
        for q, _, to, c in _arcs(s, costs):
            step[to] = min(step[to], cost[q] + c)
        cost = step
    return [*out, cost]


def backward(symbols: str, leave: list[int], costs: Costs) -> list[list[int]]:
    """Least cost from each state before each row (and at the end) to a well-formed end."""
    out = [list(leave)]
    for s in reversed(symbols):
        step = [FAR] * 4
        for q, _, to, c in _arcs(s, costs):
            step[q] = min(step[q], out[-1][to] + c)
        out.append(_with_inserts(step, costs.insert, True))
    return out[::-1]


def walk(symbols: str, ahead: list[list[int]], behind: list[list[int]], best: int, states: frozenset[int], last: bool, costs: Costs) -> tuple[str, frozenset[int]]:
    """Letters of the least cheapest edit from a set of states, and the states in which it leaves."""
    letters, at = [], 0
    while True:
        if at == len(symbols) and (not last or any(q in ENDS and ahead[at][q] == best for q in states)):
            return "".join(letters), states
        found: dict[str, set[int]] = {}
        for q in states:
            if ahead[at][q] + costs.insert + behind[at][ADDED[q]] == best:
                found.setdefault("I", set()).add(ADDED[q])
        for q, letter, to, c in _arcs(symbols[at], costs) if at < len(symbols) else ():
            if q in states and ahead[at][q] + c + behind[at + 1][to] == best:
                found.setdefault(letter, set()).add(to)
        least = min(found)
        letters.append(least)
        states = frozenset(found[least])
        at += least != "I"


def faults(symbols: str) -> tuple[int, int, int, int]:
    """Rows that are blank, duplicate, truncated; neighbours whose roles do not follow each other."""
    plain = symbols.translate(str.maketrans("".join(SYMBOLS.values()), SYMBOLS["ok"] * 4))
    illegal = sum(plain[i : i + 2] not in ("su", "ua", "au") for i in range(len(plain) - 1))
    blank, duplicate, truncated = (sum(map(symbols.count, SYMBOLS[k])) for k in ("blank", "duplicate", "truncated"))
    return blank, duplicate, truncated, illegal


def cheapest(symbols: str, costs: Costs) -> tuple[int, str]:
    """Cost and letters of the first cheapest edit of a whole conversation."""
    behind = backward(symbols, at_the_end(costs), costs)
    best = behind[0][START]
    found = _walks(symbols, [0, FAR, FAR, FAR], at_the_end(costs), best, True, [1 << START], costs)
    return best, found[1 << START][0]


def _walks(symbols: str, entry, leave, best: int, last: bool, starts, costs: Costs) -> dict[int, tuple[str, frozenset[int]]]:
    """The walk through a stretch from each set of states (as bits)."""
    ahead, behind = forward(symbols, list(entry), costs), backward(symbols, list(leave), costs)
    if last:
        ahead[-1] = _with_inserts(ahead[-1], costs.insert)
    return {s: walk(symbols, ahead, behind, best, frozenset(q for q in range(4) if s >> q & 1), last, costs) for s in starts}


def placed(audit: str, first: int = 0, odd: bool | None = None) -> tuple[list[int], list[str | None]]:
    """For each repaired row its place among the rows (from 1; 0: put in) and its new role (None: its own).

    first: repaired rows before these; odd: whether the whole conversation gets an odd number (a system row leads).
    """
    at, roles, row = [], [], 0
    odd = bool(sum(x != "D" for x in audit) % 2) if odd is None else odd
    for letter in audit:
        row += letter != "I"
        if letter != "D":
            role = ("user", "assistant")[(first + len(at) + odd) % 2]
            at.append(0 if letter == "I" else row)
            roles.append(None if letter == "K" else role)
    return at, roles


REPORT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, at array<int>, roles array<string>"


@lru_cache(maxsize=1 << 14)
def _short(symbols: str, costs: Costs) -> tuple:
    """Short strings of symbols come again and again."""
    return *faults(symbols), *cheapest(symbols, costs)


def _report(costs: Costs):
    def report(symbols: pd.Series) -> pd.DataFrame:
        rows = [_short(s, costs) if len(s) <= 64 else (*faults(s), *cheapest(s, costs)) for s in symbols]
        return pd.DataFrame([(*r, *placed(r[-1])) for r in rows], columns=[x.split()[0] for x in REPORT.split(", ")])

    return F.pandas_udf(report, REPORT)


def _gaps(low: Column, high: Column, distinct: Column) -> Column:
    return F.coalesce(high - low + 1 - distinct, F.lit(0)).cast("long")


DIGEST = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _at_once(rows: DataFrame, costs: Costs) -> DataFrame:
    """Conversations that fit into memory: conv_id, counts, audit and repaired (array of role, text)."""
    each = rows.select("*", F.explode_outer(F.array_repeat(F.lit(True), F.col("copies"))).alias("there")).repartition("conv_id")
    nth = F.expr("row_number() OVER (PARTITION BY conv_id, there, role, text ORDER BY turn NULLS FIRST)")
    each = each.withColumn("nth", nth).withColumn("symbol", _symbol(F.col("nth") > 1))
    held = F.collect_list(F.when(F.col("there"), F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text", "nth", "symbol")))
    found = each.groupBy("conv_id").agg(F.array_sort(held).alias("rows"))
    turns = F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))
    found = found.withColumn("x", _report(costs)(F.array_join(F.transform("rows", lambda r: r["symbol"]), "")))
    row = lambda i: F.get("rows", i - 1)
    repaired = F.zip_with("x.at", "x.roles", lambda i, r: F.struct(F.coalesce(r, row(i)["role"]).alias("role"), F.coalesce(row(i)["text"], F.lit("")).alias("text")))
    return found.select("conv_id", _gaps(F.array_min(turns), F.array_max(turns), F.size(turns)).alias("gaps"), "x.blank", "x.duplicate", "x.truncated", "x.illegal", "x.cost", "x.audit", repaired.alias("repaired"))


def _line(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(":"), text)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys of the left side stay."""
    named = right.select([F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(named[f"_{c}"]) for c in keys]
    return left.join(named, on, how).drop(*[f"_{c}" for c in keys])


def _stretches(rows: DataFrame) -> DataFrame:
    """conv_id, seg, symbols, keys (turn, role, th of each symbol): the rows of each conversation in order, cut by range."""
    rows = rows.where("copies > 0").withColumn("th", F.sha2("text", 256))
    bare = rows.groupBy("conv_id", "turn", "role", "th").agg(F.sum("copies").alias("n"), F.first(_symbol(F.lit(False))).alias("own"), F.first(_symbol(F.lit(True))).alias("again"))
    # the first turn with this role and text; a null turn is the earliest
    firsts = bare.groupBy("conv_id", "role", "th").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("none"))
    late = F.when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    each = _meet(bare, firsts, ["conv_id", "role", "th"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    each = each.withColumn("symbol", F.when(late | (F.col("k") > 1), F.col("again")).otherwise(F.col("own")))
    dealt = each.repartitionByRange("conv_id", "turn", "role", "th", "k").withColumn("seg", F.spark_partition_id())
    held = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "th", "k", "symbol")))
    found = dealt.groupBy("conv_id", "seg").agg(held.alias("rows"))
    return found.select("conv_id", "seg", F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"), F.transform("rows", lambda r: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["th"].alias("th"))).alias("keys"))


def _summary(costs: Costs):
    def summary(symbols: pd.Series) -> pd.DataFrame:
        out = []
        for s in symbols:
            matrix = [x for q in range(4) for x in forward(s, [0 if i == q else FAR for i in range(4)], costs)[-1]]
            out.append((*faults(s), s[0] + s[-1], matrix))
        return pd.DataFrame(out, columns=["blank", "duplicate", "truncated", "illegal", "ends", "matrix"])

    return F.pandas_udf(summary, "blank long, duplicate long, truncated long, illegal long, ends string, matrix array<long>")


def _chain(costs: Costs):
    """Of the summaries of a conversation in order: its counts and cost, and for each stretch the costs at entry and exit."""

    def chain(parts: pd.Series) -> pd.DataFrame:
        out = []
        for p in parts:
            p = list(p)
            entry, leave = [[0, FAR, FAR, FAR]], [at_the_end(costs)]
            for x in p:
                m = [int(v) for v in x["matrix"]]
                entry.append([min(FAR, *(entry[-1][q] + m[4 * q + to] for q in range(4))) for to in range(4)])
            for x in p[::-1]:
                m = [int(v) for v in x["matrix"]]
                leave.append([min(FAR, *(m[4 * q + to] + leave[-1][to] for to in range(4))) for q in range(4)])
            cost, leave = leave[-1][START], leave[::-1]
            counts = [int(sum(x[k] for x in p)) for k in ("blank", "duplicate", "truncated", "illegal")]
            counts[3] += sum(faults(a["ends"][1] + b["ends"][0])[3] for a, b in zip(p[:-1], p[1:], strict=True))
            out.append((*counts, cost, [{"seg": int(x["seg"]), "entry": entry[i], "leave": leave[i + 1], "last": i == len(p) - 1} for i, x in enumerate(p)]))
        return pd.DataFrame(out, columns=["blank", "duplicate", "truncated", "illegal", "cost", "stretches"])

    return F.pandas_udf(chain, "blank long, duplicate long, truncated long, illegal long, cost long, stretches array<struct<seg:int,entry:array<long>,leave:array<long>,last:boolean>>")


def _exits(costs: Costs):
    """For each set of states (as bits) the set in which the walk leaves a stretch; 0 where no cheapest path enters so."""

    def exits(symbols: pd.Series, entry: pd.Series, leave: pd.Series, best: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for s, e, l, b, z in zip(symbols, entry, leave, best, last, strict=True):
            e = [int(x) for x in e]
            before = _with_inserts(e, costs.insert)
            first = backward(s, [int(x) for x in l], costs)[0]
            on = [q for q in range(4) if before[q] + first[q] == b]
            starts = [x for x in range(1, 16) if all(q in on for q in range(4) if x >> q & 1)]
            found = _walks(s, e, [int(x) for x in l], b, z, starts, costs)
            out.append([sum(1 << q for q in found[x][1]) if x in found else 0 for x in range(16)])
        return pd.Series(out)

    return F.pandas_udf(exits, "array<int>")


def _starts(parts: pd.Series) -> pd.Series:
    """In which set of states the walk enters each stretch of a conversation."""
    out = []
    for p in parts:
        state, rows = 1 << START, []
        for x in p:
            rows.append({"seg": int(x["seg"]), "start": state})
            state = int(x["exits"][state])
        out.append(rows)
    return pd.Series(out)


def _letters(costs: Costs):
    def letters(symbols: pd.Series, entry: pd.Series, leave: pd.Series, best: pd.Series, last: pd.Series, start: pd.Series) -> pd.Series:
        each = zip(symbols, entry, leave, best, last, start, strict=True)
        return pd.Series([_walks(s, [int(v) for v in e], [int(v) for v in l], b, z, [x], costs)[x][0] for s, e, l, b, z, x in each], dtype=object)

    return F.pandas_udf(letters, "string")


def _placed(audit: pd.Series, first: pd.Series, odd: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([placed(a, int(f), bool(o)) for a, f, o in zip(audit, first, odd, strict=True)], columns=["at", "roles"])


def _in_stretches(rows: DataFrame, costs: Costs) -> tuple[DataFrame, DataFrame]:
    """Long conversations: their counts and audit (conv_id, ...), and their repaired rows (conv_id, seg, i, role, text).

    What meets for one conversation is one small row for each stretch, of which there are at most as many as
    partitions; its audit is one string, as the result asks for.
    """
    segs = stored(_stretches(rows), "stretches")
    parts = segs.withColumn("x", _summary(costs)("symbols")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "x.*"))).alias("parts"))
    chained = stored(parts.select("conv_id", _chain(costs)("parts").alias("c")).select("conv_id", "c.*"), "chains")
    ends = chained.select("conv_id", "cost", F.explode("stretches").alias("s")).select("conv_id", "cost", "s.*")
    here = _meet(segs, ends, ["conv_id", "seg"])
    left = here.select("conv_id", "seg", _exits(costs)("symbols", "entry", "leave", "cost", "last").alias("exits"))
    starts = F.pandas_udf(_starts, "array<struct<seg:int,start:int>>")
    begun = left.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "exits"))).alias("parts")).select("conv_id", F.explode(starts("parts")).alias("s")).select("conv_id", "s.*")
    told = _meet(here, begun, ["conv_id", "seg"]).select("conv_id", "seg", "keys", _letters(costs)("symbols", "entry", "leave", "cost", "last", "start").alias("audit"))
    told = stored(told, "letters")
    whole = told.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    turns = rows.where("copies > 0").groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))
    counts = _meet(_meet(chained.drop("stretches"), whole, ["conv_id"]), turns, ["conv_id"])
    counts = counts.withColumn("gaps", _gaps(F.col("low"), F.col("high"), F.col("n"))).drop("low", "high", "n")

    kept = F.length(F.translate("audit", "D", "")).cast("long")
    sizes = told.groupBy("conv_id").agg(F.sum(kept).alias("whole"), F.collect_list(F.struct("seg", kept.alias("kept"))).alias("parts"))
    before = F.aggregate(F.filter("parts", lambda x: x["seg"] < F.col("seg")), F.lit(0).cast("long"), lambda s, x: s + x["kept"])
    put = F.pandas_udf(_placed, "at array<int>, roles array<string>")
    out = _meet(told, sizes, ["conv_id"]).withColumn("p", put("audit", before, F.col("whole") % 2 == 1))
    out = out.select("conv_id", "seg", "keys", F.posexplode(F.arrays_zip(F.col("p.at").alias("at"), F.col("p.roles").alias("roles"))).alias("i", "x"))
    out = out.select("conv_id", "seg", "i", F.get("keys", F.col("x.at") - 1).alias("key"), F.col("x.roles").alias("new")).select("conv_id", "seg", "i", "new", "key.*")
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", F.sha2("text", 256).alias("th"), "text").groupBy("conv_id", "turn", "role", "th").agg(F.first("text").alias("text"))
    lines = _meet(out, texts, ["conv_id", "turn", "role", "th"], "left")
    return counts, lines.select("conv_id", "seg", "i", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation as they stream past in order."""
    now, state, done = None, None, []
    for batch in batches:
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
    if state is not None:
        done.append((now, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["conv_id", "sha"])


def _split(rows: DataFrame, limits: tuple[int, int]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations within the limits, and rows of the others (None if there is none)."""
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    long = stored(sizes.where((F.col("n") > limits[0]) | (F.col("bytes") > limits[1])).select("conv_id"), "long")
    if long.isEmpty():
        return rows, None
    return _meet(rows, long, ["conv_id"], "left_anti"), _meet(rows, long, ["conv_id"], "left_semi")


def repaired_rows(rows: DataFrame, costs: Costs | None = None, limits: tuple[int, int] = (LIMIT_ROWS, LIMIT_BYTES)) -> DataFrame:
    """The repaired rows themselves: conv_id, seg, i (in order within a conversation: seg, then i), role, text."""
    costs = costs or Costs()
    short, long = _split(rows, limits)
    out = _at_once(short, costs).select("conv_id", F.lit(0).alias("seg"), F.posexplode("repaired").alias("i", "r")).select("conv_id", "seg", "i", "r.role", "r.text")
    return out if long is None else out.unionByName(_in_stretches(long, costs)[1])


def repair(rows: DataFrame, costs: Costs | None = None, limits: tuple[int, int] = (LIMIT_ROWS, LIMIT_BYTES)) -> DataFrame:
    """rows (conv_id, turn, role, text, copies: the row so many times, 0 keeps only its conv_id) -> one row for each conv_id.

    gaps: turns missing between the first and the last; blank, duplicate, truncated: rows by first fault; illegal:
    neighbours whose roles do not follow each other; cost and audit: the cheapest edits; repaired_sha256: of the
    repaired `role:text` lines. A conversation without rows has zeros, an empty audit and the hash of nothing.
    The hash of a long conversation streams through one task with bounded memory, as SHA-256 is a chain.
    """
    costs = costs or Costs()
    short, long = _split(rows, limits)
    text = F.array_join(F.transform("repaired", lambda r: _line(r["role"], r["text"])), "\n")
    out = _at_once(short, costs).withColumn("repaired_sha256", F.sha2(text, 256)).select(*DIGEST)
    if long is None:
        return out
    counts, lines = _in_stretches(long, costs)
    each = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "i").select("conv_id", _line(F.col("role"), F.col("text")))
    met = _meet(counts, each.mapInArrow(_hashed, "conv_id long, sha string"), ["conv_id"], "left")
    return out.unionByName(met.withColumn("repaired_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).select(*DIGEST))
