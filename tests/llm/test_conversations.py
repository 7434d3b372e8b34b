"""Conversation repair against a search over all edits, on odd rows, and its two ways against each other."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, symbol string, audit int"


def rows():
    r = random.Random(3)
    out = []
    texts = ["One.", "Two!", "Three?", "broken off", "", "  ", "One. ", "é ", "x" * 200_000 + ".", None]
    for conv in range(60):
        for turn in range(r.randrange(0, 9)):
            if r.random() < 0.9:
                out.append((conv, r.choice([turn, turn, turn, turn * 3, None]), r.choice(["system", "user", "assistant", "assistant", "user", None, "", "tool", "u"]), r.choice(texts + [f"Text {turn}.", f"Text {turn}. More!"])))
    out += [(None, 1, "user", "Hello."), (None, None, "assistant", "Yes."), (None, 1, "user", "Hello.")]
    out += [(70, t, ["user", "assistant"][t % 2], f"Line {t % 40}.") for t in range(100)] + [(71, 5, "user", "Same.")] * 30
    return [(*x, None, 7) for x in out]


def broken(data):
    """All rows after damage by conversation, in order."""
    out = {}
    for conv, turn, role, text, *_ in data:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for k, v in out.items()}


def expected(rows, costs=C.Costs()):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # the cheapest edits, least letters first: a best-first search over (cost, letters, row, roles so far)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        if i == len(rows) and last in ("", "a"):
            break
        done.add((i, last))
        follows = {"u": last in ("", "s", "a"), "a": last == "u", "s": last == ""}
        for role in ("user", "assistant"):
            if follows[role[0]]:
                heapq.heappush(heap, (cost + costs.insert, letters + "I", i, role[0], (*out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + costs.delete, letters + "D", i + 1, last, out))
            if faults[i] in ("", "truncated"):
                more = costs.truncated if faults[i] else 0
                if follows.get(role[:1]):
                    heapq.heappush(heap, (cost + costs.keep + more, letters + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if follows[new[0]]:
                        heapq.heappush(heap, (cost + costs.rerole + more, letters + "R", i + 1, new[0], (*out, f"{new}:{text}")))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def read(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select(*C.DIGEST).collect()}


@pytest.mark.parametrize("costs", [C.Costs(), C.Costs(insert=1), C.Costs(1, 1, 1, 1, 1), C.Costs(0, 3, 4, 2, 0)])
def test_letters(costs):
    r = random.Random(1)
    for _ in range(300):
        symbols = "".join(r.choice("suaxuauaSUAX0156") for _ in range(r.randrange(0, 9)))
        table = []
        for i, s in enumerate(symbols):
            kind = next(k for k, v in C.SYMBOLS.items() if s in v)
            role = "suax"[C.SYMBOLS[kind].index(s)]
            table.append((i, role, {"ok": f"t{i}.", "truncated": f"t{i}", "blank": "", "duplicate": None}[kind]))
        if any(x[2] is None for x in table):
            continue
        assert C.cheapest(symbols, costs) == expected(table, costs)[5:7]


def test_repair(frame, data):
    want = {k: expected(v) for k, v in broken(data).items()}
    got = read(C.repair(C.damage(frame)))
    assert got == want and frame.select("conv_id").distinct().count() == len(got)


@pytest.mark.parametrize("limits", [(3, 1 << 40), (0, 1 << 40), (1 << 40, 500)])
def test_in_stretches(frame, data, limits):
    assert read(C.repair(C.damage(frame), limits=limits)) == {k: expected(v) for k, v in broken(data).items()}


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(9)
    data = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["A.", "B!", "open end", f"T{t}.", f"T{t}."])) for t in range(400)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    assert read(C.repair(C.damage(frame), limits=(50, 1 << 40))) == {1: expected(broken(data)[1])}
    lines = C.repaired_rows(C.damage(frame), limits=(50, 1 << 40)).orderBy("seg", "i").collect()
    assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in lines).encode()).hexdigest() == expected(broken(data)[1])[-1]


def test_nothing(spark, frame):
    empty = C.repair(C.damage(frame.where("false")))
    assert empty.count() == 0
    lost = spark.createDataFrame([(i, 0, "user", "Hi.") for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0], "conv_id long, turn long, role string, text string")
    got = C.repair(C.damage(lost)).collect()
    assert len(got) > 3 and all(tuple(x)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for x in got)
    assert C.repaired_rows(C.damage(lost)).where(F.lit(True)).count() == 0
