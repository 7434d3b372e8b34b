"""License scan, n-gram join, substring dedup, decontamination, LM scoring against brute force, on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import census, decontamination, license_scan, lm_scoring, ngram_join, queries, substring_dedup, tokens

BLANK, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, labels string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows():
    r = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(300)] + ["A-b", "Ünï", "x" * 300]
    base = [r.choice(vocabulary) for _ in range(120)]
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one two three four"), (4, "one two three four"), (5, " ".join(base)), (6, "  ".join(base))]
    for i in range(7, 40):
        words = list(base) if i % 2 else [r.choice(vocabulary) for _ in range(r.randrange(1, 150))]
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    out += [(40, " ".join(["same"] * 400)), (41, "z" * 3_000_000), (42, "Released under the MIT License. " * 3), (43, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this odd file except in compliance with the License."), (44, "cc by-nc CC_BY_NC")]
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, "x", "y") for i, t in data], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("rule", ["blank", "alnum"])
@pytest.mark.parametrize("chunk", [3, 64, 1 << 19])
def test_words(data, rule, chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    texts = [t for _, t in data if len(t or "") < 10_000]
    got = tokens.tokenise(pa.array(texts, pa.string()), rule)
    want = [re.findall(BLANK if rule == "blank" else ALNUM, lower(t) if rule == "alnum" else t or "") for t in texts]
    assert list(got.counts) == [len(w) for w in want]
    seen = {}
    for h, w in zip(got.hash.tolist(), [x for w in want for x in w], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_license_scan(docs, data, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in data:
        words, places, labels = re.findall(ALNUM, lower(t)), [], set()
        for label, phrase in license_scan.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert got[43].labels == "apache-2" and got[43].score >= license_scan.COVER and got[44].base_labels == "cc-by-nc"
    assert license_scan.scan(empty).count() == 0


@pytest.fixture(scope="module")
def notices():
    """Each template with other words around it, and notices whose one telling word has no template."""
    own = [(label, f"Some words before it. {text} And more of them behind, as files have.") for label, text in license_scan.NOTICES]
    strange = [
        ("", "This work is licensed under a Creative Commons Attribution-NonCommercial-SharedSource-SA 4.0 International License."),
        ("", "Licensed under the Apache License, Version 3.0."), ("", "This work is licensed under the GNU General Public License, version 5."),
        ("agpl", "it is covered under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
        ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License."), ("", "This work is about a license of commons"),
    ]
    return own + strange


def test_every_notice_gets_its_own_label(spark, notices):
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(notices)], "doc_id long, text string")).collect()
    wrong = [(notices[r.doc_id], r.labels) for r in got if r.labels != notices[r.doc_id][0]]
    assert not wrong and len(got) == len(notices) > 40


def test_notices_beside_each_other(spark):
    """Two licenses in one text are both found; a notice with a word put in is still found."""
    mit, apache = license_scan.NOTICES[1][1], license_scan.NOTICES[5][1]
    texts = [mit + " " + apache, apache.replace("compliance", "strict and full compliance"), " ".join(["Released under the MIT License."] * 500)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(3)] == ["apache-2,mit", "apache-2", "mit"] and got[2].n_base == 500


def shingles(t):
    w = re.findall(BLANK, t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(sets))]


@pytest.mark.parametrize("chunk", [3, 1 << 19])
def test_lower_words(chunk, monkeypatch):
    """A-Z only: other capitals, and the letters' neighbours in ASCII, stay different."""
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    texts = ["The MIT License. É é @ ` [ {", None, "the mit license. É é @ ` [ {"]
    got = tokens.tokenise(pa.array(texts, pa.string()), "lower")
    assert list(got.counts) == [9, 0, 9] and (got.hash[:9] == got.hash[9:]).all() and len(set(got.hash.tolist())) == 9


def test_case_makes_no_shingle(spark, tmp_path):
    """op3: texts that differ in A-Z only are one class; shingles that do are one shingle."""
    text = "The quick Brown fox jumps over the Lazy dog"
    rows = [(3, text), (2, text.upper()), (5, "A b c d e a B c d e A b c d e"), (7, "Élan a b c d"), (8, "élan a b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_join(spark, str(tmp_path)).collect()}
    assert got == {2: (5, 2), 3: (5, 2), 5: (5, 5), 7: (1, 7), 8: (1, 8)}


@pytest.mark.parametrize("rare", [1, 32])
def test_ngram_join(docs, data, rare, monkeypatch, empty):
    monkeypatch.setattr(ngram_join, "RARE_LEVEL", int(ngram_join._level(np.array([rare]))[0]))
    monkeypatch.setattr(ngram_join, "LIST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    sets = [shingles(t) for _, t in data]
    want = components(sets)
    assert [(got[i].n_shingles, got[i].component_id) for i, _ in data] == [(len(s), data[c][0]) for s, c in zip(sets, want, strict=True)]
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted(data[c][0] for c in set(want))
    if rare == 1:
        assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_null_and_shared_ids(spark):
    text = " ".join(map(str, range(30)))
    other = " ".join(map(str, range(100, 130)))
    frame = spark.createDataFrame([(None, text), (5, text), (3, other), (5, other), (5, text), (9, other)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.near_duplicates(frame).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (5, 3), (5, 3), (9, 3)]


def test_many_near_copies(spark):
    r = random.Random(1)
    base = [str(r.random()) for _ in range(60)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(60)] = str(r.random())
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.component_id for x in ngram_join.near_duplicates(frame).orderBy("doc_id").collect()]
    assert got == components([shingles(t) for t in texts])


def test_substring_dedup(docs, data, empty):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    first, words = {}, {i: re.findall(BLANK, t or "") for i, t in data}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].text) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert sum(r.n_removed for r in got.values()) > 0 and substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_ids(spark):
    text = " ".join(map(str, range(60)))
    frame = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (7, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(frame).collect()) == [(-1, 0), (2, 0), (4, 60), (4, 60), (7, 60)]


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_ordered_blocks(spark, n):
    frame = spark.createDataFrame([(None,), *[(i * i,) for i in range(200)]], "doc_id long")
    out = census.ordered_blocks(frame.withColumn("text", F.lit("x")), n).where("doc_id IS NOT NULL").orderBy("doc_id").collect()
    blocks = [r._block for r in out]
    assert blocks == sorted(blocks) and len(set(blocks)) <= n and (n < 3 or len(set(blocks)) > n // 2)


@pytest.mark.parametrize(("part_bytes", "group_bytes"), [(1 << 20, 1 << 20), (200, 1 << 20), (100, 300)])
def test_decontamination(spark, docs, data, part_bytes, group_bytes, empty):
    items = [(1, " ".join(data[8][1].split()[3:20]) if len(data[8][1].split()) > 20 else data[5][1][:300]), (2, data[5][1][:400]), (3, "same SAME same"), (4, None), (5, "..."), (None, "one two"), (2, "cc by nc")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench, part_bytes=part_bytes, group_bytes=group_bytes).collect()}
    windows = {}
    for item, t in items:
        w = re.findall(ALNUM, lower(t))
        for k in range(max(0, len(w) - 10) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).update([] if item is None else [item])
    lengths = {len(w) for w in windows}
    for i, t in data:
        w, hit, ids = re.findall(ALNUM, lower(t)), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    ids |= windows[tuple(w[k : k + m])]
        names = ",".join(sorted(map(str, ids)))
        g = got[i]
        assert (g.n_words, g.n_hit, g.n_items, g.items, g.contaminated) == (len(w), len(hit), len(ids), names, bool(hit))
        assert g.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
    clean = {r.doc_id for r in decontamination.keep_clean(docs, bench, part_bytes=part_bytes, group_bytes=group_bytes).collect()}
    assert clean == {i for i in got if not got[i].contaminated}
    assert decontamination.contamination(empty, bench).count() == 0 and decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_hot_suffixes():
    """Many windows that end in the same words cost no more than others; a window of equal hashes but other words is no hit."""
    r = random.Random(4)
    items = [(i, " ".join([f"w{r.randrange(10**6)}" for _ in range(30)] + ["the end"])) for i in range(3000)] + [(-1, "the " * 300)]
    search = decontamination.searchers(items)
    assert sum(len(s.begins) for s in search) == 3000 * 23 + 1
    text = decontamination.Text(pa.array(["the " * 100_000 + items[5][1] + " the end" * 50_000, items[7][1].upper()]))
    first, which = search[0].find(text)
    inside = text.words.room()[first] >= 10
    assert inside.sum() == (100_000 - 9) + 23 + 23
    text.bytes = text.bytes.copy()
    text.bytes[text.start[-1]] = ord("x")  # the last word, under its old hash
    assert (text.words.room()[search[0].find(text)[0]] >= 10).sum() == inside.sum() - 1


def test_lm_scoring(docs, data, empty):
    mu = 10.0
    got = {r.doc_id: r for r in lm_scoring.score(docs, mu).collect()}
    seq = {i: [*re.findall(BLANK, t or ""), None] for i, t in data}
    c, c2, c3, begun = Counter(), Counter(), Counter(), 0
    for i, t in seq.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(t)
            c2.update(zip([0, *t[:-1]], t, strict=True))
            c3.update(zip([0, *t[:-2]], t[:-1], t[1:], strict=False))
            begun += 1
    n, v = sum(c.values()), len(c)
    states = {0: begun} | dict(c)

    def arc(h, w):
        """The automaton by its rules, arc by arc: weight of w from the state h, and the state it leads to."""
        if len(h) == 2:
            p2 = 10 ** arc(h[1:], w)
            return math.log10((c3[*h, w] + mu * p2) / (c2[h] + mu)) if c3[*h, w] else math.log10(mu / (c2[h] + mu)) + arc(h[1:], w)
        p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
        if not h:
            return math.log10(p)
        return math.log10((c2[h[0], w] + mu * p) / (states[h[0]] + mu)) if c2[h[0], w] else math.log10(mu / (states[h[0]] + mu)) + math.log10(p)

    for i, t in seq.items():
        s, state = 0.0, (0,)
        for k, w in enumerate(t):
            s += arc(state, w)
            before = 0 if k == 0 else t[k - 1]
            state = (before, w) if c2[before, w] else (w,) if c[w] else ()
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert abs(g.base_score - sum(arc((), w) for w in t)) < 1e-6 and abs(g.score - s) < 1e-6
    assert lm_scoring.score(empty).count() == 0


def test_lm_scoring_of_capitals(spark, tmp_path):
    """op10: a word in capitals is the same token."""
    rows = [(1, "The cat É"), (2, "the CAT é"), (3, "THE dog"), (4, "Cat the"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, str(tmp_path)).collect()}
    seq = {i: [*re.findall(BLANK, lower(t)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in seq}
    c = Counter(w for i, t in seq.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    assert c["the"] >= 3
    for i, t in seq.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n) and abs(got[i].base_score - base) < 1e-9


def test_lm_scoring_odd_ids(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b c"), (3, "a b c"), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.held_out, r.n_tokens) for r in lm_scoring.score(frame).collect()]
    assert sorted(got, key=str) == sorted([(None, True, 3), (None, True, 3), (3, False, 4), (3, False, 4), (4, False, 1)], key=str)


@pytest.mark.parametrize(("n", "fan_bits"), [(1, 6), (5, 6), (8, 2), (16, 2), (32, 2), (33, 1)])
def test_census(spark, n, fan_bits):
    """Counts, first blocks and totals for any tree; the rows sent grow with blocks times levels, not with their square."""
    r = random.Random(n)
    values = [(i, r.randrange(40) ** 3 * 0x123456789ABCDEF % 2**63) for i in range(400)]
    frame = spark.createDataFrame([(v, i * n // 400) for i, v in values], f"v long, {census.BLOCK} int")

    def keys_of(table):
        keys, counts = np.unique(table.column("v").to_numpy().astype(np.uint64), return_counts=True)
        return [(keys, counts.astype(np.uint32))]

    def heard(truths):
        def run(table, said):
            keys = keys_of(table)[0][0]
            answer = census.told(said, 0, keys, n, truths=truths, fan_bits=fan_bits)
            both = census.totals(said, 0)
            block = table.column(census.BLOCK)[0].as_py()
            columns = [[block] * len(keys), keys.astype(np.int64), answer.astype(np.int64), [both[0]] * len(keys), [both[1]] * len(keys)]
            return pa.table([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=["b", "v", "a", "n", "k"])

        return run

    schema = "b int, v long, a long, n long, k long"
    blocks = [i * n // 400 for i, _ in values]
    count, first = Counter(v for _, v in values), {}
    for (_, v), b in zip(values, blocks, strict=True):
        first.setdefault(v, b)
    said = census.census(frame, keys_of, n, lambda sums: sums, fan_bits=fan_bits)
    got = frame.groupBy(census.BLOCK).cogroup(said.groupBy("grp")).applyInArrow(heard(False), schema).collect()
    assert {(x.b, x.v) for x in got} == {(b, v) for (_, v), b in zip(values, blocks, strict=True)}
    assert all((x.a, x.n, x.k) == (count[x.v], 400, len(count)) for x in got)
    again = census.census(frame, keys_of, n, fan_bits=fan_bits)
    got = frame.groupBy(census.BLOCK).cogroup(again.groupBy("grp")).applyInArrow(heard(True), schema).collect()
    assert all(x.a == (first[x.v] < x.b) for x in got)
    levels, bits = census.shape(n, fan_bits)
    assert said.count() == n << bits and (n << bits) * levels <= n * 2**fan_bits * (1 + math.log2(n) / fan_bits)


def test_packed_keys():
    r = np.random.default_rng(3)
    for size in (0, 1, 2, 1000):
        for high in (3, 2**20, 2**64 - 1):
            for low in (0, 16):
                keys = np.unique(r.integers(0, high, size, dtype=np.uint64, endpoint=True) >> np.uint64(low) << np.uint64(low))
                assert (census.unpack(census.pack(keys)) == keys).all()
