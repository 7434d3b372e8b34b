"""Phrases in texts: every route gives what a plain search gives."""

import random

import pytest

from tidewell.operators import containment as C
from tidewell.operators import grounding

WORDS = "the of cat sat on a mat é ßtraße 東京 don't x-y café the".split()


def texts_and_phrases():
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 60)))) for i in range(80)] + [(80, None), (None, "the cat"), (81, "")]
    phrases = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 9))) for _ in range(120)]
    for _ in range(120):
        t = r.choice([x for _, x in texts if x])
        a = r.randrange(len(t))
        phrases.append(" ".join(t[a : a + r.randrange(1, 40)].split()))
    return texts, [*phrases, *phrases[:5], "", None, "a", "é", "t ", "nowhere at all in these texts"]


def pairs(texts, phrases):
    return {(k, p) for k, t in texts if k is not None and t is not None for p in phrases if p and p in t}


@pytest.mark.parametrize(("shard", "sent"), [(1 << 20, 4), (50, 1 << 20), (50, 0), (1 << 20, 0)])
def test_routes(spark, monkeypatch, shard, sent):
    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "GROUPS_SENT", sent)
    if shard == 50:
        monkeypatch.setattr(C, "SHARDS", 40)
    texts, phrases = texts_and_phrases()
    found = C.contained(spark.createDataFrame(texts, "key long, text string").repartition(3), spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()
    assert {(r.key, r.phrase) for r in found} == pairs(texts, phrases) and len(found) == len(pairs(texts, phrases))


@pytest.mark.parametrize("shard", [1, 30, 10_000])
def test_shards(monkeypatch, shard):
    monkeypatch.setattr(C, "SHARD", shard)
    texts, phrases = texts_and_phrases()
    listed = sorted({p for p in phrases if p})
    found = C.Shards(list(enumerate(listed))).found([t or "" for _, t in texts])
    assert [{listed[i] for i in f} for f in found] == [{p for p in listed if p in (t or "")} for _, t in texts]


def test_no_nested_loop(spark):
    pages = spark.createDataFrame([(1, "Two  “words” here"), (2, "none")], "page_id long, text string")
    quotes = spark.createDataFrame([(7, "two 'words'"), (8, 'TWO "words"'), (9, "ne"), (10, " ")], "quote_id long, quote string")
    found = grounding.contained_quotes(pages, quotes)
    assert {tuple(r) for r in found.collect()} == {(1, 8), (2, 9)}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    texts, phrases = spark.createDataFrame([(1, "a b")], "key long, text string"), spark.createDataFrame([("a",)], "phrase string")
    assert C.contained(texts.where("false"), phrases).count() == 0 and C.contained(texts, phrases.where("false")).count() == 0
