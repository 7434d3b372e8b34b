"""Language identification against sums made letter by letter, on odd rows, and by held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from tidewell.llm import language_id as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, vector string"


def slow_bundle(text):
    out = np.zeros(L.DIMENSIONS)
    t = f" {(text or '').lower()} "
    sym = [ord(c) if c.isalpha() else 32 for c in t]
    for i in range(1, len(t) - 1):
        if t[i].isalpha():
            a, b, c = (L.letter_vector(x).astype(float) for x in sym[i - 1 : i + 2])
            out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


TEXTS = ["the cat and the hat", "le chat et la souris; où?", "der Hund und die Katze", "", None, "12 34 !!", "a", "ß", "İstanbul 東京は首都", "the  the\tthe\n", "x" * 700, "😀 smile".encode("utf-16", "surrogatepass").decode("utf-16")]


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_bundles(size, monkeypatch):
    monkeypatch.setattr(L, "SLICE", size)
    monkeypatch.setattr(L, "GRAMS", 5)
    got = L.bundles(enumerate(TEXTS), len(TEXTS))
    for t, v in zip(TEXTS, got, strict=True):
        assert np.array_equal(slow_bundle(t), v), t


def test_odd_rows(spark):
    langs = ["en", "fr", "de", "en", "en", "fr", None, "de", "ja", "en", None, "en"]
    rows = [(i if i else None, t, x, "s", 1, 0.5, "v") for i, (t, x) in enumerate(zip(TEXTS, langs, strict=True))]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(4)
    names, vectors = L.fit(docs)
    sums = {}
    for i, t, x, *_ in rows + rows[:3]:
        if x is not None and zlib.crc32(str(i if i is not None else "").encode()) % 4 != 2:
            sums[x] = sums.get(x, 0) + slow_bundle(t)
    sums = {k: v for k, v in sums.items() if np.any(v)}
    assert names == sorted(sums) and np.array_equal(vectors, np.stack([sums[x] for x in names]))
    got = L.predict(docs, (names, vectors)).collect()
    assert len(got) == len(rows) + 3
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        v, r = slow_bundle(t), by[i]
        if not np.any(v):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            cosines = [v @ sums[x] / np.linalg.norm(v) / np.linalg.norm(sums[x]) for x in names]
            assert r.lang_pred == names[int(np.argmax(cosines))] and abs(r.score - max(max(cosines), 0)) < 1e-9
        assert r.held_out == (zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en"), (3, "7", "en")], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model[0] == [] and {(r.lang_pred, r.score) for r in L.predict(docs, model).collect()} == {("und", 0.0)}
    assert L.predict(docs.where("false"), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.join(L.predict(docs, L.fit(docs)), "doc_id").where("held_out AND lang IS NOT NULL AND text RLIKE '[a-z]'").select("lang", "lang_pred").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
