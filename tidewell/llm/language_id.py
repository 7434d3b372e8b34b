"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point, so all workers draw the same and
any letter of any script has one. Three letters in a row are bound: the first vector shifted by two places, the
second by one, and the third, multiplied. A text's vector is the sum (bundle) of those of its n-grams, a language's
prototype the sum over its training texts. A document gets the language whose prototype has the largest cosine with
its vector.

An n-gram stands around each letter; its neighbours are letters or, for anything else and at the ends of a text, a
space. So texts are cut into slices of any size without a change, and whole texts count. Sums are made of counts of
distinct n-grams times their vectors, one product of matrices for a few hundred texts.

Training reads every text outside the held-out fold once; a partition sends one vector for each language. Prototypes
are sent to all tasks: LANGUAGES of DIMENSIONS numbers at most (16 MB), more languages raise an error.

Defined results: a text that is null, empty or without letters is `und` with score 0, as is every text if nothing
could be learned. Ties go to the language that sorts first. The score is the cosine, at least 0. A null doc_id
counts as an empty one for the folds. Rows stay as many as they are; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches

DIMENSIONS = 1024
LANGUAGES = 4096
FOLDS, HELD_OUT = 4, 2
#: Characters and texts that are counted in one go, and n-grams whose vectors are held at once.
SLICE, TEXTS, GRAMS = 1 << 20, 512, 8192
CODES = 0x110000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(CODES)), bool, CODES)


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    bits = hashlib.shake_128(code.to_bytes(4, "little")).digest(DIMENSIONS // 8)
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int8) * 2 - 1


def gram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Vectors of n-grams whose letters are places in codes."""
    each = np.stack([letter_vector(int(x)) for x in codes])
    return (np.roll(each, 2, axis=1)[a] * np.roll(each, 1, axis=1)[b] * each[c]).astype(np.float32)


def _slices(texts: Iterator[tuple[int, str | None]]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row, slice of its text with one character more on either side)."""
    rows, parts, size = [], [], 0
    for row, text in texts:
        text = (text or "").lower()
        for i in range(0, len(text), SLICE):
            j = min(len(text), i + SLICE)
            rows.append(row)
            parts.append((text[i - 1] if i else " ") + text[i:j] + (text[j] if j < len(text) else " "))
            size += j - i
            if size >= SLICE or len(rows) >= TEXTS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def bundles(texts: Iterator[tuple[int, str | None]], n: int) -> np.ndarray:
    """The summed n-gram vectors of each of n rows; a row may come with several texts."""
    out = np.zeros((n, DIMENSIONS))
    for rows, parts in _slices(texts):
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        symbol = np.where(letter, codes, 32)
        lengths = np.array([len(p) for p in parts])
        middle = letter.copy()
        ends = np.cumsum(lengths)
        middle[ends - 1] = middle[ends - lengths] = False
        at = np.flatnonzero(middle)
        if not len(at):
            continue
        there = np.zeros(CODES, bool)
        there[symbol] = there[32] = True
        known = np.flatnonzero(there)
        place = np.zeros(CODES, np.int64)
        place[known] = np.arange(len(known))
        dense, wide = place[symbol], len(known)
        gram = (dense[at - 1] * wide + dense[at]) * wide + dense[at + 1]
        if wide**3 <= 1 << 22:
            found = np.flatnonzero(np.bincount(gram, minlength=wide**3))
            back = np.zeros(wide**3, np.int64)
            back[found] = np.arange(len(found))
            column = back[gram]
        else:
            found, column = np.unique(gram, return_inverse=True)
        part = np.repeat(np.arange(len(parts)), lengths)[at]
        for first in range(0, len(found), GRAMS):
            some = found[first : first + GRAMS]
            inside = slice(None) if len(found) <= GRAMS else (column >= first) & (column < first + GRAMS)
            counts = np.bincount(part[inside] * len(some) + column[inside] - first, minlength=len(parts) * len(some))
            vectors = gram_vectors(some // (wide * wide), some // wide % wide, some % wide, known)
            np.add.at(out, rows, counts.reshape(len(parts), len(some)).astype(np.float32) @ vectors)
    return out


def _fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang of a partition -> one vector for each language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        here = sorted(set(langs))
        number = {x: i for i, x in enumerate(here)}
        found = bundles(zip((number[x] for x in langs), batch.column(0).to_pylist(), strict=True), len(here))
        for x, vector in zip(here, found, strict=True):
            sums[x] = sums[x] + vector if x in sums else vector
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes, learned from all documents with a language outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() != HELD_OUT)).select("text", "lang")
    parts = known.mapInArrow(lean_batches(_counted), "lang string, vector array<double>")
    # sums of whole numbers: the order does not matter
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("vector")).limit(LANGUAGES + 1).toArrow()
    if found.num_rows > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    learned = sorted(zip(found.column("lang").to_pylist(), found.column("vector").to_pylist(), strict=True))
    vectors = np.array([v for _, v in learned]).reshape(len(learned), DIMENSIONS)
    some = (vectors != 0).any(axis=1)
    return [x for (x, _), s in zip(learned, some, strict=True) if s], vectors[some]


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    languages, prototypes = model
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                found = bundles(enumerate(batch.column("text").to_pylist()), batch.num_rows)
                size = np.linalg.norm(found, axis=1)
                pred, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
                if languages:
                    cosines = found @ unit.T / np.maximum(size, 1e-300)[:, None]
                    pred, score = cosines.argmax(axis=1), np.clip(cosines.max(axis=1), 0, 1)
                    pred[size == 0], score[size == 0] = -1, 0
                names = pa.array([*languages, UNKNOWN]).take(pa.array(np.where(pred < 0, len(languages), pred)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), names, pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_fold() == HELD_OUT).alias("held_out"))
    return source.mapInArrow(lean_batches(run), PREDICTED)
