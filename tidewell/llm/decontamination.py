"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

The alphabet is words: both texts become sequences of 64-bit word hashes, and a block is two
words. Windows of one length form one searcher. A table indexed by a block's hash holds the
smallest distance of that block from the end of any window; the search jumps by it, all
stretches of a batch in step. Where it is 0, the bucket of windows that end in this block, sorted
by the hash of the whole window, is searched for the window that stands here, and its words are
compared byte by byte. A bucket may be large without costing more than its logarithm.

The benchmark is read on the driver in groups of at most GROUP_BYTES, so what is sent to executors has a
fixed bound; a task builds searchers of at most PART_BYTES of text each, one at a time, for each batch of
documents. Each further group is one more pass over the same rows, without a shuffle.

Cases: null or empty text has no words and no hits; an item without words is never found; an item
with a null item_id marks words but is not listed or counted; items that share an id count once; rows of documents are
answered one by one, also with equal or null ids; an empty benchmark hits nothing; further columns are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import lean_batches

WINDOW = 10
#: Benchmark text of one searcher, and of one pass over the documents.
PART_BYTES = 4 << 20
GROUP_BYTES = 32 << 20
#: Words that one cursor goes through.
STRETCH = 512
U = np.uint64
FOUND = "doc_id long, n_words long, marks binary, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items string, contaminated boolean"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _block(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return tokens.mix(before * U(0x9FB21C651E98DF25) + last)


def _whole(words: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each of these places on."""
    total = np.zeros(len(first), dtype=U)
    for j in range(m):
        total = tokens.mix(total * U(0xD1B54A32D192ED03) + words[first + j])
    return total


class Text:
    """Words of a column: hashes, and their bytes in lower case."""

    def __init__(self, column):
        self.words = tokens.tokenise(column, "alnum", spans=True)
        self.hash, self.first = self.words.hash, self.words.first
        self.start, self.size = self.words.start, (self.words.end - self.words.start)
        self.bytes = tokens.column_bytes(column)[0]

    def equal(self, at: np.ndarray, other: Text, there: np.ndarray) -> np.ndarray:
        """Whether the words at these places are those at the places of the other text."""
        same = self.size[at] == other.size[there]
        sizes = self.size[at[same]]
        if len(sizes):
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            mine = _LOWER[self.bytes[np.repeat(self.start[at[same]], sizes) + inside]]
            its = _LOWER[other.bytes[np.repeat(other.start[there[same]], sizes) + inside]]
            same[same] = np.add.reduceat(mine != its, np.cumsum(sizes) - sizes) == 0
        return same


class Searcher:
    """All windows of one length: where in the benchmark each begins, and the items that hold it."""

    def __init__(self, text: Text, length: int, begins: np.ndarray, items: np.ndarray):
        self.text, self.length = text, length
        whole = _whole(text.hash, begins, length)
        suffix = self._blocks(text.hash, begins + length - 1)
        order = np.lexsort((items, whole, suffix))
        begins, items, whole, suffix = begins[order], items[order], whole[order], suffix[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (whole[1:] != whole[:-1]) | (suffix[1:] != suffix[:-1])
        self.at = np.append(np.flatnonzero(new), len(order))  # where the items of each distinct window begin
        self.items, self.begins, self.whole, self.suffix = items, begins[new], whole[new], suffix[new]
        self.bits = max(10, (4 * len(self.begins)).bit_length())
        self.shift = np.full(1 << self.bits, max(1, length - 1), dtype=np.uint8 if length < 256 else np.uint32)
        for j in range(min(1, length - 1), length):  # smaller distances come last and stay
            self.shift[self._slot(self._blocks(text.hash, self.begins + j))] = length - 1 - j

    def _blocks(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _block(words[at - 1], words[at]) if self.length > 1 else tokens.mix(words[at])

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> U(64 - self.bits)).astype(np.int64)

    def find(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence; words of two rows are not told apart."""
        m, words = self.length, text.hash
        at = np.arange(m - 1, len(words), STRETCH)
        stop = np.minimum(at + STRETCH, len(words))
        ends, blocks = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        while len(at):
            block = self._blocks(words, at)
            jump = self.shift[self._slot(block)]
            stay = jump == 0
            ends.append(at[stay])
            blocks.append(block[stay])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        first, block = np.concatenate(ends) - m + 1, np.concatenate(blocks)
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        some = low < high
        first, low, high = first[some], low[some], high[some]
        whole = _whole(words, first, m)
        while (low < high).any():  # the place of the whole window in its bucket
            mid = (low + high) // 2
            less = (low < high) & (self.whole[np.minimum(mid, len(self.whole) - 1)] < whole)
            low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
        found = low < len(self.whole)
        found[found] = (self.whole[low[found]] == whole[found]) & (self.suffix[low[found]] == self._blocks(words, first[found] + m - 1))
        first, which = first[found], low[found]
        same = np.ones(len(first), dtype=bool)
        for j in range(m):
            same[same] = text.equal(first[same] + j, self.text, self.begins[which[same]] + j)
        return first[same], which[same]


def searchers(items: list[tuple], window: int = WINDOW) -> list[Searcher]:
    """One searcher for each length of window in (item_id, text) rows; of a window it tells rows, as places in items."""
    text = Text(pa.array([t for _, t in items], pa.string()))
    counts = np.diff(text.first)
    lengths = np.minimum(window, counts)
    out = []
    for m in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == m)
        sizes = counts[rows] - m + 1
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out.append(Searcher(text, m, np.repeat(text.first[rows], sizes) + inside, np.repeat(rows, sizes)))
    return out


def _hits(parts: list[list[tuple]], window: int):
    """A function of a column that gives, of each part, its rows and (text, searcher, first words, windows) of what occurs within a row; and how a batch is cut for it."""
    kept = [searchers(parts[0], window)] if len(parts) == 1 else None

    def run(column):
        text = Text(column)
        room = text.words.room()
        for rows in parts:
            for s in kept[0] if kept else searchers(rows, window):
                first, which = s.find(text)
                inside = room[first] >= s.length
                yield rows, text, s, first[inside], which[inside]

    def cut(batches):
        for batch in batches:
            # searchers that are built anew for each piece are worth a large one
            for a, b in tokens.pieces(batch.column("text"), 1 << (21 if kept else 25)):
                yield batch.slice(a, b - a)

    return run, cut


def _pass(docs: DataFrame, parts: list[list[tuple]], window: int, again: bool) -> DataFrame:
    """Adds to marks and items what occurs of these parts; the text is passed on only if another pass follows."""

    def search(batches):
        hits, cut = _hits(parts, window)
        for batch in cut(batches):
            column = batch.column("text")
            counts, hit, items = np.zeros(batch.num_rows, np.int64), None, {}
            for rows, text, s, first, which in hits(column):
                if hit is None:
                    hit, owner, counts = np.zeros(len(text.hash), dtype=bool), text.words.rows(), text.words.counts
                begun = np.zeros(len(text.hash) + 1, dtype=np.int64)
                np.add.at(begun, first, 1)
                np.add.at(begun, first + s.length, -1)
                hit |= np.cumsum(begun[:-1]) > 0
                for r, w in np.unique(np.stack([owner[first], which], 1), axis=0).tolist():
                    items.setdefault(r, set()).update(str(rows[i][0]) for i in s.items[s.at[w] : s.at[w + 1]] if rows[i][0] is not None)
            if hit is None:  # no item has a word
                counts = tokens.tokenise(column, "alnum").counts
            at = np.cumsum(counts) - counts
            marks, lists = [], []
            for r, (m, i) in enumerate(zip(batch.column("marks").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                own = hit[at[r] : at[r] + counts[r]] if hit is not None else np.zeros(0, bool)
                new = np.packbits(own).tobytes() if own.any() else b""
                if m and new:
                    new = (np.frombuffer(m, np.uint8) | np.frombuffer(new, np.uint8)).tobytes()
                marks.append(new or m)
                lists.append(sorted(items.get(r, set()).union(i)))
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(marks, pa.binary()), pa.array(lists, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + [column] * again, names=["doc_id", "n_words", "marks", "items", "text"][: 4 + again])

    return docs.mapInArrow(lean_batches(search), FOUND + ", text string" * again)


def _told(batches):
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        hits = [int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) if m else 0 for m in marks]
        names = [",".join(x) for x in batch.column("items").to_pylist()]
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in names]
        sizes = [x.count(",") + 1 if x else 0 for x in names]
        columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(names), pa.array([h > 0 for h in hits])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"])


def _groups(benchmark: DataFrame, window: int, part_bytes: int, group_bytes: int):
    """The parts of each group of the benchmark, and whether another group follows; a group is read only when it is needed."""
    total = int(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = 1 if total <= group_bytes else 2 * (total // group_bytes + 1)
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    for i in range(groups):
        parts, size = [[]], 0
        for row in benchmark.where(group == i).select("item_id", "text").collect():
            if size > part_bytes:
                parts, size = [*parts, []], 0
            parts[-1].append(tuple(row))
            size += len((row.text or "").encode())
        yield parts, i + 1 < groups


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs."""
    for parts, _ in _groups(benchmark, window, part_bytes, group_bytes):

        def run(batches, parts=parts):
            hits, cut = _hits(parts, window)
            for batch in cut(batches):
                clean = np.ones(batch.num_rows, dtype=bool)
                for _, text, _, first, _ in hits(batch.column("text")):
                    clean[np.searchsorted(text.first, first, "right") - 1] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean_batches(run), docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, items and contaminated of each document."""
    found = docs.select(F.col("doc_id").cast("long"), "text", F.lit(b"").alias("marks"), F.array().cast("array<string>").alias("items"))
    for parts, again in _groups(benchmark, window, part_bytes, group_bytes):
        found = _pass(found, parts, window, again)
    return found.mapInArrow(_told, RESULT)
