"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted across the corpus.

A window is removed when its words also start a window in a document with a smaller doc_id;
removed windows merge into maximal intervals of words. Blocks are ordered by doc_id, so a
window that an earlier block holds is repeated, and only windows first met in the own block
need a comparison of ids there. The answer to a block is one bit for each window it sent.

Cases: null or empty text has no words and stays; documents shorter than a window stay; rows
with equal doc_id never remove each other's words (they meet in one block); a null doc_id is neither
smaller nor larger than any, so such a row keeps its words and may be in any block; further columns are not used; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import census, tokens
from .shared import lean, partitions

WINDOW = 50
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def _windows(table: pa.Table, k: int):
    """Rows ordered by doc_id with nulls last; positions, hashes and ids of windows of rows with an id."""
    table = table.sort_by([("doc_id", "ascending")])
    words = tokens.tokenise(table.column("text"), "blank")
    at, hashes = tokens.windows(words, k)
    ids = table.column("doc_id").combine_chunks()
    known = len(ids) - ids.null_count
    end = int(np.searchsorted(at, words.first[known]))
    rows = words.rows()[at[:end]]
    return table, words, at[:end], hashes[:end], ids.fill_null(0).to_numpy(zero_copy_only=False)[rows]


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text (words joined by one space) of each document."""
    n = partitions(docs.sparkSession)
    blocks = census.ordered_blocks(docs.select("doc_id", "text"), n)

    def keys(table: pa.Table):
        return [(np.unique(_windows(table, window)[3]), None)]

    said = census.census(blocks, keys, n)

    def cut(table: pa.Table, said: pa.Table) -> pa.Table:
        table, words, at, hashes, ids = _windows(table, window)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        earlier = census.told(said, 0, unique, n, truths=True)
        gone = at[earlier[which] | (ids > ids[first][which])] if len(at) else at
        marks = np.zeros(len(words.hash) + 1, dtype=np.int64)
        marks[gone + 1 if len(gone) else gone] = 1
        begun = np.cumsum(marks)
        upto = begun[1:]
        covered = upto - np.concatenate([np.zeros(min(window, len(upto)), np.int64), upto[:-window]]) > 0
        removed = np.concatenate([[0], np.cumsum(covered)])
        removed = removed[words.first[1:]] - removed[words.first[:-1]]
        shas, texts = [], []
        for i, text in enumerate(table.column("text").to_pylist()):
            own = (text or "").encode().split()
            if removed[i]:
                keep = ~covered[words.first[i] : words.first[i + 1]]
                own = [own[j] for j in np.flatnonzero(keep)]
            kept = b" ".join(own)
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        return pa.table(
            [table.column("doc_id").cast(pa.int64()), pa.array(words.counts), pa.array(removed), pa.array(shas), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
        )

    return blocks.groupBy(census.BLOCK).cogroup(said.groupBy("grp")).applyInArrow(lean(cut), RESULT)
