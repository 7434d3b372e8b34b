"""Which phrases stand in which texts, at any phrase length, without pairs of texts and phrases.

Phrases are dealt by hash into shards of a bounded size. An Aho-Corasick automaton of each shard walks every text
once, so the work for a text does not depend on the number of phrases but on the number of shards. Texts are not
shuffled. The phrases are sent to all tasks only while they fit into GROUPS_SENT groups; of larger sets only the
short ones are, and long ones meet the texts on the hash join of one of their inner runs of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an automaton (it takes some 80 bytes for each), automata in memory at once, groups of them that are sent.
SHARD, SHARDS, GROUPS_SENT = 1 << 20, 4, 4
#: Characters of texts that are walked before the next group of automata is built.
WALKED = 32 << 20
#: Phrases of fewer characters are short: they may have no inner words to join on.
INNER = 3


@lru_cache(maxsize=SHARDS)
def _automaton(phrases: tuple[tuple[int, str], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, phrase in phrases:
        found.add_word(phrase, number)
    found.make_automaton()
    return found


class Shards:
    """Phrases as (number, phrase), dealt into tuples of at most SHARD characters (a longer phrase is one of its own)."""

    def __init__(self, phrases: list[tuple[int, str]]):
        # phrases of one or two characters are looked up among those of the text: they can stand in it very often
        self.tiny = {p: i for i, p in phrases if len(p) <= 2}
        self.shards: list[tuple[tuple[int, str], ...]] = []
        now, size = [], 0
        for i, p in phrases:
            if len(p) <= 2:
                continue
            if now and size + len(p) > SHARD:
                self.shards.append(tuple(now))
                now, size = [], 0
            now.append((i, p))
            size += len(p)
        if now:
            self.shards.append(tuple(now))

    def found(self, texts: list[str]) -> list[set[int]]:
        """The numbers of the phrases in each text."""
        out = [set() for _ in texts]
        if self.tiny:
            for text, numbers in zip(texts, out, strict=True):
                held = set(text).union(a + b for a, b in zip(text, text[1:], strict=False))
                numbers.update(self.tiny[p] for p in held & self.tiny.keys())
        for shard in self.shards:
            walk = _automaton(shard).iter
            for text, numbers in zip(texts, out, strict=True):
                numbers.update(number for _, number in walk(text))
        return out


def _walk(sent):
    """Batches of (key, text) -> key, number."""

    def flush(shards: Shards, keys: list, texts: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        found = shards.found(texts)
        for first in range(0, len(keys), 1000):
            some = range(first, min(first + 1000, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some for _ in found[i]], kind), pa.array([n for i in some for n in sorted(found[i])], pa.int32())], names=["_key", "_number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(sent.value)
        keys, texts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= WALKED:
                    yield from flush(shards, keys, texts, kind)
                    keys, texts, size = [], [], 0
        if keys:
            yield from flush(shards, keys, texts, kind)

    return run


def _by_automaton(texts: DataFrame, phrases: DataFrame, size: int) -> DataFrame:
    """Pairs by automata; each group of phrases is collected by itself and sent as a broadcast of bounded size."""
    spark = texts.sparkSession
    groups = max(1, -(-size // (SHARD * SHARDS)))
    kind = dict(texts.dtypes)["key"]
    out = None
    for g in range(groups):
        some = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(groups)) == g)
        listed = sorted(r.phrase for r in some.collect())
        sent = spark.sparkContext.broadcast(list(enumerate(listed)))
        names = spark.createDataFrame(list(enumerate(listed)), "_number int, phrase string")
        pairs = texts.select("key", "text").mapInArrow(_walk(sent), f"_key {kind}, _number int").join(F.broadcast(names), "_number").select(F.col("_key").alias("key"), "phrase")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _inner(phrase: Column) -> Column:
    """Runs of INNER words of a phrase that are whole words of any text it stands in."""
    words = F.split(phrase, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    return _runs_of(inner)


def _runs_of(words: Column) -> Column:
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (INNER - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + j) for j in range(1, INNER)]))


def _by_inner_words(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Pairs that meet on the longest inner run of words of a phrase, which is seldom a common one, and hold each other."""
    runs = _inner(F.col("phrase"))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    keyed = phrases.select("phrase", longest.alias("run"))
    of_text = texts.select("key", F.explode(F.array_distinct(_runs_of(F.split("text", " ")))).alias("run")).join(keyed.select("run").distinct(), "run", "left_semi")
    met = of_text.join(keyed, "run").select("key", "phrase").distinct()
    return met.join(texts.select("key", "text"), "key").where(F.contains("text", "phrase")).select("key", "phrase")


def contained(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts (key, text), phrases (phrase; words by single spaces) -> the distinct pairs (key, phrase) where the phrase stands in the text.

    Null texts hold nothing, null and empty phrases stand nowhere.
    """
    texts = texts.where("key IS NOT NULL AND text IS NOT NULL")
    phrases = phrases.select("phrase").where("phrase <> ''").distinct()
    sizes = phrases.select(F.char_length("phrase").alias("n"), (F.size(_inner(F.col("phrase"))) > 0).alias("long"))
    every, short = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("long"), F.col("n"))), F.lit(0))).first()
    if every <= SHARD * SHARDS * GROUPS_SENT:
        return _by_automaton(texts, phrases, every)
    long = F.size(_inner(F.col("phrase"))) > 0
    return _by_automaton(texts, phrases.where(~long), short).unionByName(_by_inner_words(texts, phrases.where(long)))
