"""Which texts hold which of many patterns, in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.functions.arrays import text_slices
from graniteleaf.sources.tables import ship

#: Bytes of patterns in one automaton (which takes some forty times as much); more patterns are taken in shards, each with a pass of its own.
SHARD_BYTES = 4 << 20
#: Bytes of texts that are looked through at once, words of eight bytes at a pattern's start that are looked for, and bits of their hashes.
TEXT_BYTES, STEPS, BITS = 4 << 20, 4, 18


def _hashed(words: np.ndarray) -> np.ndarray:
    return (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class _Starts:
    """Texts that can hold one of the patterns: those with the first words of patterns, by their hashes, one after another. The others hold none."""

    def __init__(self, patterns: list[str]):
        raw = [p.encode() for p in patterns]
        self.known = np.zeros((min(min(map(len, raw), default=0) // 8, STEPS), 1 << BITS), bool)  # a pattern under eight bytes can stand anywhere
        for i, known in enumerate(self.known):
            known[_hashed(np.frombuffer(b"".join(r[8 * i : 8 * i + 8] for r in raw), np.uint64))] = True

    def rows(self, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places of texts, given by row ends and bytes."""
        if not len(self.known):
            return np.arange(len(ends))
        if len(data) < 8:
            return np.zeros(0, np.int64)
        shifted = (data[a : a + (len(data) - a) // 8 * 8].view(np.uint64) for a in range(8))
        at = np.concatenate([np.flatnonzero(self.known[0][_hashed(words)]) * 8 + a for a, words in enumerate(shifted)])
        every = np.lib.stride_tricks.sliding_window_view(data, 8)
        for i, known in enumerate(self.known[1:], 1):
            at = at[at + 8 * i < len(every)]
            at = at[known[_hashed(every[at + 8 * i].view(np.uint64)[:, 0])]]
        return np.unique(np.searchsorted(ends, at, "right"))


class _Automaton:
    """An Aho-Corasick automaton of a shard; a worker keeps its last one between tasks."""

    kept: tuple[str, _Automaton] | None = None

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        self.blank = [i for i, p in enumerate(patterns) if not p]
        for i, p in enumerate(patterns):
            if p:
                self.found.add_word(p, i)
        self.some = len(self.blank) < len(patterns)
        self.starts = _Starts([p for p in patterns if p])
        if self.some:
            self.found.make_automaton()

    @classmethod
    def of(cls, key: str, patterns: list[str]) -> _Automaton:
        if cls.kept is None or cls.kept[0] != key:
            cls.kept = (key, cls(patterns))
        return cls.kept[1]

    def likely(self, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places of texts, given by row ends and bytes, that within() has to read; in the others no pattern stands."""
        return np.arange(len(ends)) if self.blank or not self.some else self.starts.rows(ends, data)

    def within(self, text: str) -> set[int]:
        return {i for _, i in self.found.iter(text)}.union(self.blank) if self.some else set(self.blank)


def _shards(patterns: DataFrame) -> Iterator[list[str]]:
    """Distinct patterns, SHARD_BYTES at a time."""
    shard, size = [], 0
    for r in patterns.where("pattern IS NOT NULL").select("pattern").distinct().toLocalIterator():
        shard.append(r[0])
        size += 4 * len(r[0]) + 1
        if size >= SHARD_BYTES:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts(text_id, text), patterns(pattern_id, pattern) -> text_id, pattern_id: each text with each pattern that stands in it, letter by letter.

    A text is read once for each shard of patterns, whatever their number; no text is compared with a pattern by itself, and texts are not shuffled. The automaton reads
    texts that have the first words of a pattern; that the others have none is seen in Arrow buffers (if no pattern is under eight bytes). A text with a pattern
    twice counts once; repeated rows count each. Null texts hold nothing, null patterns stand nowhere, the empty pattern stands in every text. Empty tables give an empty table.
    """
    spark = texts.sparkSession
    ship(spark)
    kind = dict(texts.dtypes)["text_id"]
    found = None
    for shard in _shards(patterns):
        sent, key = spark.sparkContext.broadcast(shard), uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            automaton, own = _Automaton.of(key, sent.value), sent.value
            for batch in batches:
                texts, at, which = batch.column("text"), [], []
                for a, ends, data in text_slices(texts, TEXT_BYTES):
                    for i in (a + automaton.likely(ends, data)).tolist():
                        hits = automaton.within(texts[i].as_py())
                        at += [i] * len(hits)
                        which += [own[h] for h in hits]
                yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(at, pa.int64())), pa.array(which, pa.string())], names=["text_id", "pattern"])

        part = texts.where("text IS NOT NULL").select("text_id", "text").mapInArrow(scan, f"text_id {kind}, pattern string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"text_id {kind}, pattern string")
    return found.join(patterns.select("pattern_id", "pattern"), "pattern").select("text_id", "pattern_id")
