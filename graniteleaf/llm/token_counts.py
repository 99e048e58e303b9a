"""Token counts by a map-side two-tier lookup.

A text is cut at white space into units that the byte-level pre-tokenizer never joins: a word with the one blank
before it, or a run of white space. (Files with another pre-tokenizer, a normalizer or another library are not cut: their texts go whole to
the library.) Of a unit that is not known yet, the signs after its letters are looked up apart, and words are encoded many to a call. Tier one is a compact table of the lengths of frequent units, broadcast in the
task closure; tier two is a cache that each Python worker keeps between tasks. Only units in neither are encoded, in
batches, by the tokenizer library itself. No text and no sequence of units is shuffled: the frequent units of the whole
table come from summaries of fixed size, one a task.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import ship, stored

#: Unicode White_Space, as the pre-tokenizer's \s has it; Python's own \s has four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
SPACES = re.compile(f"[{SPACE}]")
SIGNS = string.punctuation
#: Entries that a worker's cache holds before it starts anew (about 60 MB).
CACHE_ENTRIES = 400_000
#: Code points of the longest units that the frequent table and the cache take; longer ones are encoded where they stand.
LONGEST = 64
#: A frequent unit is at least one in FREQUENT of all units, so the table has at most that many entries.
FREQUENT = 100_000
#: Counters that a task keeps at most while it counts its units.
COUNTERS = 4 * FREQUENT
#: Code points that are cut into units at once.
PIECE = 2_000_000

_tokenizers: dict = {}
_caches: dict = {}


class _Library:
    """The tokenizer library on one file: token numbers of whole texts, and whether units may be counted apart."""

    def __init__(self, path: str):
        self.pieces = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.pieces, self.cuttable, self.special = SentencePieceProcessor(model_file=path), False, None
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each core it sees
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        kind = json.loads(self.own.pre_tokenizer.__getstate__()) if self.own.pre_tokenizer is not None else {}
        self.cuttable = self.own.normalizer is None and kind.get("type") == "ByteLevel" and kind.get("use_regex") is True and kind.get("add_prefix_space") is False

    def lengths(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts)]
        return [len(e) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def word_lengths(self, words: list[str]) -> list[int]:
        """Of words of letters with a blank before them: each is one pre-token of the words written one after another."""
        place = self.own.encode("".join(words), add_special_tokens=False).word_ids
        n = np.bincount(place) if place else np.zeros(0, np.int64)
        return n.tolist() if len(n) == len(words) else self.lengths(words)


def _tokenizer(path: str) -> _Library:
    """Loaded once in each worker."""
    if path not in _tokenizers:
        _tokenizers[path] = _Library(path)
    return _tokenizers[path]


def _lengths(path: str, units: list[str]) -> list[int]:
    return _tokenizer(path).lengths(units)


def _is_word(unit: str) -> bool:
    return unit[:1] == " " and unit[1:].isalpha()


def _learn(library: _Library, lengths: dict[str, int], new: list[str]) -> list[str]:
    """Add the lengths of new units; returns all that was added. Signs that follow the letters of a word are a pre-token of their own, so `word`, `word,` and `word.` are encoded once."""
    parts = {u: u.rstrip(SIGNS) for u in new}
    split = [(u, w, u[len(w) :]) for u, w in parts.items() if len(w) < len(u) and _is_word(w)]
    both = {x for _, w, tail in split for x in (w, tail) if x not in lengths}
    both.update(u for u, w in parts.items() if len(w) == len(u) or not _is_word(w))
    words = [u for u in both if _is_word(u)]
    for i in range(0, len(words), 2048):
        some = words[i : i + 2048]
        lengths.update(zip(some, library.word_lengths(some), strict=True))
    others = [u for u in both if not _is_word(u)]
    for i in range(0, len(others), 4096):
        some = others[i : i + 4096]
        lengths.update(zip(some, library.lengths(some), strict=True))
    lengths.update((u, lengths[w] + lengths[tail]) for u, w, tail in split)
    return [*new, *both]


def count_texts(texts: list[str], path: str, frequent: dict[str, int]) -> list[int]:
    """Tokens of each text. A text that holds a special token's string goes whole to the library, which cuts there.

    A worker's dictionary holds the frequent units for good, and what it met beside them until it is full.
    """
    library = _tokenizer(path)
    if not library.cuttable:
        return [n for i in range(0, len(texts), 256) for n in library.lengths(texts[i : i + 256])]
    known = _caches.get(path)
    if known is None or known["frequent"] is not frequent:
        known = _caches[path] = {"frequent": frequent, "lengths": (known["lengths"] if known else {}) | frequent}
    cut = [None if library.special is not None and library.special.search(t) else UNIT.findall(t) for t in texts]
    met: set[str] = set()
    for units in cut:
        met.update(units or ())
    new = [u for u in met if u not in known["lengths"]]
    if len(known["lengths"]) + len(new) > CACHE_ENTRIES:
        known["lengths"] = dict(frequent)
        new = [u for u in met if u not in frequent]
    lengths = known["lengths"]
    added = _learn(library, lengths, new)
    out = [library.lengths([t])[0] if units is None else sum(map(lengths.__getitem__, units)) for t, units in zip(texts, cut, strict=True)]
    for u in added:
        if len(u) > LONGEST:
            lengths.pop(u, None)
    return out


def _thinned(counts: Counter, most: int) -> tuple[Counter, int]:
    """The counters above the one after the `most` largest, less that one's count, and that count (Misra and Gries): what a unit loses in all is at most the number of units over `most`."""
    less = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -most - 1)[-most - 1])
    return Counter({u: n - less for u, n in counts.items() if n > less}), less


def _summary(batches: Iterator[pd.DataFrame], most: int, counters: int) -> Iterator[pd.DataFrame]:
    """unit, n of a task's units that are at least one in `most`, and a row with null for the number of all units."""
    counts: Counter = Counter()
    total = lost = 0
    for batch in batches:
        for text in batch.iloc[:, 0]:
            for i in range(0, len(text), PIECE):
                units = text[i : i + PIECE].split(" ")  # words with the blank before them; lines' first words are left to the caches
                total += len(units)
                counts.update(units)
                if len(counts) > counters:
                    counts, less = _thinned(counts, counters // 2)
                    lost += less
    own = [(" " + u, n) for u, n in counts.items() if len(u) < LONGEST and (n + lost) * most >= total and u and not SPACES.search(u)]
    if total:
        yield pd.DataFrame([(None, total), *own], columns=["unit", "n"])


def frequent_units(docs: DataFrame, text_col: str, path: str, most: int = FREQUENT, counters: int = COUNTERS) -> dict[str, int]:
    """Lengths of the units that are at least one in `most` of all units of all texts: `most` entries at most.

    A unit that is so frequent in the table is so in some task, so each task hands on only its own frequent units, 2 * `most`
    rows at most. Counts of a unit miss the tasks where it is rare; the table only saves work, no result depends on it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = stored(docs.select(text.alias("t")).mapInPandas(lambda it: _summary(it, most, counters), "unit string, n long"), "unit-summaries")
    total = parts.where("unit is null").agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return {}
    sums = parts.where("unit is not null").groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") * most >= total)
    units = [r["unit"] for r in sums.select("unit").toLocalIterator()]
    return dict(zip(units, _lengths(path, units), strict=True)) if units else {}


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024, into: str = "n_tokens", most: int = FREQUENT) -> DataFrame:
    """Add n_bytes (UTF-8), `into` (tokens as the library gives them, without added special tokens) and over_limit.

    Null text counts as empty: 0 bytes, 0 tokens. Columns of those names are replaced; all others stay. An empty
    table gives an empty table. Very long texts are held whole, one Arrow batch at a time.
    """
    ship(docs.sparkSession)
    frequent = frequent_units(docs, text_col, tokenizer_path, most) if _tokenizer(tokenizer_path).cuttable else {}

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out, at, size = batch.tolist(), [], 0, 0
            for end, text in enumerate(texts, 1):  # a few MB at a time, so that the cut units stay small
                size += len(text)
                if size >= PIECE or end == len(texts):
                    out += count_texts(texts[at:end], tokenizer_path, frequent)
                    at, size = end, 0
            yield pd.Series(out, dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), into: tokens(text)})
    return counted.withColumn("over_limit", F.col(into) > F.lit(limit))
