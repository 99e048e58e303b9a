"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The reference-count table says of each line key in how many documents it stands; adding and deleting documents adds
and subtracts counts, and is exact in any order. Keys that stand in at least `min_docs` documents are hot. Each shard of
keys has a cuckoo filter of its hot keys; updated_filters() inserts keys that turn hot and deletes keys that turn cold, so a
stored filter follows the table. Documents probe the filters. Filters of up to MAX_SENT bytes in all are sent to where the
documents lie, with the few cold keys that they claim by accident, found from the table beforehand. Of larger ones each
stays with its shard, and the documents' keys are dealt to the shards; claims are checked against the table. Either way verdicts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import HOT_KEYS, WS_CHARS, ship, spread_join, stored

#: Bytes of filters and exceptions that may be sent to every task.
MAX_SENT = 64 << 20
#: Hot keys of a shard, about, when its filter is first built; keys of the documents that one task probes, about, where they are dealt.
SHARD_KEYS, PROBED = 500_000, 5_000_000
SLOTS = 4


def line_key(line: str) -> bytes:
    """128 bits of the line, stripped of ASCII white space at both ends, A-Z lower-cased."""
    return xxhash.xxh3_128_digest(line.strip(WS_CHARS).encode("utf-8", "surrogatepass").lower())


class CuckooFilter:
    """Set of 128-bit keys, by 32-bit fingerprints in buckets of four. Deleting is exact for keys that were inserted."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1
        while buckets * SLOTS * 0.85 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = np.maximum((keys[:, 1] >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        first = keys[:, 1] & np.uint64(0xFFFFFFFF) & mask
        return mark, first, first ^ (self._spread(mark) & mask)

    @staticmethod
    def _spread(mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """keys: uint64 of shape (n, 2)."""
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        mark, a, b = self._places(keys)
        rest = np.arange(len(keys))
        for at in (a, b):  # all that find a free slot in their bucket at once, by their place among those that want the bucket
            order = rest[np.argsort(at[rest], kind="stable")]
            first = np.concatenate(([True], at[order[1:]] != at[order[:-1]])) if len(order) else np.zeros(0, bool)
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            free = np.argsort(self.table[at[order]] != 0, axis=1, kind="stable")
            fits = nth < (self.table[at[order]] == 0).sum(1)
            self.table[at[order[fits]], free[fits, nth[fits]]] = mark[order[fits]]
            rest = order[~fits]
        for i in rest:
            if not self._put(mark[i], int(a[i]), int(b[i])):
                raise OverflowError("the filter is full; build it anew with more room")

    def _put(self, mark: np.uint32, a: int, b: int) -> bool:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at, mask = b, len(self.table) - 1
        for step in range(500):
            slot = (int(mark) + step) % SLOTS
            mark, self.table[at, slot] = self.table[at, slot].copy(), mark
            at ^= int(self._spread(np.array([mark]))[0]) & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        for mark, a, b in zip(*self._places(keys), strict=True):
            for at in (int(a), int(b)):
                own = np.flatnonzero(self.table[at] == mark)
                if len(own):
                    self.table[at, own[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        room = len(keys)
        while True:
            made = cls(room)
            try:
                made.insert(keys)
                return made
            except OverflowError:
                room = max(2 * room, 8)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())


def as_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).astype(np.uint64)


def reference_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (16 bytes), n_docs: in how many rows of docs a line of that key stands. Counted in each task first, so a line of all documents sends one row a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.iloc[:, 0]:
                seen.update({line_key(line) for line in text.split("\n")})
                if len(seen) > 300_000:
                    yield pd.DataFrame({"key": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"key": list(seen), "n": list(seen.values())})

    part = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(count, "key binary, n long")
    return part.groupBy("key").agg(F.sum("n").alias("n_docs"))


def changed_counts(counts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The table after documents come and go. Removing what was added gives back the table before. Counts of keys that are removed oftener than they were added end at none."""
    parts = counts.select("key", "n_docs")
    if added is not None:
        parts = parts.unionByName(reference_counts(added, text_col))
    if removed is not None:
        parts = parts.unionByName(reference_counts(removed, text_col).withColumn("n_docs", -F.col("n_docs")))
    return parts.groupBy("key").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


def shard_of(key, shards: int):
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard's hot keys."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [CuckooFilter.of(as_keys(list(pdf["key"]))).to_bytes()]})

    hot = counts.where(F.col("n_docs") >= min_docs).select("key", shard_of(F.col("key"), shards).alias("shard"))
    return hot.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def updated_filters(own: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """shard, filter: the stored filters of the table `before`, with the keys inserted and deleted that turn hot or cold in `after`.

    A shard whose filter gets full is built anew from the table. Only keys whose verdict changes are shuffled to the filters.
    """
    hot = lambda c, name: c.select("key", (F.col("n_docs") >= min_docs).alias(name))
    turned = hot(before, "was").join(hot(after, "now"), "key", "full").select("key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))
    turned = turned.where("was <> now").select(shard_of(F.col("key"), shards).alias("shard"), "key", "now")

    def change(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else keys)["shard"].iloc[0]
        f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(len(keys))
        try:
            if len(keys):
                all_ = as_keys(list(keys["key"]))
                f.delete(all_[~keys["now"].to_numpy(bool)])
                f.insert(all_[keys["now"].to_numpy(bool)])
        except OverflowError:
            return pd.DataFrame({"shard": [shard], "filter": [None]})
        return pd.DataFrame({"shard": [shard], "filter": [f.to_bytes()]})

    made = stored(own.groupBy("shard").cogroup(turned.groupBy("shard")).applyInPandas(change, "shard int, filter binary"), "line-filters")
    full = [r["shard"] for r in made.where("filter IS NULL").select("shard").collect()]
    if not full:
        return made
    return made.where("filter IS NOT NULL").unionByName(filters(after.where(shard_of(F.col("key"), shards).isin(full)), min_docs, shards))


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).byteswap() % np.uint32(shards)  # the first four bytes, big-endian, as shard_of has them


def probe(keys: np.ndarray, sent: dict[int, CuckooFilter], shards: int) -> np.ndarray:
    own, out = _shards(keys, shards), np.zeros(len(keys), bool)
    for s, f in sent.items():
        at = np.flatnonzero(own == s)
        if len(at):
            out[at] = f.contains(keys[at])
    return out


RESULT = "text string, n_lines long, n_dropped long"


def kept_lines(texts: list[str], is_hot, min_chars: int) -> pd.DataFrame:
    """is_hot: from a list of keys to a list of booleans, for all lines of all texts at once."""
    lines = [t.split("\n") for t in texts]
    flat = [x for t in lines for x in t]
    hot = is_hot([line_key(x) for x in flat])
    out, at = [], 0
    for t in lines:
        kept = [x for i, x in enumerate(t) if not (hot[at + i] and len(x.strip(WS_CHARS)) >= min_chars)]
        out.append(("\n".join(kept), len(t), len(t) - len(kept)))
        at += len(t)
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", counts: DataFrame | None = None, own: DataFrame | None = None, shards: int | None = None, max_sent: int = MAX_SENT) -> DataFrame:
    """docs with `text_col` freed of the lines whose key stands in at least min_docs documents, plus n_lines (before) and n_dropped.

    Every row of docs is a document, repeated rows too. Null and empty texts are one empty line. Keys of fewer than
    min_chars code points are never dropped. A text all of whose lines go becomes empty. Columns named n_lines and
    n_dropped are replaced, all others stay. `counts` is the reference-count table to use (default: that of docs), `own` with `shards`
    the filters that belong to it (default: built from it). An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = counts is not None
    counts = counts if given else stored(reference_counts(docs, text_col), "line-counts")
    hot = counts.where(F.col("n_docs") >= min_docs)
    if own is None:
        shards = max(1, -(-hot.count() // SHARD_KEYS))
        own = stored(filters(counts, min_docs, shards), "line-filters")
    verdict = None
    if (own.agg(F.sum(F.octet_length("filter")).alias("n")).first()["n"] or 0) <= max_sent:
        sent = {r["shard"]: bytes(r["filter"]) for r in own.toLocalIterator()}
        # keys of docs that a given table may lack are cold too
        cold = reference_counts(docs, text_col).join(hot, "key", "left_anti") if given else counts.where(F.col("n_docs") < min_docs)
        false = _claimed(cold, sent, shards)
        if false.limit(max_sent // 64 + 1).count() <= max_sent // 64:
            wrong = {bytes(r["key"]) for r in false.toLocalIterator()}
            verdict = docs.withColumn("_kept", _by_filter(sent, wrong, shards, min_chars)(text))
    if verdict is None:
        verdict = _by_route(docs, own, hot, shards, min_chars, text)
    new = {text_col: "text", "n_lines": "n_lines", "n_dropped": "n_dropped"}
    return verdict.select(*[c for c in docs.columns if c not in new], *[F.col("_kept").getField(f).alias(n) for n, f in new.items()])


def _claimed(cold: DataFrame, sent: dict[int, bytes], shards: int) -> DataFrame:
    """The cold keys that a filter takes for hot ones."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {s: CuckooFilter.from_bytes(b) for s, b in sent.items()}
        for batch in batches:
            if len(batch):
                yield batch[probe(as_keys(list(batch["key"])), own, shards)]

    return stored(cold.select("key").mapInPandas(look, "key binary"), "line-exceptions")


def _by_filter(sent: dict[int, bytes], wrong: set[bytes], shards: int, min_chars: int):
    @F.pandas_udf(RESULT)
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = {s: CuckooFilter.from_bytes(b) for s, b in sent.items()}

        def is_hot(keys: list[bytes]) -> list[bool]:
            found = probe(as_keys(keys), own, shards)
            return [h and k not in wrong for h, k in zip(found.tolist(), keys, strict=True)] if wrong else found.tolist()

        for batch in batches:
            yield kept_lines(batch.tolist(), is_hot, min_chars)

    return keep


def _by_route(docs: DataFrame, own: DataFrame, hot: DataFrame, shards: int, min_chars: int, text) -> DataFrame:
    """The way for filters that are too large to send: the keys of each text go to the filter of their shard, and what it claims goes back.

    Keys of more than one in HOT_KEYS of all lines (fewer than HOT_KEYS keys) are answered in place by a list of them, so no shard
    gets a key that gathers. A shard's keys are dealt over as many tasks as PROBED asks, each with a copy of its filter.
    """

    @F.pandas_udf("array<binary>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({line_key(x) for x in t.split("\n")}))

    @F.pandas_udf(RESULT)
    def keep(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, h in zip(texts, found, strict=True):
            some = {bytes(k) for k in h}
            out.append(kept_lines([t], lambda ks, some=some: [k in some for k in ks], min_chars))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"text": [], "n_lines": [], "n_dropped": []})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = None
        for batch in batches:
            mine = batch["filter"].notna().to_numpy()
            cuts = [*np.flatnonzero(mine).tolist(), len(batch)]
            for a, b in zip([0, *cuts], cuts, strict=False):
                if a < b and mine[a]:
                    f, a = CuckooFilter.from_bytes(batch["filter"].iloc[a]), a + 1
                if a < b and f is not None:
                    part = batch.iloc[a:b]
                    yield part.loc[f.contains(as_keys(list(part["key"]))), ["_t", "key"]]

    each = stored(docs.select(F.unhex(F.md5(text)).alias("_t"), F.explode(keys(text)).alias("key")).distinct(), "line-keys")
    n = each.count()
    often = F.broadcast(hot.where(F.col("n_docs") > max(n // HOT_KEYS, 1000)).select("key"))
    dealt = -(-n // (shards * PROBED)) or 1
    asked = each.join(often, "key", "left_anti").select(shard_of(F.col("key"), shards).alias("shard"), F.pmod(F.xxhash64("_t"), F.lit(dealt)).cast("int").alias("part"), F.lit(1).alias("ord"), "_t", "key", F.lit(None).cast("binary").alias("filter"))
    held = own.select("shard", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))).alias("part"), F.lit(0).alias("ord"), F.lit(None).cast("binary").alias("_t"), F.lit(None).cast("binary").alias("key"), "filter")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards * dealt, 100_000))
    claimed = held.unionByName(asked).repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", "ord").mapInPandas(ask, "_t binary, key binary")
    sure = claimed.join(hot.select("key"), "key", "left_semi").unionByName(each.join(often, "key", "left_semi").select("key", "_t"))
    found = sure.groupBy("_t").agg(F.collect_list("key").alias("_hot"))
    return spread_join(docs.withColumn("_t", F.unhex(F.md5(text))), found, "_t", "left").withColumn("_kept", keep(text, F.coalesce("_hot", F.array().cast("array<binary>"))))
