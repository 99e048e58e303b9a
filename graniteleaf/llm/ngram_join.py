"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, and verification on full n-gram sets.

1. Texts with the same words in the same order form a class of copies; one row stands for them from here on.
2. Each class has band hashes. Of all (rows, bands) whose expected recall at the threshold reaches `recall`, with `rows` given, the fewest bands are taken.
3. Classes that share a band hash compare their signatures, in blocks of at most BLOCK rows, so no bucket is ever one task
   and no bucket emits its pairs: a pair of blocks emits stars, from the least member to the others of each group of
   classes that pairs within five standard errors of the threshold connect. Components of these edges are the groups in which links can lie.
4. Group by group, again in pairs of blocks, all n-gram sets are intersected, and each class gets the number of rows
   linked to it; stars of the links give the near-duplicate classes. Links are counted, never listed, so a group
   of thousands of near copies costs rows in proportion to its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import WS, ship, spread_join, stored
from graniteleaf.llm.components import components
from graniteleaf.llm.textops import Words, chunks, mix

WIDTH, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
BLOCK = 512
#: Keys that are sent to the texts (about 50 MB); of more, the texts are shuffled to the keys.
SENT_KEYS = 500_000


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of `rows` minhashes that pairs at the threshold share with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (k[:n] >> np.uint64(32)).astype(np.uint32), ((k[n:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def signatures(shingles: np.ndarray, offset: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (uint32) of each range of shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offset) - 1, n), np.uint32)
    for j, (a, b) in enumerate(zip(*_hashers(n), strict=True)):
        out[:, j] = np.minimum.reduceat((x ^ a) * b, offset[:-1])
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    out = np.empty((len(sig), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(sig), k + 1, np.uint64)
        for j in range(rows):
            h = mix(h * np.uint64(5) + sig[:, k * rows + j].astype(np.uint64))
        out[:, k] = h
    return out.view(np.int64)


def _encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def word_key(text: Column) -> Column:
    """128 bits of the sequence of words."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(text, f"[{WS}]+", " ")).cast("binary")))


def _keys(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys = batch["id"].to_list(), batch["key"].to_list()
            texts = _encoded(batch["text"])
            for a, b in chunks(texts):
                sh, off = Words(texts[a:b]).shingles(width)
                sig = signatures(sh, off, bands * rows)
                yield pd.DataFrame({"id": ids[a:b], "key": keys[a:b], "sig": [s.tobytes() for s in (sig & np.uint32(255)).astype(np.uint8)], "bands": list(band_hashes(sig, rows))})

    # ids pass through Python as text: pandas would make nulls and long ids doubles
    slim = docs.select(F.col("id").cast("string").alias("id"), word_key(F.col("text")).alias("key"), "text")
    return slim.mapInPandas(make, "id string, key binary, sig binary, bands array<long>").withColumn("id", F.col("id").cast("long"))


def _blocks(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Each row of a group of `size` rows once for each pair of blocks it takes part in: columns i <= j, and `side` (its own block).

    A row's block is a hash of its key, so no task has to number a group.
    """
    many = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("key"), many).cast("int"))
    other = F.explode(F.sequence(F.lit(0), many - 1))
    return rows.withColumn("_o", other).withColumns({"i": F.least("side", "_o"), "j": F.greatest("side", "_o")}).drop("_o")


def _runs(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by cols, whole, whatever the batches."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        c = batch[cols].to_numpy()
        cuts = [0, *(np.flatnonzero((c[1:] != c[:-1]).any(1)) + 1), len(batch)]
        if rest and (c[0] != rest[0][cols].to_numpy()[0]).any():
            yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
            rest = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            part = batch.iloc[a:b]
            yield pd.concat([*rest, part], ignore_index=True) if rest else part
            rest = []
        rest.append(batch.iloc[cuts[-2] :])
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)


def _least(label: np.ndarray, row: int, near: np.ndarray) -> None:
    """Join the groups of a row and of the rows near it; a group is labelled by its least row."""
    own = label[near]
    least = min(int(own.min()), int(label[row]))
    if own.max() != least or label[row] != least:
        label[np.isin(label, np.append(own, label[row]))] = least


def _stars(keys: list[bytes], label: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Edges from each group's least key to its others: the same edges whichever bucket or block finds the group."""
    rest = np.flatnonzero(label != np.arange(len(label))).tolist()
    return [keys[label[k]] for k in rest], [keys[k] for k in rest]


def _sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    side = part["side"].to_numpy()
    if part["i"].iloc[0] == part["j"].iloc[0]:
        own = np.arange(len(part))
        return own, own
    return np.flatnonzero(side == part["i"].iloc[0]), np.flatnonzero(side == part["j"].iloc[0])


def alike(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Edges (a, b) that join, in each pair of blocks of a bucket, the groups of classes whose signatures agree in enough places."""
    a, b = [], []
    for part in _runs(batches, ["band", "i", "j"]):
        part = part.sort_values("key")
        keys = part["key"].to_list()
        sig = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
        left, right = _sides(part)
        label = np.arange(len(part))
        for s in range(0, len(left), 64):
            own = left[s : s + 64]
            near = (sig[own][:, None, :] == sig[right][None, :, :]).sum(2) >= least * sig.shape[1]
            for row, flags in zip(own.tolist(), near, strict=True):
                if flags.any():
                    _least(label, row, right[flags])
        x, y = _stars(keys, label)
        a += x
        b += y
        if len(a) > 20_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": a, "b": b})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from the columns that at least two sets share, 2,048 at a time."""
    n = len(sets)
    if n == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    col = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
    shared = np.bincount(col) > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], place[col[keep]]
    out = np.zeros((n, n), np.float32)
    for start in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(col, [start, start + 2048])
        m = np.zeros((n, 2048), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        out += m @ m.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def links(batches: Iterator[pd.DataFrame], width: int, threshold: float) -> Iterator[pd.DataFrame]:
    """For each class of a pair of blocks: the rows linked to it there (`n`), and stars of the links (`other`)."""
    out: list[tuple] = []
    for part in _runs(batches, ["grp", "i", "j"]):
        part = part.sort_values("key")
        keys, copies = part["key"].to_list(), part["copies"].to_numpy()
        sets = []
        texts = _encoded(part["text"])
        for a, b in chunks(texts):
            sh, off = Words(texts[a:b]).shingles(width)
            sets += [np.unique(sh[p:q]) for p, q in zip(off[:-1], off[1:], strict=True)]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets) if len(sets) > 1 else size[:, None]
        near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(near, False)
        left, right = _sides(part)
        if left is not right:
            mask = np.zeros_like(near)
            mask[np.ix_(left, right)] = True
            near &= mask | mask.T
        n = near @ copies
        out += [(keys[k], int(n[k]), None) for k in np.flatnonzero(n)]
        label = np.arange(len(keys))
        for row in np.flatnonzero(near.any(1)).tolist():
            _least(label, row, np.flatnonzero(near[row]))
        out += [(p, 0, q) for p, q in zip(*_stars(keys, label), strict=True)]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["key", "n", "other"])
            out = []
    yield pd.DataFrame(out, columns=["key", "n", "other"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: id_col, class_id, n_links, key.

    A link joins two rows whose sets of `width`-word shingles have a Jaccard similarity of `threshold` or more; words are runs
    without ASCII white space, as they stand. class_id is the least id among the rows that links connect (null where all
    ids are null), n_links counts a row's links, copies included, `key` identifies its sequence of words. A text of fewer than
    `width` words has one shingle of all its words; null and blank texts are copies of each other. Rows are told apart
    by text, not by id: repeated rows and repeated or null ids are rows like others. Extra columns are not read. An
    empty table gives an empty table.
    """
    ship(docs.sparkSession)
    bands = bands_for(threshold, recall, rows)
    total = bands * rows
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = stored(_keys(ids, width, bands, rows), "join-keys")
    classes = stored(keyed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "join-classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = banded.join(full, "band").join(classes.select("key", "sig"), "key")
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / total)
    cut = _blocks(met, "band", "n").repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    edges = cut.mapInPandas(lambda it: alike(it, least), "a binary, b binary").distinct()
    groups = components(edges)
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = stored(groups.join(sizes, "root").select(F.col("node").alias("key"), F.col("root").alias("grp"), "n"), "join-groups")
    # one text of each class, taken map-side first, so that a class with many copies does not gather in one task
    texts = ids.select(word_key(F.col("text")).alias("key"), "text")
    if members.count() <= SENT_KEYS:
        texts = texts.join(F.broadcast(members.select("key")), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    texts = texts.join(members, "key").join(classes.select("key", "copies"), "key")
    cut = _blocks(texts, "grp", "n").repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = stored(cut.mapInPandas(lambda it: links(it, width, threshold), "key binary, n long, other binary"), "join-links")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "id", "copies").join(counts, "key", "left").join(roots, F.col("key") == F.col("node"), "left")
    named = stored(named.select("key", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "join-named")
    least_id = named.groupBy("root").agg(F.min("id").alias("class_id"))
    named = spread_join(named, least_id, "root").select("key", "class_id", "n_links")
    return spread_join(keyed.select(F.col("id").alias(id_col), "key"), named, "key").select(id_col, "class_id", "n_links", "key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the least id (null ids last), of several such rows one.

    All columns stay. In a class without any id one row of each sequence of words stays. Nulls, repeated rows, empty
    tables and very long texts (which are compared whole) as in join().
    """
    each = join(docs, id_col, text_col, **how).groupBy("key", F.col(id_col).cast("long").alias("_least")).agg(F.first("class_id").alias("_class"), F.count("*").alias("_n"))
    each = stored(each, "join-each")
    stays = F.col("_least").eqNullSafe(F.col("_class"))  # the key's rows of that id
    rows = docs.select(F.struct("*").alias("_all"), F.col(id_col).cast("long").alias("_i"), word_key(F.coalesce(F.col(text_col), F.lit(""))).alias("_k"))
    same = (F.col("_k") == F.col("key")) & F.col("_i").eqNullSafe(F.col("_least"))
    # rows alike in key and id: any one of them
    once = lambda r: r.groupBy("_k", "_i").agg(F.first("_all").alias("_all")).select("_all", "_i", "_k")
    gone, twice = (each.where(c).select("key", "_least") for c in (~stays, stays & (F.col("_n") > 1)))
    if gone.count() + twice.count() <= SENT_KEYS:
        rows = rows.join(F.broadcast(gone), same, "left_anti")
        if not twice.isEmpty():
            rows = rows.join(F.broadcast(twice), same, "left_anti").unionByName(once(rows.join(F.broadcast(twice), same, "left_semi")))
    else:  # met by key and id together, so that the copies of a text do not gather in one task
        rows = once(rows.join(each.where(stays).select("key", "_least"), same, "left_semi"))
    return rows.select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])
