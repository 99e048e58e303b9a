"""Benchmark decontamination by latent semantic retrieval.

Words (A-Z lower-cased, ASCII punctuation dropped) are hashed to SLOTS slots with inverse document frequencies over all
passages of PASSAGE words of all texts, and on to BUCKETS signed features. A randomised SVD of the TF-IDF passages (every
partition adds up its share of A'A Omega, once for each power iteration) gives DIMS latent directions. Every window of
WINDOW words of every text, at half-window steps, is folded in and compared by cosine with the segments of all benchmark items. What
is near enough is checked by the longest common subsequence of the item and the words around the window, and for
middling ones by the item's answer, which must stand there word for word. What the cosine leaves out goes by exact routes to the same check:
a common subsequence of `sure` of an item's words has at least so many of its rarest words (Items.fewest), so a
window with fewer of them around it is no sure match; others need the answer, which is looked up by its first words. Texts are cut to words twice, for the passages' slots (stored) and for the
search, where they lie; only sums of fixed size are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import ship, stored
from graniteleaf.llm.sums import PARTS, summed
from graniteleaf.llm.textops import Words, chunks, mix

SLOTS, BUCKETS, DIMS, EXTRA = 1 << 16, 1024, 64, 16
PASSAGE, WINDOW = 256, 32
COSINE, SURE, LIKELY = 0.45, 0.7, 0.5
ANSWER_WORDS = 5
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SLICE = 4096
#: Occurrences of rare words of some items that are looked at together, and pairs of windows and items.
_SHARED, _CHECKED = 1 << 20, 1 << 13
#: Products of windows and item segments that are held at once, and items whose word places are kept for the common subsequence.
_CELLS, _MASKS = 1 << 24, 4096


def plain(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower().translate(None, _PUNCTUATION)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _features() -> tuple[np.ndarray, np.ndarray]:
    """Of each slot: its bucket and its sign."""
    h = mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(77))
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[Words]:
    for batch in batches:
        texts = [plain(t) for t in batch.iloc[:, -1]]
        for a, b in chunks(texts):
            yield Words(texts[a:b])


def passages(docs: DataFrame) -> DataFrame:
    """slots (two bytes a word) of each passage of PASSAGE words of docs(text); a text's last passage may be short. Stored, as three passes read it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w in _batches(batches):
            s = _slots(w.hash).astype(np.uint16)
            ends = zip(w.offset[:-1].tolist(), w.offset[1:].tolist(), strict=True)
            yield pd.DataFrame({"slots": [s[i : min(i + PASSAGE, q)].tobytes() for p, q in ends for i in range(p, q, PASSAGE)]})

    return stored(docs.mapInPandas(cut, "slots binary"), "passages")


def _passage_slots(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The slots of some thousand passages together, the passage of each, and their number."""
    for batch in batches:
        rows = batch["slots"].tolist()
        for i in range(0, len(rows), 2048):
            some = rows[i : i + 2048]
            yield np.frombuffer(b"".join(some), np.uint16).astype(np.int64), np.repeat(np.arange(len(some)), [len(r) // 2 for r in some]), len(some)


def idf(cut: DataFrame) -> np.ndarray:
    """ln((1 + passages) / (1 + passages with the slot)) over all passages()."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(SLOTS), 0
        for s, p, many in _passage_slots(batches):
            n += many
            own = np.sort((p * SLOTS + s).astype(np.int32))  # 2,048 passages: under 2**27
            df += np.bincount(own[np.concatenate(([True], own[1:] != own[:-1]))] % SLOTS, minlength=SLOTS)
        yield pd.DataFrame({"place": [-1, *range(SLOTS // _SLICE)], "row": [np.array([float(n)]), *df.reshape(-1, _SLICE)]})

    got = summed(cut.mapInPandas(count, PARTS))
    if not got:
        return np.zeros(SLOTS, np.float32)
    df = np.concatenate([got[i] for i in range(SLOTS // _SLICE)])
    return np.log((1 + got[-1][0]) / (1 + df)).astype(np.float32)


def directions(cut: DataFrame, weights: np.ndarray, powers: int = 1, seed: int = 5) -> np.ndarray:
    """Latent directions (BUCKETS x DIMS), each scaled to unit variance over the passages(): a randomised SVD with `powers` + 1 passes."""
    bucket, sign = _features()
    scaled = weights * sign

    def product(basis: np.ndarray):
        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(basis.shape)
            for s, p, many in _passage_slots(batches):
                a = np.bincount(p * BUCKETS + bucket[s], scaled[s], many * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-6)
                out += a.T @ (a @ basis)
            yield pd.DataFrame({"place": np.arange(BUCKETS // 64), "row": list(out.reshape(BUCKETS // 64, -1))})

        return f

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(BUCKETS, DIMS + EXTRA)))[0].astype(np.float32)
    for last in [False] * powers + [True]:
        got = summed(cut.mapInPandas(product(basis), PARTS))
        if not got:
            return np.zeros((BUCKETS, DIMS), np.float32)
        y = np.concatenate([got[i].reshape(64, -1) for i in range(BUCKETS // 64)])
        if not last:
            basis = np.linalg.qr(y)[0].astype(np.float32)
    # Rayleigh-Ritz: the eigenvectors of A'A within the basis
    values, vectors = np.linalg.eigh((basis.T @ y + (basis.T @ y).T) / 2)
    top = np.argsort(values)[::-1][:DIMS]
    scale = 1 / np.sqrt(np.maximum(values[top], 1e-9 * max(values.max(), 1e-9)))
    return ((basis @ vectors[:, top]) * scale / scale.max()).astype(np.float32)


def answer_of(text: str) -> str:
    """Without an answer column: the item's last sentences, as few as hold ANSWER_WORDS words."""
    words = text.split()
    for i in range(len(words) - ANSWER_WORDS, 0, -1):
        if words[i - 1][-1:] in ".!?":
            return " ".join(words[i:])
    return text


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, by where it begins."""
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(3) + h[i : len(h) - size + 1 + i])
    return out


class Items:
    """A block of benchmark items: segments in latent space, word hashes, answers, and the items of each rare word."""

    def __init__(self, rows: list[tuple[int, str, str]], table: np.ndarray, weights: np.ndarray, likely: float, sure: float = SURE):
        w = Words([plain(t) for _, t, _ in rows])
        a = Words([plain(t) for _, _, t in rows])
        self.ids = [r[0] for r in rows]
        self.words = [w.hash[p:q] for p, q in zip(w.offset[:-1], w.offset[1:], strict=True)]
        self.answers = [a.hash[p:q] for p, q in zip(a.offset[:-1], a.offset[1:], strict=True)]
        vectors, self.owner = [], []
        for k, own in enumerate(self.words):
            cuts = list(range(0, max(len(own) - WINDOW // 2, 1), WINDOW))
            if len(own) > WINDOW:
                cuts[-1] = len(own) - WINDOW
            for c in cuts if len(own) else []:
                vectors.append(table[_slots(own[c : c + WINDOW])].sum(0))
                self.owner.append(k)
        v = np.array(vectors, np.float32).reshape(-1, DIMS)
        self.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).T.copy()
        self.owner = np.array(self.owner, np.int64)
        self.segment = np.searchsorted(self.owner, np.arange(len(self.words) + 1))
        self.long = np.array([len(own) for own in self.words], np.int64)
        self._rare(weights, max(sure, likely))
        self._answers()
        self.least, self.most = (np.maximum(np.ceil(part * self.long - 1e-9), 1).astype(np.int64) for part in (likely, max(sure, likely)))
        self.known, where = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]), return_inverse=True)
        self.place = np.split(where, np.cumsum(self.long)[:-1]) if len(self.long) else []
        self.masks: dict[int, dict[int, int]] = {}

    def _answers(self) -> None:
        """For each size up to ANSWER_WORDS the items whose answers begin with a run of so many words, by a hash of that run."""
        self.asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = np.array([min(len(a), ANSWER_WORDS) for a in self.answers], np.int64)
        for g in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == g)
            keys = np.array([_runs(self.answers[k][:g], g)[0] for k in own], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.asked[g] = keys[order], own[order]

    def _rare(self, weights: np.ndarray, part: float) -> None:
        """Of each item the rarest words, all but at most two thirds of the `part` that a sure match has, in the items' order; `fewest` of them stand in any sure match."""
        self.fewest, rare = np.ones(len(self.words), np.int64), []
        for k, own in enumerate(self.words):
            least = max(int(np.ceil(part * len(own) - 1e-9)), 1)
            h, times = np.unique(own, return_counts=True)
            order = np.argsort(-weights[_slots(h)], kind="stable")
            rest = len(own) - np.cumsum(times[order])
            used = order[: int(np.argmax(rest <= least * 2 // 3)) + 1]
            if len(used):
                self.fewest[k] = max(least - int(rest[len(used) - 1]), 1)
            rare += [(h[i], k, times[i]) for i in used]
        self.rare, self.rare_word = np.unique(np.array([r[0] for r in rare], np.uint64), return_inverse=True)
        self.rare_item, self.rare_times = (np.array([r[i] for r in rare], np.int64) for i in (1, 2))
        self.maybe = np.zeros(SLOTS, bool)
        self.maybe[_slots(self.rare)] = True

    def around(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows (as _window_vectors numbers them, ascending) and items, all pairs that can meet the rule: around the window stand as many of the item's words as a sure
        match has, rare ones among them, or the answer and as many words as a likely match has.

        Items are taken a few at a time, so that the occurrences of their rare words (or answers) are at most _SHARED, or those of one item: memory does not grow with the items.
        """
        if not len(w.hash) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # where the whole words of items stand
        known = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
        where = np.flatnonzero(self.known[known] == w.hash)
        spots = np.sort(known[where] * (len(w.hash) + 1) + where)
        pairs = np.unique(np.concatenate([*self._surely(w, spots), *self._answered(w, spots), np.zeros(0, np.int64)]))
        return pairs // len(self.long), pairs % len(self.long)

    def _surely(self, w: Words, spots: np.ndarray) -> Iterator[np.ndarray]:
        at = np.flatnonzero(self.maybe[_slots(w.hash)])
        v = np.minimum(np.searchsorted(self.rare, w.hash[at]), len(self.rare) - 1)
        at, v = at[self.rare[v] == w.hash[at]], v[self.rare[v] == w.hash[at]]
        at, many = at[np.argsort(v, kind="stable")], np.bincount(v, minlength=len(self.rare))
        begin = np.cumsum(many) - many
        met = np.flatnonzero(many[self.rare_word])
        size, item = np.cumsum(many[self.rare_word[met]]), self.rare_item[met]
        a = 0
        while a < len(met):
            b = int(np.searchsorted(size, (size[a - 1] if a else 0) + _SHARED, "right"))
            # whole items, one at least
            b = max(int(np.searchsorted(item, item[min(b, len(item) - 1)], "left")) if b < len(item) else b, int(np.searchsorted(item, item[a], "right")))
            entries, a = met[a:b], b
            word = self.rare_word[entries]
            n = many[word]
            entry = np.repeat(entries, n)
            places = at[np.repeat(begin[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield self._windows(w, places, self.rare_item[entry], self.rare_times[entry], entry, self.fewest, self.most, spots)

    def _answered(self, w: Words, spots: np.ndarray) -> Iterator[np.ndarray]:
        for g, (keys, items) in self.asked.items():
            if len(w.hash) < g:
                continue
            run = _runs(w.hash, g)
            low, high = np.searchsorted(keys, run, "left"), np.searchsorted(keys, run, "right")
            at = np.flatnonzero(high > low)
            size = np.cumsum((high - low)[at])
            a = 0
            while a < len(at):
                b = max(int(np.searchsorted(size, (size[a - 1] if a else 0) + _SHARED, "right")), a + 1)
                p, a = at[a:b], b
                n = (high - low)[p]
                k = items[np.repeat(low[p] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                yield self._windows(w, np.repeat(p, n), k, np.ones(len(k), np.int64), k, np.ones(len(self.long), np.int64), self.least, spots)

    def _windows(self, w: Words, at: np.ndarray, k: np.ndarray, times: np.ndarray, entry: np.ndarray, fewest: np.ndarray, least: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Windows and items (window * items + item) with at least fewest[item] of the occurrences `at` (each `times`; those of one entry count once) and least[item] words of the item around the window."""
        none = np.zeros(0, np.int64)
        # by item and place: from each occurrence on, as many rare words as the item needs must follow within what a window can see
        key = k * len(w.hash) + at
        order = np.argsort(key)
        at, k, times, entry, key = at[order], k[order], times[order], entry[order], key[order]
        weight = np.concatenate(([0], np.cumsum(times)))
        until = np.searchsorted(key, np.minimum(key + 2 * self.long[k] + WINDOW, (k + 1) * len(w.hash)))
        begins = np.flatnonzero(weight[until] - weight[:-1] >= fewest[k])
        if not len(begins):
            return none
        seen = np.zeros(len(at) + 1, np.int64)
        np.add.at(seen, begins, 1)
        np.add.at(seen, until[begins], -1)
        fine = np.cumsum(seen)[:-1] > 0
        at, k, times, entry = at[fine], k[fine], times[fine], entry[fine]
        text = np.searchsorted(w.offset, at, "right") - 1
        step, place = WINDOW // 2, at - w.offset[text]
        blocks = -(-np.diff(w.offset) // step)
        first = np.cumsum(blocks) - blocks
        # the windows that have the word within their region: start - long <= place < start + WINDOW + long
        low = np.maximum((place - WINDOW - self.long[k]) // step + 1, 0)
        high = np.minimum((place + self.long[k]) // step, blocks[text] - 1)
        # a word that stands there repeatedly counts once: each occurrence leaves out the windows of the one before it
        order = np.argsort(entry, kind="stable")
        again = (entry[order[1:]] == entry[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        low[order[1:][again]] = np.maximum(low[order[1:]], high[order[:-1]] + 1)[again]
        n = np.maximum(high - low + 1, 0)
        window = np.repeat(first[text] + low - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair, own = np.unique(window * len(self.long) + np.repeat(k, n), return_inverse=True)
        pair = pair[np.bincount(own, np.repeat(times, n)) >= fewest[pair % len(self.long)]]
        window, k = pair // len(self.long), pair % len(self.long)
        # last all of the item's words: as many as a common subsequence needs must stand around the window
        text = np.searchsorted(first, window, "right") - 1
        start = w.offset[text] + (window - first[text]) * step
        a, b = np.maximum(w.offset[text], start - self.long[k]), np.minimum(w.offset[text + 1], start + WINDOW + self.long[k])
        good = np.zeros(len(k), bool)
        for p in range(0, len(k), _CHECKED):
            q = slice(p, p + _CHECKED)
            long = self.long[k[q]]
            words = np.concatenate([self.place[i] for i in k[q].tolist()]) * (len(w.hash) + 1)
            owner = np.repeat(np.arange(len(long)), long)
            there = np.searchsorted(spots, words + a[q][owner]) < np.searchsorted(spots, words + b[q][owner])
            good[q] = np.bincount(owner, there, len(long)) >= least[k[q]]
        return pair[good]

    def lcs(self, k: int, region: np.ndarray) -> int:
        """Length of the longest common subsequence of item k and the region, by one long addition a word."""
        if k not in self.masks:
            if len(self.masks) > _MASKS:
                self.masks = {}
            self.masks[k] = {}
            for i, h in enumerate(self.words[k].tolist()):
                self.masks[k][h] = self.masks[k].get(h, 0) | 1 << i
        m, full = self.masks[k], (1 << len(self.words[k])) - 1
        v = full
        for h in region.tolist():
            if h in m:
                u = v & m[h]
                v = ((v + u) | (v - u)) & full
        return len(self.words[k]) - v.bit_count()

    def answered(self, k: int, region: np.ndarray) -> bool:
        a = self.answers[k]
        return len(a) > 0 and any((region[i : i + len(a)] == a).all() for i in np.flatnonzero(region[: len(region) - len(a) + 1] == a[0]))


def _table(weights: np.ndarray, latent: np.ndarray) -> np.ndarray:
    bucket, sign = _features()
    return latent[bucket] * (weights * sign)[:, None]


def _window_vectors(w: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of all windows, and each one's text and first word (within the chunk)."""
    n, step = np.diff(w.offset), WINDOW // 2
    blocks = -(-n // step)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(w.offset[:-1], blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * step
    text = np.repeat(np.arange(len(n)), blocks)
    part = np.empty((len(starts), DIMS), np.float32)
    for a in range(0, len(starts), 512):
        own = starts[a : a + 512]
        end = starts[a + 512] if a + 512 < len(starts) else w.offset[-1]
        np.add.reduceat(table[_slots(w.hash[own[0] : end])], own - own[0], axis=0, out=part[a : a + 512])
    both = np.concatenate((text[1:] == text[:-1], [False])) if len(text) else np.zeros(0, bool)
    out = part.copy()
    out[np.flatnonzero(both)] += part[np.flatnonzero(both) + 1]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out, text, starts


def leaks(texts: list[str], items: Items, table: np.ndarray, cosine: float, sure: float, likely: float) -> list[tuple[int, int, float, float, bool]]:
    """(place of the text, place of the item, cosine, common share, answered) of all leaks."""
    raw = [plain(t) for t in texts]
    out = []
    for a, b in chunks(raw):
        w = Words(raw[a:b])
        if not len(w.hash) or not len(items.owner):
            continue
        vectors, text, starts = _window_vectors(w, table)
        sharing, shared = items.around(w)
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        step = min(max(_CELLS // len(items.owner), 1), 4096)
        for s in range(0, len(vectors), step):
            near = vectors[s : s + step] @ items.vectors
            rows = np.flatnonzero(near.max(1) >= cosine)
            x, y = np.nonzero(near[rows] >= cosine)
            x = rows[x]
            own = slice(*np.searchsorted(sharing, [s, s + step]))
            x, y = np.concatenate((x, sharing[own] - s)), np.concatenate((y, [items.segment[k] + near[i - s, items.segment[k] : items.segment[k + 1]].argmax() for i, k in zip(sharing[own], shared[own], strict=True)])).astype(np.int64)
            seen = set()
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                k, at = int(items.owner[j]), s + i
                if (at, k) in seen:
                    continue
                seen.add((at, k))
                t, long = int(text[at]), len(items.words[k])
                region = w.hash[max(w.offset[t], starts[at] - long) : min(w.offset[t + 1], starts[at] + WINDOW + long)]
                if len(region) < likely * long:
                    continue
                share = items.lcs(k, region) / long
                if share < likely:
                    continue
                answered = items.answered(k, region)
                if share >= sure or answered:
                    best[t, k] = max(best.get((t, k), (0.0, 0.0, False)), (share, float(near[i, j]), answered))
        out += [(a + t, k, c, share, ans) for (t, k), (share, c, ans) in best.items()]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, cosine: float = COSINE, sure: float = SURE, likely: float = LIKELY, block: int = 50_000, carry: bool = False) -> DataFrame:
    """One row for each row of docs and each benchmark item that it holds: id_col, item_id, cosine, common (share of the item's words in the longest common subsequence), answered.

    A text holds an item if around one of its windows the common subsequence has at least `sure` of the item's words, or at
    least `likely` and the answer stands there too; every such pair is found, whatever its cosine. Items are taken in blocks of `block` (what a worker holds, some 75 MB); each block
    reads the texts once. Null and blank texts or items match nothing; repeated rows of docs give repeated rows,
    repeated items (by id) one row each. Null ids stay null. With `carry` the result is docs without the rows that hold an item,
    all columns and repeated rows kept. Empty tables give an empty table (with `carry`: docs).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ship(docs.sparkSession)
    cut = passages(docs.select(text.alias("text")))
    weights = idf(cut)
    latent = directions(cut, weights)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer")).where(F.coalesce(F.trim("text"), F.lit("")) != "")

    def blocks() -> Iterator[list[tuple[int, str, str]]]:
        rows = []
        for r in items.toLocalIterator():
            rows.append((r["item"], r["text"], r["answer"] if r["answer"] is not None else answer_of(r["text"])))
            if len(rows) == block:
                yield rows
                rows = []
        if rows:
            yield rows

    found, kept = None, docs
    for rows in blocks():
        sent = docs.sparkSession.sparkContext.broadcast((uuid4().hex, rows, weights, latent, likely, sure))
        if carry:
            kept = kept.where(~_holds(sent, cosine, sure, likely)(F.coalesce(F.col(text_col), F.lit(""))))
            continue
        own = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).mapInPandas(_search(sent, cosine, sure, likely), "id string, item_id long, cosine double, common double, answered boolean")
        found = own if found is None else found.unionByName(own)
    if carry:
        return kept
    if found is None:
        found = docs.sparkSession.createDataFrame([], "id string, item_id long, cosine double, common double, answered boolean")
    return found.select(F.col("id").cast("long").alias(id_col), "item_id", "cosine", "common", "answered")


_kept: tuple[str, np.ndarray, Items] | None = None


def _prepared(sent) -> tuple[np.ndarray, Items]:
    """The slots' latent vectors and the items of a block; a worker keeps the last ones between its tasks."""
    global _kept
    key, rows, weights, latent, likely, sure = sent.value
    if _kept is None or _kept[0] != key:
        table = _table(weights, latent)
        _kept = key, table, Items(rows, table, weights, likely, sure)
    return _kept[1:]


def _search(sent, cosine: float, sure: float, likely: float):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, items = _prepared(sent)
        for batch in batches:
            ids = batch["id"].to_list()
            got = leaks(batch["text"].to_list(), items, table, cosine, sure, likely)
            yield pd.DataFrame([(ids[t], items.ids[k], c, share, ans) for t, k, c, share, ans in got], columns=["id", "item_id", "cosine", "common", "answered"])

    return f


def _holds(sent, cosine: float, sure: float, likely: float):
    @F.pandas_udf("boolean")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, items = _prepared(sent)
        for batch in batches:
            bad = {t for t, *_ in leaks(batch.to_list(), items, table, cosine, sure, likely)}
            yield pd.Series([i in bad for i in range(len(batch))], dtype="bool")

    return f
