"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by two-dimensional range reporting.

Words are counted where the texts lie, in counters of bounded size, and summed. To find the near words of a word at an edit position, a task holds a block
of words in forward order and in the order of their reversals. What agrees before the position is an interval of the first order, what
agrees after it an interval of the second; a wavelet tree over the reverse ranks in forward order reports the words in both. Words of one
length are one tree, so a report has exactly one free code point.

A word goes to the block of its first letters, which answers the edits behind them, and to the block of its last letters, which answers the others.
Blocks of more than BLOCK words are cut by longer beginnings or endings; an edit that neither side answers then is answered by
grouping on all other letters, which a group of at most the alphabet's size shares. Tasks send a count and the best near word of a word, never pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniteleaf.llm.common import HOT_KEYS, ship, stored

#: Latin-1 bytes of letters, A-Z as a-z; all others blank. Code points above U+00FF are encoded as '?', a blank too.
_LETTERS = bytes((b + 32 if b < 91 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Entries of a task's counter before it is sent.
ENTRIES = 400_000
#: Shared letters of a first block, from the front and from the back: a word of 7 letters with an edit keeps one of the two.
FRONT, BACK = 3, 4
#: Words that a block may have, and words that a task is meant to hold.
BLOCK, TASK = 50_000, 100_000
_NEVER = 1 << 30
#: Queries that go down a tree at once, and pairs that are folded at once.
_QUERIES, _PAIRS = 1 << 19, 1 << 20


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, slips: int | None = None) -> DataFrame:
    """word, n: the runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least `least` code points, and how often they stand in the whole texts.

    With `slips`, letter h % length of a run goes if h, the CRC-32 of '<id>:<run>', is a multiple of it, before the length is
    looked at. Null texts have no words; a null id counts as empty text. Empty tables give none.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                runs = Counter(w for w in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= least)
                if slips is None:
                    total.update(runs)
                else:
                    head = zlib.crc32(doc.encode() + b":")
                    for w, n in runs.items():
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head)
                        if h % slips == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < least:
                                continue
                        total[w] += n
                if len(total) >= ENTRIES:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    own = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _texts(words: Iterable[bytes]) -> pd.Series:
    return pd.Series([w.decode("latin-1") for w in words], dtype=object)


def _counts(total: Counter[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"word": _texts(total), "n": np.fromiter(total.values(), np.int64, len(total))})


class WaveletTree:
    """The numbers 0 to n - 1 in some order, by bits from the highest: reports those of a range of places that lie in a range of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros: list[np.ndarray] = []  # of each level: how many of the first places hold a 0
        level = values
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            level = np.concatenate((level[~one], level[one]))  # zeros first, each part in its old order

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For query q the values in [low, high) at places [first, last), as (q, value) of all queries."""
        q, value = np.arange(len(first)), np.zeros(len(first), np.int64)
        for depth, zeros in enumerate(self.zeros):
            width = 1 << self.bits - 1 - depth
            a, b, many = zeros[first], zeros[last], zeros[-1]
            left = (b > a) & (value + width > low[q]) & (value < high[q])
            right = (last - first > b - a) & (value + width < high[q]) & (value + 2 * width > low[q])
            q = np.concatenate((q[left], q[right]))
            first, last = np.concatenate((a[left], (many + first - a)[right])), np.concatenate((b[left], (many + last - b)[right]))
            value = np.concatenate((value[left], value[right] + width))
        return q, value


class _Order:
    """Rows of letters (0 behind a shorter word) in lexicographic order, of two lengths: `place` of each row, and intervals of shared beginnings by length."""

    def __init__(self, rows: np.ndarray, longer: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0], kind="stable")
        self.place = np.empty(len(rows), np.int64)
        self.place[self.order] = np.arange(len(rows))
        s = rows[self.order]
        self.common = np.empty(max(len(rows) - 1, 0), np.int64)
        for a in range(0, len(self.common), 1 << 16):
            part = slice(a, min(a + (1 << 16), len(self.common)))
            self.common[part] = (s[1:][part] != s[:-1][part]).argmax(1)
        is_long = longer[self.order]
        self.upto = [np.concatenate(([0], np.cumsum(~is_long))), np.concatenate(([0], np.cumsum(is_long)))]
        #: The longest beginning that a row shares with any other.
        self.most = np.zeros(len(rows), np.int64)
        if len(rows) > 1:
            edge = np.concatenate(([0], self.common, [0]))
            self.most[self.order] = np.maximum(edge[:-1], edge[1:])

    def intervals(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the rows that share `length` letters, by place."""
        head = np.flatnonzero(np.concatenate(([True], self.common < length)))
        size = np.diff(np.concatenate((head, [len(self.order)])))
        return np.repeat(head, size), np.repeat(head + size, size)


class _Best:
    """Of each word: how many near words, and the place of the best one by count and then by word."""

    def __init__(self, n: np.ndarray):
        self.n, self.many, self.best = n, np.zeros(len(n), np.int64), np.full(len(n), -1)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, word: np.ndarray, near: np.ndarray) -> None:
        self.waiting.append((word, near))
        self.size += len(word)
        if self.size >= _PAIRS:
            self.fold()

    def fold(self) -> None:
        if not self.size:
            return
        word, near = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        self.many += np.bincount(word, minlength=len(self.n))
        old = np.unique(word)
        old = old[self.best[old] >= 0]
        word, near = np.concatenate((word, old)), np.concatenate((near, self.best[old]))
        order = np.lexsort((near, -self.n[near], word))  # words are numbered in code-point order
        head = order[np.concatenate(([True], word[order][1:] != word[order][:-1]))]
        self.best[word[head]] = near[head]


def near_words(words: list[bytes], n: np.ndarray, front: np.ndarray, back: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words in code-point order and distinct -> of each word the number of near words, and the place of the best (-1: none), by the queries that are this task's.

    Edits at a position of at least `front` are answered where `ahead`, those before it where `behind` if `back` letters follow.
    """
    size = np.array([len(w) for w in words], np.int64)
    found = _Best(n)
    by_size = {int(k): np.flatnonzero(size == k) for k in np.unique(size)}
    for length, short in by_size.items():
        long = by_size.get(length + 1, np.zeros(0, np.int64))
        _one_length(words, length, short, long, front, back, ahead, behind, found)
    found.fold()
    return found.many, found.best


def _one_length(words, length, short, long, front, back, ahead, behind, found: _Best) -> None:
    """Replacements among the words of a length, and insertions that make longer words of them."""
    own = np.concatenate((short, long))
    ns = len(short)
    letters = np.zeros((len(own), length + 1), np.uint8)
    letters[:ns, :length] = np.frombuffer(b"".join([words[i] for i in short]), np.uint8).reshape(ns, length)
    letters[ns:] = np.frombuffer(b"".join([words[i] for i in long]), np.uint8).reshape(len(long), length + 1)
    turned = np.zeros_like(letters)
    turned[:ns, :length] = letters[:ns, length - 1 :: -1] if length else letters[:ns, :0]
    turned[ns:] = letters[ns:, ::-1]
    is_long = np.arange(len(own)) >= ns
    forward, reverse = _Order(letters, is_long), _Order(turned, is_long)
    # row of `own` by its rank among the words of its length, in reverse order; the trees hold these ranks in forward order
    at = [reverse.order[~is_long[reverse.order]], reverse.order[is_long[reverse.order]]]
    trees = []
    for k, mine in enumerate((~is_long, is_long)):
        in_forward = forward.order[mine[forward.order]]
        trees.append(WaveletTree(reverse.upto[k][reverse.place[in_forward]]) if len(in_forward) else None)
    m, r, f, b = front[short], back[short], ahead[short], behind[short]
    pre, suf = forward.most[:ns], reverse.most[:ns]
    for i in range(length + 1):
        answered = (f & (i >= m)) | (b & (i < m) & (length - i >= r))
        u = np.flatnonzero(answered & (pre >= i) & (suf >= length - i))
        # a replacement leaves one letter less behind the position than an insertion
        w = np.flatnonzero(((f & (i >= m)) | (b & (i < m) & (length - 1 - i >= r))) & (pre >= i) & (suf >= length - 1 - i)) if i < length else u[:0]
        if not len(u) and not len(w):
            continue
        fa, fb = forward.intervals(i)
        for k, q, rest in ((1, u, length - i), (0, w, length - 1 - i)):
            if not len(q) or trees[k] is None:
                continue
            ra, rb = reverse.intervals(rest)
            x, y = forward.place[q], reverse.place[q]
            box = forward.upto[k][fa[x]], forward.upto[k][fb[x]], reverse.upto[k][ra[y]], reverse.upto[k][rb[y]]
            least = 1 if k else 2  # a word always finds itself among those of its length
            some = np.flatnonzero((box[1] - box[0] >= least) & (box[3] - box[2] >= least))
            for a in range(0, len(some), _QUERIES):
                part = some[a : a + _QUERIES]
                hit, value = trees[k].report(*(side[part] for side in box))
                one, two = q[part][hit], at[k][value]
                if k:
                    # a letter beside its like can be inserted at several positions: the first counts
                    fresh = letters[two, i] != letters[one, i - 1] if i else np.ones(len(one), bool)
                    one, two = one[fresh], two[fresh]
                    found.add(np.concatenate((own[one], own[two])), np.concatenate((own[two], own[one])))
                else:
                    other = one != two
                    found.add(own[one[other]], own[two[other]])


def _cool(words: DataFrame, name: str, first: int, end, block: int) -> DataFrame:
    """words with `name`: the least of first, 2 * first, 4 * first ... letters of one end that at most `block` words share, or _NEVER where a word is too short for it.

    The list of hot ends has fewer than the words divided by `block` entries, HOT_KEYS at most.
    """
    words, k = words.withColumn(name, F.lit(first)), first
    while True:
        open_ = (F.col(name) == k) & (F.length("word") >= k)
        hot = words.where(open_).groupBy(end(F.col("word"), k).alias("_end")).agg(F.count("*").alias("_many")).where(F.col("_many") > block).select("_end").collect()
        if not hot:
            return words
        ends = F.broadcast(words.sparkSession.createDataFrame(hot, "_end string"))
        longer = F.when(F.length("word") >= 2 * k, 2 * k).otherwise(_NEVER)
        words = words.join(ends, open_ & (end(F.col("word"), k) == F.col("_end")), "left").withColumn(name, F.when(F.col("_end").isNotNull(), longer).otherwise(F.col(name))).drop("_end")
        k *= 2


def _start(word: Column, k: int) -> Column:
    return F.substring(word, 1, k)


def _end(word: Column, k: int) -> Column:
    return F.right(word, F.lit(k))


def _searched(words: DataFrame, parts: int) -> DataFrame:
    """word, n_near, best, best_n of the words with near words, as far as blocks answer; a word can stand twice."""
    block = lambda side, name, end: words.where(F.col(name) <= F.length("word")).select("word", "n", "front", "back", F.lit(side).alias("side"), F.concat(F.lit(side), F.expr(end)).alias("block"))
    entries = block("f", "front", "substring(word, 1, front)").unionByName(block("b", "back", "right(word, back)"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches] or [pd.DataFrame({"word": [], "n": [], "front": [], "back": [], "side": []})])
        if not len(rows):
            return
        names, first, where = np.unique(np.array([w.encode("latin-1") for w in rows["word"]], object), return_index=True, return_inverse=True)
        ahead, behind = (np.bincount(where, rows["side"].to_numpy() == s, len(names)) > 0 for s in "fb")
        n, front, back = (rows[c].to_numpy()[first].astype(np.int64) for c in ("n", "front", "back"))
        many, best = near_words(names.tolist(), n, front, back, ahead, behind)
        got = np.flatnonzero(many)
        for a in range(0, len(got), 1 << 16):
            g = got[a : a + (1 << 16)]
            yield pd.DataFrame({"word": _texts(names[g]), "n_near": many[g], "best": _texts(names[best[g]]), "best_n": n[best[g]]})

    return entries.repartition(parts, "block").select("word", "n", "front", "back", "side").mapInPandas(search, "word string, n_near long, best string, best_n long")


def _grouped(words: DataFrame) -> DataFrame:
    """The same for the edits that no block answers: words grouped by all letters but one, at most the alphabet's size and one shorter word a group."""
    size = F.length("word")
    holes = lambda last, fewer: F.when(F.greatest(F.lit(0), size - F.col("back") + fewer) <= F.least(F.col("front") - 1, last), F.sequence(F.greatest(F.lit(0), size - F.col("back") + fewer), F.least(F.col("front") - 1, last)))
    full = words.select("word", "n", F.explode(holes(size - 1, 0)).alias("i")).select("*", F.expr("concat(substring(word, 1, i), '?', substring(word, i + 2))").alias("p"), F.lit(False).alias("short"), F.expr("i = 0 OR substring(word, i + 1, 1) <> substring(word, i, 1)").alias("fresh"))
    gaps = words.select("word", "n", F.explode(holes(size, 1)).alias("i")).select("*", F.expr("concat(substring(word, 1, i), '?', substring(word, i + 1))").alias("p"), F.lit(True).alias("short"), F.lit(False).alias("fresh"))
    w = Window.partitionBy("p")
    first = F.struct((-F.col("n")).alias("k"), "word", "n")
    all_full, all_fresh, all_short = (F.array_sort(F.collect_list(F.when(c, first)).over(w)) for c in (~F.col("short"), F.col("fresh"), F.col("short")))
    g = full.unionByName(gaps).select("word", "short", "fresh", all_full.alias("a"), all_fresh.alias("b"), all_short.alias("c"))
    others = F.filter(F.when(F.col("short"), F.col("b")).otherwise(F.when(F.col("fresh"), F.concat("a", "c")).otherwise(F.col("a"))), lambda x: x["word"] != F.col("word"))
    o = g.select("word", others.alias("o")).where(F.size("o") > 0).select("word", F.size("o").cast("long").alias("n_near"), F.array_min("o").alias("x"))
    return o.select("word", "n_near", F.col("x.word").alias("best"), F.col("x.n").alias("best_n"))


def near(words: DataFrame, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """words(word, n), each word once, of at least FRONT + BACK letters of Latin-1 -> word, n, n_near, best, best_n: how many words are one edit away, and the most frequent of them (ties: the smallest).

    Words are read several times; hand in a stored table. Null words are not words; an empty table gives an empty table.
    """
    ship(words.sparkSession)
    words = words.where("word IS NOT NULL").select("word", "n")
    many = words.count()
    placed = _cool(_cool(words, "front", FRONT, _start, max(block, many // HOT_KEYS)), "back", BACK, _end, max(block, many // HOT_KEYS))
    parts = max(-(-2 * many // task), min(words.sparkSession.sparkContext.defaultParallelism, -(-many // 2000)), 1)
    got = _searched(placed, parts).unionByName(_grouped(placed.where((F.col("front") > FRONT) | (F.col("back") > BACK))))
    best = F.struct((-F.col("best_n")).alias("k"), "best", "best_n")
    one = got.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
    return words.join(one, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.best").alias("best"), F.col("b.best_n").alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), no null and no circle -> word, root: forms followed to their end, by doubling the steps in each pass. Nothing but the words on a way is joined."""
    way = stored(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        after = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        two = way.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on"))
        way = stored(two, "spelling-ways")
        if way.where("_on").isEmpty():
            return way.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_count: int = 2, ratio: int = 10, slips: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of docs that stand there at least `least_count` times.

    Words as count_words() has them. form is the most frequent near word (ties: the smallest in code-point order) if it is at least `ratio` times as
    frequent, root the end of the forms' chain, or the word itself. Words without a near word have n_near 0 and null form and form_n. A word
    counts once however many rows hold it; texts are read whole, and copies count as often as they stand. Extra columns are not looked at. An empty table gives an empty table.
    """
    if least < FRONT + BACK:
        raise ValueError(f"words need at least {FRONT + BACK} letters")
    words = stored(count_words(docs, id_col, text_col, least, slips).where(F.col("n") >= least_count), "spelling-words")
    good = F.col("best_n") >= ratio * F.col("n")
    found = stored(near(words).select("word", "n", "n_near", F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spelling-near")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
