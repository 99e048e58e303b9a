"""Language of words and texts by a linear-chain conditional random field.

A word's features are its beginnings and endings, its runs of one to three letters and its share of the languages in a lexicon; all but the
lexicon are hashed to SLOTS weights a language. Transitions between languages are learnt with them, from texts in one language and from texts spliced of pieces in
several. Training maximises the likelihood of the labels: each task runs forward-backward over its sequences and adds up a gradient of fixed size, the driver takes
L-BFGS steps. A text's words are labelled by forward-backward over the whole text, so switches inside it are found; its language is the one
expected for most of its words.

Only a bounded sample of labelled texts is learnt from (`sample_bytes` a language); every word of every text is labelled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import label_hash, ship, stored
from graniteleaf.llm.sums import PARTS, summed
from graniteleaf.llm.textops import chunks

UNKNOWN = "und"
SLOTS, SLICE = 1 << 15, 1 << 12
#: Words of a piece of training text, and pieces that are spliced to a sequence.
PIECE, SPLICED, BUCKETS = (4, 32), 4, 64
#: A lexicon word is at least one in LEXICON of the words of a language's sample, so a language has that many at most.
LEXICON, SEEN = 50_000, 3
#: Words of a sequence that are stepped through while other sequences wait for none.
STEP = 64
#: Words that a worker's cache holds before it starts anew, and the longest that it holds.
CACHE_WORDS, LONGEST = 400_000, 64
_SEQUENCES = 512
#: A-Z become a-z; ASCII signs, digits and control characters blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(text: str) -> list[bytes]:
    """Words as they are looked up; some hold no letter (signs beyond ASCII)."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def letters(token: bytes) -> str:
    return "".join(c for c in token.decode("utf-8", "replace").lower() if c.isalpha())


class _Slots(dict):
    """Slot of each feature; a feature is hashed once until there are too many."""

    def __missing__(self, feature: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[feature] = got = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS
        return got


_slots = _Slots()


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Slots of a word's features: affixes and n-grams to three letters, and its lexicon entries."""
    n = len(word)
    own = ["^" + word[:1], "^" + word[:2], "^" + word[:3], word[-1:] + "$", word[-2:] + "$", word[-3:] + "$", *word, *[word[i : i + 2] for i in range(n - 1)], *[word[i : i + 3] for i in range(n - 2)]]
    return [_slots[x] for x in own] + lexicon.get(word, [])


def lexicon_slots(share: dict[str, float]) -> list[int]:
    """Features of a lexicon word: each language with its share of the word's occurrences, in three steps."""
    return [_slots[f"lexicon {lang} {step}"] for lang, s in sorted(share.items()) for step in (0.3, 0.7, 0.95) if s >= step]


def chain(scores: np.ndarray, offset: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Forward-backward over sequences at once: the probability of each label at each place, the expected moves (with `pairs`), and the sum of log Z.

    scores: log potentials of all places; sequence i is offset[i] to offset[i + 1], not empty. Sequences are cut into stretches of
    STEP places. Those of one sequence are linked by products of matrices first, so that all stretches are then stepped through together.
    """
    total, width = scores.shape
    top = scores.max(1)
    p, t = np.exp(scores - top[:, None]), np.exp(moves - moves.max())
    many = -(-np.diff(offset) // STEP)
    seq = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(seq)) - (np.cumsum(many) - many)[seq]
    begin = offset[seq] + nth * STEP
    size = np.minimum(STEP, offset[seq + 1] - begin)
    # long stretches first: at each step the ones that still run are a prefix
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    seq, nth, begin, size = seq[order], nth[order], begin[order], size[order]
    running = np.searchsorted(-size, -np.arange(STEP), "left")
    first = nth == 0
    enter, leave = np.empty((len(seq), width)), np.ones((len(seq), width))
    log_start = float(start.max())
    enter[first] = np.exp(start - log_start)
    linked = np.flatnonzero((many > 1)[seq])
    if len(linked):
        product = np.broadcast_to(np.eye(width), (len(linked), width, width)).copy()
        on = np.searchsorted(-size[linked], -np.arange(STEP), "left")
        for s in range(min(STEP, int(size[linked].max()))):
            m = on[s]
            moved = product[:m] @ t
            if s == 0:
                moved = np.where(first[linked[:m], None, None], product[:m], moved)
            moved = moved * p[begin[linked[:m]] + s][:, None, :]
            product[:m] = moved / moved.max((1, 2), keepdims=True)
        at = np.full(len(seq), -1)
        at[linked] = np.arange(len(linked))
        heads = (np.cumsum(many) - many)[many > 1]
        for k in range(1, int(many.max())):
            now = rank[heads[many[many > 1] > k] + k]
            before = rank[heads[many[many > 1] > k] + k - 1]
            v = np.einsum("sl,slm->sm", enter[before], product[at[before]])
            enter[now] = v / v.sum(1, keepdims=True)
        for k in range(int(many.max()) - 2, -1, -1):
            now = rank[heads[many[many > 1] > k + 1] + k]
            after = rank[heads[many[many > 1] > k + 1] + k + 1]
            v = np.einsum("slm,sm->sl", product[at[after]], leave[after])
            leave[now] = v / v.sum(1, keepdims=True)
    out, log_z = np.empty((total, width)), float(top.sum()) + log_start * int(first.sum())
    log_z += float(moves.max()) * (total - int(first.sum()))
    a = enter
    for s in range(STEP):
        m = running[s]
        if not m:
            break
        v = np.where(first[:m, None], a[:m], a[:m] @ t) if s == 0 else a[:m] @ t
        v = v * p[begin[:m] + s]
        c = v.sum(1, keepdims=True)
        log_z += float(np.log(c).sum())
        a = v / c
        out[begin[:m] + s] = a
    b, expected = leave, np.zeros((width, width)) if pairs else None
    for s in range(STEP - 1, -1, -1):
        m = running[s]
        if not m:
            continue
        here = begin[:m] + s
        ahead = b[:m] * p[here]
        if pairs:
            some = np.flatnonzero(~first[:m]) if s == 0 else np.arange(m)
            before = enter[some] if s == 0 else out[here[some] - 1]
            x = before[:, :, None] * t * ahead[some][:, None, :]
            expected += (x / x.sum((1, 2), keepdims=True)).sum(0)
        g = out[here] * b[:m]
        out[here] = g / g.sum(1, keepdims=True)
        v = ahead @ t.T
        b = b.copy()
        b[:m] = v / v.sum(1, keepdims=True)
    return out, expected, log_z


@dataclass
class Model:
    """Languages in order, a weight for each slot and language, the scores of moves between languages and of first words, and the lexicon: tens of megabytes at most."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    lexicon: dict[str, list[int]]
    key: str = field(default_factory=lambda: uuid4().hex)


def _scores(weights: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of a word's weights over the root of their number, for words of `counts` slots (one at least)."""
    return np.add.reduceat(weights[slots], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]


class _Words:
    """Rows of scores of the words that a worker has met, kept between its tasks."""

    kept: dict[str, _Words] = {}

    def __init__(self, model: Model):
        self.model, self.row, self.scores, self.used = model, {}, np.empty((1 << 12, len(model.languages)), np.float32), 0

    @classmethod
    def of(cls, model: Model) -> _Words:
        if model.key not in cls.kept:
            cls.kept = {model.key: cls(model)}
        return cls.kept[model.key]

    def look_up(self, found: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of the words of each text, without words that hold no letter. All rows stay valid until the next call."""
        if self.used > CACHE_WORDS:
            self.row, self.used = {}, 0
        row = self.row
        new = {w for own in found for w in own if w not in row}
        slots, counts, fresh = [], [], self.used
        for w in new:
            plain = letters(w)
            if not plain:
                row[w] = -1
                continue
            own = features(plain, self.model.lexicon)
            slots += own
            counts.append(len(own))
            row[w] = fresh
            fresh += 1
        if counts:
            while fresh > len(self.scores):
                self.scores = np.concatenate((self.scores, np.empty_like(self.scores)))
            self.scores[self.used : fresh] = _scores(self.model.weights, np.array(slots), np.array(counts))
            self.used = fresh
        out = []
        for own in found:
            at = np.array([row[w] for w in own], np.int64)
            out.append(at[at >= 0])
        for w in new:
            if len(w) > LONGEST:
                del row[w]
        return out


def label(texts: list[str | None], model: Model) -> list[np.ndarray]:
    """The probability of each language for each word of each text; no rows for texts without a letter."""
    out: list[np.ndarray] = [np.zeros((0, len(model.languages)))] * len(texts)
    words = _Words.of(model)
    raw = [t or "" for t in texts]
    for a, b in chunks(raw):
        rows = words.look_up([tokens(t) for t in raw[a:b]])
        some = [i for i, r in enumerate(rows) if len(r)]
        if not some:
            continue
        offset = np.concatenate(([0], np.cumsum([len(rows[i]) for i in some])))
        got, _, _ = chain(words.scores[np.concatenate([rows[i] for i in some])].astype(float), offset, model.moves, model.start)
        for k, i in enumerate(some):
            out[a + i] = got[offset[k] : offset[k + 1]]
    return out


def _pick(docs: DataFrame, text: Column, lang: Column, sample_bytes: int, least_docs: int) -> DataFrame:
    """lang, text of the sample: distinct texts below a threshold of their hash, by language."""
    known = docs.select(lang.alias("lang"), text.alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    share = sizes.select(F.col("lang").alias("_l"), F.greatest(sample_bytes / F.greatest("bytes", F.lit(1)), least_docs / F.col("n")).alias("share"))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return known.join(F.broadcast(share), F.col("lang") == F.col("_l")).where(h < F.col("share")).select("lang", "text").distinct()


def _lexicon(picked: DataFrame) -> dict[str, list[int]]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = Counter((lang, letters(w)) for lang, text in zip(batch["lang"], batch["text"], strict=True) for w in tokens(text))
            yield pd.DataFrame({"lang": pd.Series([k for k, _ in total], dtype=object), "word": pd.Series([w for _, w in total], dtype=object), "n": np.fromiter(total.values(), np.int64, len(total))})

    each = stored(picked.mapInPandas(count, "lang string, word string, n long").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    least = each.groupBy(F.col("lang").alias("_l")).agg(F.greatest(F.lit(SEEN), F.sum("n") / LEXICON).alias("least"))
    often = each.join(F.broadcast(least), F.col("lang") == F.col("_l")).where("n >= least").select("word").distinct()
    # shares of languages, not of the sample's sizes
    part = each.join(each.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("all")).hint("broadcast"), F.col("lang") == F.col("_l")).select("word", "lang", (F.col("n") / F.col("all")).alias("p"))
    shares: dict[str, dict[str, float]] = {}
    for r in part.join(often, "word", "left_semi").collect():
        shares.setdefault(r["word"], {})[r["lang"]] = r["p"]
    return {w: lexicon_slots({lang: x / sum(p.values()) for lang, x in p.items()}) for w, p in shares.items()}


_PIECES = "bucket int, place long, labels binary, counts binary, slots binary"


def _sequences(picked: DataFrame, languages: list[str], lexicon: dict[str, list[int]]) -> DataFrame:
    """Training sequences as bytes: labels, number of slots of each word, slots. Every other piece of a text stands alone, the rest are dealt to buckets and spliced."""
    number = {lang: i for i, lang in enumerate(languages)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = [x for x in map(letters, tokens(text)) if x]
                rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                at, alone = 0, bool(rng.integers(2))
                while at < len(words):
                    end = at + int(rng.integers(PIECE[0], PIECE[1] + 1))
                    own = [features(x, lexicon) for x in words[at:end]]
                    labels = np.full(len(own), number[lang], np.uint16)
                    counts, slots = np.array([len(x) for x in own], np.uint32), np.array([s for x in own for s in x], np.uint16)
                    rows.append((-1 if alone else int(rng.integers(BUCKETS)), int(rng.integers(1 << 62)), labels.tobytes(), counts.tobytes(), slots.tobytes()))
                    at, alone = end, not alone
            yield pd.DataFrame(rows, columns=["bucket", "place", "labels", "counts", "slots"])

    def splice(pieces: pd.DataFrame) -> pd.DataFrame:
        p = pieces.sort_values(["place", "labels", "slots"])
        by = np.arange(len(p)) // SPLICED
        return pd.DataFrame({c: p[c].groupby(by).agg(b"".join) for c in ("labels", "counts", "slots")})

    pieces = stored(picked.mapInPandas(cut, _PIECES), "language-pieces")
    mixed = pieces.where("bucket >= 0").groupBy("bucket").applyInPandas(splice, "labels binary, counts binary, slots binary")
    return stored(mixed.unionByName(pieces.where("bucket < 0").select("labels", "counts", "slots")).repartition(16), "language-sequences")


def _gradient(sequences: DataFrame, weights: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, log likelihood, and its gradient, summed over all sequences."""
    width = len(start)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, value, gw, gm, gs = 0, 0.0, np.zeros((SLOTS, width)), np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            for a in range(0, len(batch), _SEQUENCES):
                part = batch.iloc[a : a + _SEQUENCES]
                y, counts, slots = (np.frombuffer(b"".join(part[c]), k).astype(np.int64) for c, k in (("labels", np.uint16), ("counts", np.uint32), ("slots", np.uint16)))
                offset = np.concatenate(([0], np.cumsum([len(x) // 2 for x in part["labels"]])))
                scores = _scores(weights, slots, counts)
                p, expected, log_z = chain(scores, offset, moves, start, pairs=True)
                inner = np.ones(len(y), bool)
                inner[offset[:-1]] = False
                at = np.flatnonzero(inner)
                n += len(y)
                value += scores[np.arange(len(y)), y].sum() + moves[y[at - 1], y[at]].sum() + start[y[offset[:-1]]].sum() - log_z
                np.add.at(gm, (y[at - 1], y[at]), 1.0)
                gm -= expected
                d = -p
                d[np.arange(len(y)), y] += 1.0
                gs += d[offset[:-1]].sum(0)
                d = np.repeat(d / np.sqrt(counts)[:, None], counts, axis=0)
                for k in range(width):
                    gw[:, k] += np.bincount(slots, d[:, k], SLOTS)
        yield pd.DataFrame({"place": [-3, -2, -1, *range(SLOTS // SLICE)], "row": [np.array([n, value]), gm.ravel(), gs, *gw.reshape(SLOTS // SLICE, -1)]})

    got = summed(sequences.mapInPandas(add, PARTS))
    return got[-3][0], got[-3][1], np.concatenate([got[i].reshape(-1, width) for i in range(SLOTS // SLICE)]), got[-2].reshape(width, width), got[-1]


def climb(value_and_slope, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """A maximum of a concave function by L-BFGS with halved steps; each trial is one call."""
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, a = slope.copy(), []
        for s, y, r in reversed(past):
            a.append(r * (s @ q))
            q -= a[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(slope), 1e-12)
        for (s, y, r), k in zip(past, reversed(a), strict=True):
            q += (k - r * (y @ q)) * s
        rate = 1.0
        while rate > 1e-3:
            new, tilt = value_and_slope(x + rate * q)
            if new >= value + 1e-4 * rate * (slope @ q):
                break
            rate /= 2
        else:
            break
        s, y = rate * q, slope - tilt
        if s @ y > 1e-12:
            past = [*past[-(memory - 1) :], (s, y, 1 / (s @ y))]
        gain, x, value, slope = new - value, x + s, new, tilt
        if gain < 1e-5 * max(abs(value), 1e-3):
            break
    return x


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 1 << 18, least_docs: int = 50, steps: int = 15, ridge: float = 1e-6) -> Model:
    """Learn from docs with a language: of each one about `sample_bytes` of texts, or `least_docs` texts if these are more; copies of a text count once.

    Languages are values of lang_col as they stand, few (a row of each is broadcast). Without any the model knows none; a language whose sample has no letter is not learnt.
    """
    ship(docs.sparkSession)
    picked = stored(_pick(docs, F.col(text_col), F.col(lang_col).cast("string"), sample_bytes, least_docs), "language-sample")
    lexicon = _lexicon(picked)
    languages = sorted(r["lang"] for r in picked.where(F.rlike("text", F.lit("\\p{L}"))).select("lang").distinct().collect())
    width = len(languages)
    model = Model(languages, np.zeros((SLOTS, width), np.float32), np.zeros((width, width)), np.zeros(width), lexicon)
    if width < 2:
        return model
    sequences = _sequences(picked.where(F.col("lang").isin(languages)), languages, lexicon)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return x[: SLOTS * width].reshape(SLOTS, width), x[SLOTS * width : (SLOTS + width) * width].reshape(width, width), x[(SLOTS + width) * width :]

    def likelihood(x: np.ndarray) -> tuple[float, np.ndarray]:
        n, value, *slopes = _gradient(sequences, *parts(x))
        return value / n - ridge / 2 * (x @ x), np.concatenate([s.ravel() for s in slopes]) / n - ridge * x

    model.weights, model.moves, model.start = parts(climb(likelihood, np.zeros((SLOTS + width) * width + width), steps))
    model.weights = model.weights.astype(np.float32)
    return model


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the language expected for most words of the whole text, and the share of words expected to be in it.

    Ties go to the language that is first in code-point order. Null texts and texts without a letter, and all texts if the model knows no language, have UNKNOWN and score 0. A
    letter is any of Unicode's. Columns of docs of these names are replaced. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            langs, scores = [], []
            for p in label(batch.to_list(), m) if m.languages else [[]] * len(batch):
                mean = p.mean(0) if len(p) else None
                langs.append(UNKNOWN if mean is None else m.languages[int(mean.argmax())])
                scores.append(0.0 if mean is None else min(float(mean.max()), 1.0))
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype="float64")})

    out = docs.withColumn("_r", f(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("_r.lang"), "score": F.col("_r.score")}).drop("_r")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each run of words of one language in each text of docs: id_col, run (from 0), lang, first (number of its first word), n_words, score (mean probability).

    Words are counted over those with a letter. Texts without one have no rows; repeated rows of docs give repeated rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<lang string, first long, n_words long, score double>>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for batch in batches:
            out = []
            for p in label(batch.to_list(), m) if m.languages else [[]] * len(batch):
                if not len(p):
                    out.append([])
                    continue
                best = p.argmax(1)
                head = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
                size = np.diff(np.concatenate((head, [len(best)])))
                mean = np.add.reduceat(p[np.arange(len(best)), best], head) / size
                out.append([{"lang": m.languages[best[h]], "first": h, "n_words": n, "score": s} for h, n, s in zip(head.tolist(), size.tolist(), mean.tolist(), strict=True)])
            yield pd.Series(out, dtype=object)

    rows = docs.select(F.col(id_col), f(F.col(text_col)).alias("_r")).select(id_col, F.posexplode("_r").alias("run", "_s"))
    return rows.select(id_col, "run", F.col("_s.lang").alias("lang"), F.col("_s.first").alias("first"), F.col("_s.n_words").alias("n_words"), F.col("_s.score").alias("score"))


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """id_col, held_out (crc32 of the id as text mod `folds` is `held`), lang_pred, score of each row of docs, learnt from the text and language of rows that are not held out.

    Null ids count as empty text in the fold rule and stay null; repeated rows are rows of their own. The rest as in fit() and identified().
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    out = label_hash("_id") % folds == held
    model = fit(own.where(~out), "_text", "_lang")
    return identified(own.select("_id", "_text"), model, "_text").select(F.col("_id").alias(id_col), out.alias("held_out"), "lang_pred", "score")
