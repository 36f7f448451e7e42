"""Toxicity by a string-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import hashed_words, mix, slices, stage, tune, utf8

#: Labelled documents that are fitted at most, of either class, chosen by a hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 8_000, 16_000
#: Words the machine is trained on at most: telling words of toxic documents, words of clean ones, and clean words that the first fit ranks highest.
SEEDS, CLEAN_WORDS, HARD_WORDS = 500, 6_000, 3_000
LANDMARKS = 160
#: Sketches by which copies among the training documents are found.
SKETCHES = 4
#: The kernel compares three letters in order, within a reach, each further place of which weighs DECAY.
REACH, DECAY = 7, 0.6
#: Letters of a word seen at once; longer ones are seen in windows that overlap by half.
WIDTH = 14
#: Beginnings of words, of so many letters, are counted like words: rare forms of one stem tell together.
STEMS = (4, 5)
#: Bounds how many words or stems that are tied to no class are expected among the telling ones.
CHANCE = 0.1
_STORE = 300_000
#: Letter codes take six bits: 26 letters, and other characters by their remainder.
_BITS, _OTHERS = 6, 37
_DIM = 1 << 3 * _BITS

# Look-alikes of letters inside words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_RUN = re.compile(r"[^\W\d_]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SWAP = str.maketrans(LOOKALIKES)
_MIXED = re.compile(r"[^\W\d_].*[0134570@$!|].*[^\W\d_]")
_STEPS = [(a, b) for b in range(2, REACH) for a in range(1, b)]


def forms(token: str) -> list[str]:
    """What a lower-case token without white space may spell: its runs of letters, these joined, and with look-alikes read as letters."""
    if token.isalpha():
        return [token]
    runs = _RUN.findall(token)
    out = set(runs)
    if len(runs) > 1:
        out.add(_NOT_LETTERS.sub("", token))
    if _MIXED.search(token):
        out.update(_RUN.findall(token.translate(_SWAP)))
    return list(out)


def spaced(words: list[str]) -> list[str]:
    """Runs of four or more one-letter words, joined: letters with gaps between them."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    one = size == 1
    if len(one) < 4 or not (one[:-3] & one[1:-2] & one[2:-1] & one[3:]).any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], one, [False])).view(np.int8)))
    return ["".join(words[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 4]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes (rows, WIDTH) of words' windows, 0 behind the end, and the word of each row."""
    parts, owner = [], []
    for k, w in enumerate(words):
        for at in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
            parts.append(w[at : at + WIDTH].ljust(WIDTH))
            owner.append(k)
    points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4").reshape(-1, WIDTH) if parts else np.empty((0, WIDTH), dtype="<u4")
    codes = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % _OTHERS)
    return np.where(points == 32, 0, codes).astype(np.int32), np.array(owner, dtype=np.int64)


def _scale(codes: np.ndarray) -> np.ndarray:
    """1 over the root of the summed squared weights of a row's letter triples; 0 for rows of under three letters."""
    n = (codes > 0).sum(axis=1)
    by_length = np.array([sum(max(0, m - b) * DECAY ** (2 * (b - 2)) for _, b in _STEPS) for m in range(WIDTH + 1)])
    total = by_length[n]
    return np.where(total > 0, 1 / np.sqrt(np.maximum(total, 1e-9)), 0.0)


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    for a, b in _STEPS:
        yield (codes[:, : WIDTH - b] << 2 * _BITS) | (codes[:, a : WIDTH - b + a] << _BITS) | codes[:, b:], DECAY ** (b - 2)


def triples_of(words: list[str]) -> np.ndarray:
    """All letter triples of some words."""
    codes, _ = _codes(words)
    return np.unique(np.concatenate([i[(i & ((1 << _BITS) - 1)) > 0] for i, _ in _triples(codes)]))


def feature_rows(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Kernel features (words, columns) for the letter triples named by ``columns``; windows of one word are summed."""
    codes, owner = _codes(words)
    scale = _scale(codes)
    place = np.full(_DIM, -1, dtype=np.int64)
    place[columns] = np.arange(len(columns))
    out = np.zeros((len(words), len(columns)), dtype=np.float32)
    for index, weight in _triples(codes):
        at = np.where((index & ((1 << _BITS) - 1)) > 0, place[index], -1)
        valid = at >= 0
        row = np.broadcast_to(owner[:, None], index.shape)
        np.add.at(out, (row[valid], at[valid]), (weight * np.broadcast_to(scale[:, None], index.shape)[valid]).astype(np.float32))
    return out


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The machine's value for each word, the largest of its windows; ``weights`` is the sum of landmarks over letter triples."""
    best = np.full(len(words), -np.inf)
    codes, owner = _codes(words)
    value = np.zeros(len(codes))
    for index, weight in _triples(codes):
        value += weight * weights[index].sum(axis=1)  # triples with a place behind the end have weight 0
    np.maximum.at(best, owner, value * _scale(codes))
    return best


class Model(NamedTuple):
    weights: np.ndarray
    offset: float
    slope: float
    base: float

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value + self.offset) + self.base, -40, 40)))


class Scorer:
    """Scores of whole texts; a worker keeps the values of words that it has met."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.known = weights, {}

    def _values(self, tokens: list[str]) -> dict[str, float]:
        spelled = [forms(t) for t in tokens]
        flat = [f for fs in spelled for f in fs]
        value = word_scores(flat, self.weights).tolist()
        out, at = {}, 0
        for t, fs in zip(tokens, spelled, strict=True):
            out[t] = max(value[at : at + len(fs)], default=0.0)
            at += len(fs)
        return out

    def texts(self, texts: list[str]) -> list[float]:
        if len(self.known) > _STORE:
            self.known.clear()
        known = self.known
        split = [t.lower().split() for t in texts]
        found = [[*map(known.get, words)] for words in split]
        new = {words[k] for words, f in zip(split, found, strict=True) if None in f for k, v in enumerate(f) if v is None}
        gaps = [spaced(words) for words in split]
        new.update(w for ws in gaps for w in ws if w not in known)
        if new:
            known.update(self._values([*new]))
        out = []
        for words, f, joined in zip(split, found, gaps, strict=True):
            values = [known[w] for w in words] if None in f else f
            out.append(max(max(values, default=0.0), max((known[w] for w in joined), default=0.0), 0.0))
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1000.0, rounds: int = 60) -> np.ndarray:
    """A linear support vector machine (hinge loss, last column of x is the constant) by dual coordinate descent."""
    rng = np.random.default_rng(5)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square, top = (x * x).sum(axis=1), cost * weight
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            if square[i] <= 0:
                continue
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit_words(positive: list[str], negative: list[str], hard: list[str]) -> tuple[np.ndarray, float]:
    """Weights over letter triples and the constant of a machine on Nyström features of words."""
    half = LANDMARKS // 2
    marks = positive[:half] + (hard + negative)[:half]
    columns = triples_of(marks)
    basis = feature_rows(marks, columns)
    kernel = (basis @ basis.T).astype(np.float64)
    root, vectors = np.linalg.eigh(kernel + 1e-6 * np.eye(len(marks)))
    keep = root > 1e-4 * root.max()
    whiten = vectors[:, keep] / np.sqrt(root[keep])
    words = positive + negative + hard
    x = np.concatenate([feature_rows(words[k : k + 500], columns) @ basis.T for k in range(0, len(words), 500)]) @ whiten
    y = np.where(np.arange(len(words)) < len(positive), 1.0, -1.0)
    weight = np.where(y > 0, len(words) / (2 * max(1, len(positive))), len(words) / (2 * max(1, len(words) - len(positive))))
    w = fit_svm(np.column_stack([x, np.full(len(x), 1.0)]), y, weight)
    folded = np.zeros(_DIM)
    folded[columns] = basis.T @ (whiten @ w[:-1])
    return folded, float(w[-1])


def fit_logistic(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and constant of a logistic fit with a small ridge, by Newton steps."""
    x = np.column_stack([value, np.ones(len(value))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + 1e-2 * w
        w -= np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad), -5, 5)
    return max(float(w[0]), 0.0), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of labelled documents that aren't held out; texts aren't shuffled for it."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    pick = lambda cond, n: known.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    few = pick("toxic", TRAIN_TOXIC).union(pick("not toxic", TRAIN_CLEAN))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def _sketch(text: Column) -> Column:
    """Least hashes of a text's runs of four words; copies and near copies share some of them."""

    def run(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts:
            words, _ = hashed_words([utf8(t)])
            runs = mix(((words[:-3] * np.uint64(31) + words[1:-2]) * np.uint64(31) + words[2:-1]) * np.uint64(31) + words[3:]) if len(words) > 3 else mix(words + np.uint64(1))
            rows.append([int(mix(runs ^ np.uint64(k)).min().astype(np.int64)) if len(runs) else k for k in range(SKETCHES)])
        return pd.Series(rows)

    return F.pandas_udf(run, "array<long>")(text)


def without_copies(train: DataFrame) -> DataFrame:
    """The training documents of which no sketch is that of another one of the class: words of copies must not count again and again."""
    ids = train.select("doc_id", "toxic", _sketch(F.col("text")).alias("s"))
    ids = stage(ids.select("doc_id", "toxic", *[F.col("s")[k].alias(f"s{k}") for k in range(SKETCHES)]), "tox-sketch")
    for k in range(SKETCHES):
        first = ids.groupBy("toxic", f"s{k}").agg(F.min("doc_id").alias("doc_id"))
        ids = ids.join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    return train.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def out() -> pd.DataFrame:
        words = list(counts[True].keys() | counts[False].keys())
        made = pd.DataFrame({"word": words, "pos": [counts[True][w] for w in words], "neg": [counts[False][w] for w in words]})
        counts[True].clear()
        counts[False].clear()
        return made

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            tokens = set((text or "").lower().split())
            words = {f for t in tokens for f in forms(t) if 3 <= len(f) <= WIDTH}
            counts[bool(toxic)].update(words | {f"^{w[:n]}" for w in words for n in STEMS if len(w) > n})
        if len(counts[True]) + len(counts[False]) > 200_000:
            yield out()
    if counts[True] or counts[False]:
        yield out()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); without toxic or without clean labelled documents it scores all alike.

    Labels are of documents, so words are the sentences here: words that occur in toxic documents far more often than chance
    allows are positive, as are words of a stem that does, words of clean documents negative, among these the ones a first fit ranks highest. A document's value
    is that of its worst word; a logistic fit on the training documents turns it into a probability. What reaches the driver
    is bounded by the parameters above.
    """
    spark = docs.sparkSession
    tune(spark)
    train = stage(training_documents(docs, labels), "tox-all")
    train = stage(without_copies(train), "tox-train")
    size = {bool(r["toxic"]): int(r["n"]) for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Model(np.zeros(_DIM), 0.0, 0.0, 5.0 if size.get(True) else -5.0)
    words = stage(train.mapInPandas(_count_words, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "tox-words")
    rate = size[True] / (size[True] + size[False])
    n = F.col("pos") + F.col("neg")
    share = F.col("pos") / n
    # Chernoff's bound on so large a share of a word's documents being toxic by chance
    surprise = n * (share * F.log(share / rate) + (1 - share) * F.log((1 - share + 1e-12) / (1 - rate)))
    often = words.where("pos >= 3")
    evidence = float(np.log(max(1, often.count()) / CHANCE))
    telling = often.where((share > rate) & ((share > 5 * rate) | (share > 0.9)) & (surprise >= evidence)).select("word", "pos", "neg")
    # a stem must be one of toxic words alone: clean words may begin like a toxic one
    stems = telling.where(F.col("word").startswith("^") & (F.col("neg") * 200 <= F.col("pos"))).orderBy(F.desc("pos"), "word").limit(SEEDS).select(F.substring("word", 2, 9).alias("stem"))
    held = [F.substring("word", 1, n).alias("stem") for n in STEMS]
    alike = words.where("pos > 0 and neg = 0 and not startswith(word, '^')")
    alike = alike.select("word", "pos", F.explode(F.array(*held)).alias("stem")).join(F.broadcast(stems), "stem", "left_semi").select("word", "pos")
    found = telling.where(~F.col("word").startswith("^")).select("word", "pos").union(alike).distinct()
    positive = [r["word"] for r in found.orderBy(F.desc("pos"), "word").limit(SEEDS).collect()]
    clean = words.where("neg > 0 and neg * 10 > pos and not startswith(word, '^')")
    negative = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).collect()]
    if not positive or not negative:
        return Model(np.zeros(_DIM), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    hard: list[str] = []
    for _ in range(2):
        weights, offset = fit_words(positive, negative, hard)
        top = clean.select("word", _word_value(F.col("word"), weights).alias("value")).orderBy(F.desc("value"), "word").limit(HARD_WORDS)
        hard = [r["word"] for r in top.collect()]
    weights, offset = fit_words(positive, negative, hard)
    found = train.select("toxic", toxic_value(F.col("text"), weights).alias("value")).toPandas()
    slope, base = fit_logistic(found["value"].to_numpy() + offset, found["toxic"].to_numpy().astype(float))
    return Model(weights, offset, slope, base)


def _word_value(word: Column, weights: np.ndarray) -> Column:
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(word_scores(words.tolist(), weights))

    return F.pandas_udf(run, "double")(word)


def toxic_value(text: Column, weights: np.ndarray) -> Column:
    """The value of a text's worst word (0 at least); a null text is empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(weights)
        for texts in batches:
            whole = ["" if t is None else t for t in texts]
            yield pd.Series([v for a, b in slices(whole, 1_000_000) for v in scorer.texts(whole[a:b])], dtype=float)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def toxic_probability(text: Column, model: Model) -> Column:
    """A text column's probability of being toxic, 0 to 1."""
    value = toxic_value(text, model.weights) + F.lit(model.offset)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), value * F.lit(model.slope) + F.lit(model.base)))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    Texts alone are scored. Null and empty texts have the score of a document without telling words. Null ids are not held
    out; repeated ids are scored row by row; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxic_probability(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
