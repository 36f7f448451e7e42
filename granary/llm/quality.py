"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import hashed_words, slices, tune, utf8

#: Documents that the scorer is fitted on at most, chosen by a hash of their ids.
TRAIN_ROWS = 6_000
#: Weights of the scorer for hashed words and for hashed runs of character classes.
BITS = 15
EPOCHS, RATE, RIDGE = 12, 0.5, 1e-6
BAD, GOOD, ABSTAIN = 0, 1, 2

# Frequent short words of the languages at hand.
STOP_WORDS = (
    "the of and to in is that it for was on with as be at by this are from or an "
    "de la le les des et un une du en que pour dans est sur au par "
    "der die das und ist von zu den mit nicht ein eine im auf für sich "
    "el los las y que del se una por con no para al lo"
).split()

_STOPS = np.unique(hashed_words([" ".join(STOP_WORDS).encode()])[0])
_KIND = np.full(256, 9, dtype=np.int64)  # other marks
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[32] = 4
_KIND[[9, 10, 11, 12, 13]] = 5
for _k, _marks in ((6, b".,;:?'"), (7, b"!"), (8, b"#$%&*+=<>@^~\\_"), (10, b"|/[]{}()"), (11, b"\"-")):
    _KIND[list(_marks)] = _k
_ENDS = (b".", b"!", b"?", b"\"", b")")


class Facts(NamedTuple):
    words: int
    letters: float
    marks: float
    loud: float
    digits: float
    length: float
    distinct: float
    lines: float
    stops: float
    ends: bool


def facts(text: bytes, words: np.ndarray) -> Facts:
    """What labellers look at: shares of characters and words of one text."""
    n = max(1, len(text))
    count = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=12) if text else np.zeros(12)
    letters, m = count[0] + count[1] + count[3], max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return Facts(
        len(words), letters / n, (count[8] + count[9] + count[10]) / n, count[1] / max(1, count[0] + count[1]), count[2] / n, (letters + count[2]) / m,
        len(np.unique(words)) / m, len(set(lines)) / max(1, len(lines)), float(np.isin(words, _STOPS).mean()) if len(words) else 0.0, text.rstrip().endswith(_ENDS),
    )


def _judge(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


#: Name and vote of each labeller; they overlap, and none sees all.
LABELLERS = (
    ("marks", lambda f: _judge(f.marks < 0.01, f.marks > 0.04)),
    ("letters", lambda f: _judge(f.letters > 0.74, f.letters < 0.6)),
    ("loud", lambda f: _judge(f.loud < 0.15, f.loud > 0.4)),
    ("digits", lambda f: _judge(f.digits < 0.1, f.digits > 0.3)),
    ("word length", lambda f: _judge(3 <= f.length <= 9, f.words > 3 and (f.length < 2 or f.length > 14))),
    ("distinct words", lambda f: _judge(f.distinct > 0.35, f.words > 20 and f.distinct < 0.25)),
    ("distinct lines", lambda f: _judge(f.lines > 0.8, f.lines < 0.5)),
    ("frequent words", lambda f: _judge(f.stops > 0.08, f.words > 15 and f.stops < 0.01)),
    ("length", lambda f: _judge(f.words >= 30, f.words < 1)),
)


def votes(f: Facts) -> int:
    """All votes as one number, base three."""
    code = 0
    for _, label in reversed(LABELLERS):
        code = code * 3 + label(f)
    return code


class Labels(NamedTuple):
    """Class 0 is good; the others are kinds of bad, one begun from each labeller, since a bad document shows few faults."""

    prior: np.ndarray  # class
    table: np.ndarray  # labeller, class, vote: probability if it votes; 1 where it abstains, which says nothing

    def shares(self, codes: np.ndarray) -> np.ndarray:
        """Probability of each class for vote patterns."""
        log = np.tile(np.log(self.prior), (len(codes), 1))
        for j in range(len(self.table)):
            log += np.log(self.table[j][:, codes // 3**j % 3]).T
        log = np.exp(log - log.max(axis=1, keepdims=True)) if len(codes) else log
        return log / log.sum(axis=1, keepdims=True)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        return self.shares(codes)[:, 0]

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """How often a labeller says good of good documents and bad of bad ones."""
        bad = self.prior[1:] / self.prior[1:].sum()
        return {name: (float(t[0, GOOD]), float(bad @ t[1:, BAD])) for (name, _), t in zip(LABELLERS, self.table, strict=True)}


def fit_labels(patterns: dict[int, int], rounds: int = 200) -> Labels:
    """Expectation-maximisation over counts of vote patterns, begun from bad votes: a pattern without any is good."""
    codes = np.array(sorted(patterns), dtype=np.int64)
    weight = np.array([patterns[c] for c in codes.tolist()], dtype=float)
    kinds = len(LABELLERS)
    each = np.stack([codes // 3**j % 3 for j in range(kinds)]) if len(codes) else np.empty((kinds, 0), dtype=np.int64)
    belief = np.zeros((len(codes), kinds + 1))
    bad = (each == BAD).T
    belief[:, 1:] = 0.9 * bad / np.maximum(1, bad.sum(axis=1, keepdims=True))
    belief[:, 0] = 1 - belief.sum(axis=1)
    table, prior = np.ones((kinds, kinds + 1, 3)), np.full(kinds + 1, 1 / (kinds + 1))
    for _ in range(rounds if len(codes) else 0):
        mass = weight[:, None] * belief
        prior = (mass.sum(axis=0) + 0.5) / (mass.sum() + 0.5 * (kinds + 1))
        for j in range(kinds):
            for v in (BAD, GOOD):
                table[j, :, v] = mass[each[j] == v].sum(axis=0) + 0.5
        table[:, :, :ABSTAIN] /= table[:, :, :ABSTAIN].sum(axis=2, keepdims=True)
        new = Labels(prior, table).shares(codes)
        if np.abs(new - belief).max() < 1e-9:
            break
        belief = new
    return Labels(prior, table)


_VOTES = np.arange(len(LABELLERS), dtype=np.int64)


def features(text: bytes, words: np.ndarray, code: int) -> tuple[np.ndarray, ...]:
    """Hashed places of a text's words, of its runs of four character classes and of the labellers' votes."""
    kind = _KIND[np.frombuffer(text, dtype=np.uint8)]
    runs = (((kind[:-3] * 12 + kind[1:-2]) * 12 + kind[2:-1]) * 12 + kind[3:]) if len(kind) > 3 else np.empty(0, dtype=np.int64)
    cast = (3 * _VOTES + code // 3**_VOTES % 3 + 1) * 2_654_435_761 % (1 << BITS)
    return (words >> np.uint64(64 - BITS)).astype(np.int64), (1 << BITS) + runs * 40_503 % (1 << BITS), (1 << BITS) + cast


def raw_score(weights: np.ndarray, text: bytes, words: np.ndarray, code: int) -> float:
    *shares, cast = features(text, words, code)
    return float(sum(weights[part].mean() for part in shares if len(part)) + weights[cast].sum() + weights[-1])


def _each(texts: list) -> Iterator[tuple[bytes, np.ndarray]]:
    whole = [utf8(t) for t in texts]
    for lo, hi in slices(whole):
        words, start = hashed_words(whole[lo:hi])
        for k, t in enumerate(whole[lo:hi]):
            yield t, words[start[k] : start[k + 1]]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for pdf in batches:
        seen.update(votes(facts(t, w)) for t, w in _each(pdf["text"].tolist()))
    yield pd.DataFrame(sorted(seen.items()), columns=["code", "n"])


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t, w in _each(pdf["text"].tolist()):
            found, code = [], votes(facts(t, w))
            *shares, cast = features(t, w, code)
            for part, whole in [(p, max(1, len(p))) for p in shares] + [(cast, 1)]:  # votes count whole, the rest by their shares
                at, n = np.unique(part, return_counts=True)
                found.append((at.astype("<i4"), (n / whole).astype("<f4")))
            rows.append((code, b"".join(a.tobytes() for a, _ in found), b"".join(n.tobytes() for _, n in found)))
        out = pd.DataFrame(rows, columns=["code", "places", "shares"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        yield out


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], belief: np.ndarray) -> np.ndarray:
    """Logistic weights by stochastic gradients scaled by past ones; both classes weigh the same."""
    rng = np.random.default_rng(11)
    weights, seen = np.zeros((2 << BITS) + 1), np.full((2 << BITS) + 1, 1e-3)
    share = np.clip(belief.mean(), 0.02, 0.98) if len(belief) else 0.5
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -30, 30)))
            step = (p - belief[k]) * (belief[k] / share + (1 - belief[k]) / (1 - share)) / 2
            grad = step * x + RIDGE * weights[at]
            seen[at] += grad * grad
            weights[at] -= RATE * grad / np.sqrt(seen[at])
            seen[-1] += step * step
            weights[-1] -= RATE * step / np.sqrt(seen[-1])
    return weights


def score_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, posterior, score, keep), one row per row of ``docs`` (doc_id, text).

    Heuristic labellers vote good, bad or abstain on every document. The counts of vote patterns of all documents, of which
    there can be 3 to the power of the number of labellers, go to the driver, where expectation-maximisation estimates how often
    each labeller is right; a pattern's posterior follows. Posteriors of at most TRAIN_ROWS documents train a logistic scorer on
    hashed words, runs of character classes and votes; ``score`` is its probability of good, ``keep`` whether that is 0.5 or more.

    Null and empty texts are scored as texts without words; null and repeated ids are passed on; an empty table gives no rows;
    other columns are ignored. No labels are read.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    counted = docs.select("text").mapInPandas(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    labels = fit_labels({int(r["code"]): int(r["n"]) for r in counted.collect()})
    few = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    seen = docs.join(F.broadcast(few), "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(_examples, "doc_id long, code long, places binary, shares binary")
    # rows that share an id are one example, the least, so that reruns agree and TRAIN_ROWS bounds what reaches the driver
    train = seen.groupBy("doc_id").agg(F.min(F.struct("code", "places", "shares")).alias("x")).select("x.*").toPandas().sort_values(["code", "places", "shares"])
    rows = [(np.frombuffer(a, dtype="<i4").astype(np.int64), np.frombuffer(b, dtype="<f4").astype(float)) for a, b in zip(train["places"], train["shares"], strict=True)]
    weights = fit_scorer(rows, labels.posterior(train["code"].to_numpy(dtype=np.int64))).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coded = ((votes(facts(t, w)), t, w) for t, w in _each(pdf["text"].tolist()))
            found = [(code, raw_score(weights, t, w, code)) for code, t, w in coded]
            score = 1 / (1 + np.exp(-np.clip(np.array([s for _, s in found], dtype=float), -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "posterior": labels.posterior(np.array([c for c, _ in found], dtype=np.int64)), "score": score, "keep": score >= 0.5})

    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(run, "doc_id long, posterior double, score double, keep boolean")
