"""Quality from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each labeller votes good, bad or abstains. The votes of all texts are counted by pattern, of which there are at
most 3 to the number of labellers, whatever the corpus; expectation-maximisation on these counts estimates each
labeller's accuracies and the share of good texts, given that labellers err independently. Posteriors of about
`most_rows` texts train a logistic scorer on hashed words and shapes, and it scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Words, byte_hashes, prepare, slices
from tidemark.llm.linear import BITS, Adam, features, sample, score_texts, sigmoid

GOOD, BAD, ABSTAIN = 1, 0, 2
#: (name, measure, bad below, good from, good to, bad above); between them the labeller abstains.
LABELLERS = (
    ("symbols", "symbols_per_word", -1.0, 0.0, 0.03, 0.2),
    ("capitals", "capital_share", -1.0, 0.0, 0.12, 0.3),
    ("exclaiming", "marks_per_word", -1.0, 0.0, 0.05, 0.3),
    ("word_length", "mean_length", 3.0, 4.0, 6.0, 6.7),
    ("variety", "distinct_share", 0.25, 0.5, 2.0, 9.0),
    ("repeated_lines", "repeated_lines", -1.0, 0.0, 0.1, 0.3),
    ("short_words", "short_share", 0.1, 0.25, 0.8, 0.95),
    ("length", "n_words", 1.0, 40.0, 1e18, 1e19),
)
N_SHAPES = 8


def _kind(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


_SYMBOL, _CAPITAL, _MARK = _kind("#*$%&|<>"), _kind(range(65, 91)), _kind("!?")


def measures(words: Words) -> dict[str, np.ndarray]:
    """Shapes of each text."""
    n = words.per_doc()
    safe = np.maximum(n, 1)
    ndoc = len(n)

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[words.raw])])
        return total[words.at[1:]] - total[words.at[:-1]]

    size = np.diff(words.off)
    owner = words.doc_of()
    hashes = words.hashes()
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=ndoc)
    # of few words a larger share is distinct by nature: measured against n ** 0.9
    bytes_ = np.diff(words.at)
    return {
        "n_words": n.astype(float),
        "symbols_per_word": count(_SYMBOL) / safe,
        "capital_share": count(_CAPITAL) / np.maximum(bytes_, 1),
        "marks_per_word": count(_MARK) / safe,
        "mean_length": np.bincount(owner, size, ndoc) / safe,
        "distinct_share": distinct / safe**0.9,
        "repeated_lines": _repeated_lines(words),
        "short_share": np.bincount(owner, size <= 3, ndoc) / safe,
    }


def _repeated_lines(words: Words) -> np.ndarray:
    """The share of a text's lines with a word that equal an earlier one."""
    ends = np.flatnonzero(words.raw == 10)
    bounds = np.unique(np.concatenate([words.at, ends + 1]))
    bounds = bounds[bounds <= len(words.raw)]
    if len(bounds) < 2:
        return np.zeros(len(words.at) - 1)
    # lines with a word are those in which one begins
    has = np.diff(np.searchsorted(words.begins, bounds)) > 0
    h = byte_hashes(words.raw, bounds)
    owner = np.searchsorted(words.at, bounds[:-1], "right") - 1
    # the last line of a text has no line feed, so it is compared as it stands
    h, owner = h[has], owner[has]
    order = np.lexsort((h, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    n = np.bincount(owner, minlength=len(words.at) - 1)
    return np.bincount(owner[order][same], minlength=len(words.at) - 1) / np.maximum(n, 1)


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each text, a column for each labeller."""
    out = []
    for _, measure, bad_below, good_from, good_to, bad_above in LABELLERS:
        x = found[measure]
        out.append(np.where((x < bad_below) | (x > bad_above), BAD, np.where((x >= good_from) & (x <= good_to), GOOD, ABSTAIN)))
    return np.column_stack(out).astype(np.int64)


@dataclass
class LabelModel:
    """share: of good texts; chance[y, j, v]: that labeller j votes v on a text of class y (0 bad, 1 good)."""

    share: float
    chance: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good | votes); a row of v for each text."""
        j = np.arange(v.shape[1])
        good = np.log(self.share) + np.log(self.chance[1, j, v]).sum(1)
        bad = np.log1p(-self.share) + np.log(self.chance[0, j, v]).sum(1)
        return sigmoid(good - bad)


#: Where estimation starts, and the prior it keeps to: chances of the votes bad, good, abstain in a good and in a bad text.
#: Each kind of bad text shows in one or two measures, so that a vote for bad says much and one for good says little.
GOOD_VOTES, BAD_VOTES = (0.004, 0.8, 0.196), (0.4, 0.52, 0.08)


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 200, faith: float = 0.1) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts. The prior counts as `faith` times the texts.
    Without texts the prior itself is the model."""
    width = patterns.shape[1]
    prior = np.tile(np.array([BAD_VOTES, GOOD_VOTES])[:, None, :], (1, width, 1))
    model = LabelModel(0.7, prior)
    if not len(n):
        return model
    for _ in range(rounds):
        good = model.posterior(patterns)
        new = prior * faith * n.sum()
        for y, p in ((1, good), (0, 1 - good)):
            for v in range(3):
                new[y, :, v] += ((patterns == v) * (p * n)[:, None]).sum(0)
            new[y] /= new[y].sum(1, keepdims=True)
        share = float(np.clip((good * n).sum() / n.sum(), 0.01, 0.99))
        moved = np.abs(new - model.chance).max()
        model = LabelModel(share, new)
        if moved < 1e-7:
            break
    return model


@dataclass
class Scorer:
    """weights: of the hashed words, the vote shapes and last the constant."""

    weights: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        of, feature, value, n = inputs(words)
        return sigmoid(np.bincount(of, self.weights[feature] * value, n) + self.weights[-1])


def inputs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text numbers, features and values: hashed words scaled so that they have length 1 a text, then each labeller's good and bad votes."""
    n = len(words.at) - 1
    of, feature, tf = features(words)
    value = np.log1p(tf)
    value = value / np.sqrt(np.maximum(np.bincount(of, value * value, n), 1e-12))[of]
    v = votes(measures(words))
    parts = [(of, feature, value)]
    for j in range(v.shape[1]):
        for k, vote in enumerate((GOOD, BAD)):
            at = np.flatnonzero(v[:, j] == vote)
            parts.append((at, np.full(len(at), (1 << BITS) + 2 * j + k), np.ones(len(at))))
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), n


def inputs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """inputs() of many texts, a slice at a time, so that memory follows the features and not the bytes."""
    parts = []
    for a, b in slices(column):
        of, feature, value, _ = inputs(Words(column.slice(a, b - a), lower=True))
        parts.append(((of + a).astype(np.int32), feature.astype(np.int32), value.astype(np.float32)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), 0
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), len(column)


def fit(column: pa.Array, target: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets."""
    of, feature, value, n = inputs_of(column)
    size = (1 << BITS) + 2 * N_SHAPES + 1
    weights = np.zeros(size)
    if not n:
        return Scorer(weights)
    used, code = np.unique(feature, return_inverse=True)
    p, adam = np.zeros(len(used) + 1), Adam(len(used) + 1, 0.05)
    for _ in range(steps):
        miss = (sigmoid(np.bincount(of, p[code] * value, n) + p[-1]) - target) / n
        gradient = np.append(np.bincount(code, miss[of] * value, len(used)) + penalty * p[:-1], miss.sum())
        p += adam.step(gradient)
    weights[used], weights[-1] = p[:-1], p[-1]
    return Scorer(weights)


def patterns(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All vote patterns and how many texts have each."""
    prepare(docs.sparkSession)
    width = len(LABELLERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3**width, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                v = votes(measures(Words(batch.column(0).slice(a, b - a), lower=True)))
                total += np.bincount(v @ 3 ** np.arange(width), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    code = np.array([r[0] for r in rows], np.int64)
    return (code[:, None] // 3 ** np.arange(width)) % 3, np.array([r[1] for r in rows], np.float64)


def learn(docs: DataFrame, most_rows: int = 4000, text: str = "text", doc_id: str = "doc_id") -> tuple[LabelModel, Scorer]:
    """The label model of all texts; the scorer from about most_rows of them by hash."""
    model = estimate(*patterns(docs, text))
    rows = sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ("text",), most_rows, "text", ("doc_id", "text"))
    column = pa.array([r[0] for r in rows], pa.string())
    target = [model.posterior(votes(measures(Words(column.slice(a, b - a), lower=True)))) for a, b in slices(column)]
    return model, fit(column, np.concatenate([np.zeros(0), *target]))


def score(docs: DataFrame, scorer: Scorer, model: LabelModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of every row, with score (the scorer's, 0 to 1), weak_label (the posterior of the votes) and
    kept (score >= 0.5).

    A null or empty text has no words and is scored by its votes. Repeated rows each get their row; other columns are not
    read; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer, model))
    extra = T.StructType().add("score", "double").add("weak_label", "double").add("kept", "boolean")

    def run(column: pa.Array) -> list[pa.Array]:
        words = Words(column, lower=True)
        s = sent.value[0].scores(words)
        return [pa.array(s), pa.array(sent.value[1].posterior(votes(measures(words)))), pa.array(s >= 0.5)]

    return score_texts(docs, text, carry, extra, run)
