"""Toxicity grades by cumulative-link ordinal regression on hashed words.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector serves all thresholds, which stay in order because their
gaps are exponentials. x has a 1 for each word or word beginning that the text holds once, twice or four times at
least, so that a long text dilutes nothing; only features that tell grades apart beyond chance are used. It is fitted by full-gradient steps on the driver from about `most_rows` labelled texts; every text is then scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Words, prepare
from tidemark.llm.linear import Adam, listed_features, listed_features_of, score_texts, share_below, sigmoid


@dataclass
class Ordinal:
    features: np.ndarray  # those with a weight, in order
    weights: np.ndarray
    thresholds: np.ndarray  # grades less one; infinite ones for grades that were never seen

    def chances(self, of: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade = k) for n texts, a row each."""
        x = np.zeros(n)
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            own = self.features[at] == feature
            x = np.bincount(of[own], self.weights[at[own]], n)
        below = np.column_stack([np.zeros(n), *(sigmoid(t - x) for t in self.thresholds), np.ones(n)])
        return np.diff(below, axis=1)


def telling(of: np.ndarray, feature: np.ndarray, grade: np.ndarray, least_z: float = 5.0, sign: int = 0) -> np.ndarray:
    """The features whose share of texts differs between grade 0 and the others by least_z standard errors (sign 1:
    is larger in these): a word by chance does not, though there are hundreds of thousands of them."""
    used, code, texts = np.unique(feature, return_inverse=True, return_counts=True)
    high = grade > 0
    n1, n0 = high.sum(), (~high).sum()
    hits = np.bincount(code, high[of], len(used))
    share = (texts + 1) / (n1 + n0 + 2)
    z = (hits / n1 - (texts - hits) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return used[(z * sign if sign else np.abs(z)) >= least_z]


def fit(of: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, steps: int = 400, penalty: float = 5e-5) -> Ordinal:
    """of, feature: which text has which feature; grade: of each text, 0 to grades - 1. Without texts of grade 0 and of
    another the weights are 0 and the thresholds put all chance on what was seen, or on grade 0."""
    n = len(grade)
    share = np.array([(grade <= k).mean() if n else 1.0 for k in range(grades - 1)])
    thresholds = np.where(share >= 1, 30.0, -30.0)
    inner = np.flatnonzero((share > 0) & (share < 1) & np.append(True, np.diff(share) > 0))  # thresholds with texts on both sides
    if not len(inner):
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), thresholds)
    ends = np.log(share[inner] / (1 - share[inner]))
    used = telling(of, feature, grade) if (grade == 0).any() else np.zeros(0, np.int64)
    own = np.isin(feature, used)
    of, code, k = of[own], np.searchsorted(used, feature[own]), len(used)
    p = np.concatenate([np.zeros(k), [ends[0]], np.log(np.maximum(np.diff(ends), 1e-3))])
    adam = Adam(len(p), 0.05)
    weigh = np.where(grade == 0, 0.5 / max(1, (grade == 0).sum()), 0.5 / max(1, (grade > 0).sum()))  # grade 0 as much as all others
    level = np.searchsorted(inner, grade)  # inner[level - 1] < grade <= inner[level]

    def cuts() -> np.ndarray:
        return np.cumsum(np.concatenate([[p[k]], np.exp(p[k + 1 :])]))

    for _ in range(steps):
        w, c = p[:k], cuts()
        x = np.bincount(of, w[code], n)
        high, low = sigmoid(np.append(c, np.inf)[level] - x), sigmoid(np.append(-np.inf, c)[level] - x)
        inside = np.maximum(high - low, 1e-12)
        dh, dl = weigh * high * (1 - high) / inside, weigh * low * (1 - low) / inside  # of the mean log chance, by either bound
        gc = np.bincount(level, -dh, len(c) + 1)[:-1] + np.bincount(level, dl, len(c) + 1)[1:]
        tail = np.cumsum(gc[::-1])[::-1]
        p += adam.step(np.concatenate([np.bincount(code, (dh - dl)[of], k) + penalty * w, [tail[0]], tail[1:] * np.exp(p[k + 1 :])]))
    # a threshold without texts beyond it stays far out; one between two equal shares joins the one below it
    for at, c in zip(inner, cuts(), strict=True):
        thresholds[at:] = np.where(share[at:] >= 1, 30.0, c)
    return Ordinal(used, p[:k], thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade (0 or 1): whether a text is toxic. Repeated labels of an id count by their worst; labels without an
    id, or without a toxic value, are no labels."""
    worst = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("t"))
    return worst.select("doc_id", (F.col("t") > 0).cast("int").alias("grade"))


def split_grades(of: np.ndarray, feature: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Grades 0 and 1 made 0, 1 and 2: of the toxic texts, those with more features that tell for toxicity than the median one."""
    if not (grade > 0).any() or not (grade == 0).any():
        return grade
    n = np.bincount(of[np.isin(feature, telling(of, feature, grade, sign=1))], minlength=len(grade))
    return grade + ((grade > 0) & (n > np.median(n[grade > 0])))


def learn(docs: DataFrame, grades: DataFrame, n_grades: int = 2, split: bool = True, most_rows: int = 6000, text: str = "text", doc_id: str = "doc_id") -> Ordinal:
    """Fits on about most_rows labelled texts, of each grade as many at most, by the hash of the id, and of at most
    20,000 bytes. split: labels of two grades are made three."""
    prepare(docs.sparkSession)
    n = {r["grade"]: r["count"] for r in grades.groupBy("grade").count().collect()}
    each = most_rows // n_grades
    chosen = grades.where("false")
    for g in range(n_grades):
        chosen = chosen.unionByName(grades.where((F.col("grade") == g) & share_below(each / max(1, n.get(g, 0)), "doc_id")).limit(2 * each))
    # a bounded number of ids, whatever the corpus
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = [tuple(r) for r in joined.where(F.octet_length("text") <= 20_000).select("text", "grade").limit(2 * most_rows).collect()]
    of, feature = listed_features_of(pa.array([r[0] for r in rows], pa.string()))
    grade = np.array([r[1] for r in rows], np.int64)
    return fit(of, feature, split_grades(of, feature, grade) if split else grade, n_grades + split)


def severities(docs: DataFrame, model: Ordinal, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of every row, with severity (the expected grade), p_toxic (the chance of a grade over 0),
    grade (the likeliest) and toxic (p_toxic >= 0.5).

    A null or empty text is scored as one without words. Repeated rows each get their row; other columns are not
    read; an empty table gives no rows. Without labels, every severity is 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = T.StructType().add("severity", "double").add("p_toxic", "double").add("grade", "integer").add("toxic", "boolean")

    def score(column: pa.Array) -> list[pa.Array]:
        of, feature = listed_features(Words(column, lower=True), sent.value.features)
        p = sent.value.chances(of, feature, len(column))
        return [pa.array(p @ np.arange(p.shape[1])), pa.array(1 - p[:, 0]), pa.array(p.argmax(1).astype(np.int32)), pa.array(p[:, 0] <= 0.5)]

    return score_texts(docs, text, carry, extra, score)
