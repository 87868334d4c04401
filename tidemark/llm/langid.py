"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A text becomes letters in lower case, with one blank for every run of other characters and at both ends; its n-grams
of 1 to 3 characters are counted, and the `ranks` most frequent ones, in order, are its profile. A language's profile has the most
frequent n-grams of all its training texts. A text's language is that of the least out-of-place distance: the sum over
the text's n-grams of the difference in rank, `ranks` for those that the language's profile lacks.

Training counts are summed in each batch, then by Spark; what comes to the driver is `ranks` n-grams a language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, prepare, slices

RANKS = 300
LONGEST = 3
UNDETERMINED = "und"
#: Parts in which a language's n-grams are ranked; PARTS * RANKS of them at most come to the driver.
PARTS = 16


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, n-grams (21 bits a character), counts in order of text and n-gram; and whether each text has a letter."""
    points = np.frombuffer("\n".join((x or "").lower() for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len((x or "").lower()) for x in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)[: len(points)]
    letter = _letters()[points]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    # one blank for each run of others; a blank parts two texts and serves both
    stays = letter.copy()
    stays[1:] |= letter[:-1]
    code = np.where(letter, points, 32).astype(np.int64)[stays]
    owner = owner[stays]
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    begin = np.flatnonzero(new)
    code, owner = np.insert(code, begin, 32), np.insert(owner, begin, owner[begin])  # the blank before the first word
    last = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(owner) - 1) if len(owner) else np.zeros(0, np.int64)
    open_end = last[code[last] != 32]
    code, owner = np.insert(code, open_end + 1, 32), np.insert(owner, open_end + 1, owner[open_end])
    grams, of = [code], [owner]
    for n in range(2, LONGEST + 1):
        if len(code) >= n:
            one = owner[n - 1 :] == owner[: len(owner) - n + 1]
            joined = functools.reduce(lambda a, i: (a << 21) | code[i : len(code) - n + 1 + i], range(1, n), code[: len(code) - n + 1])
            grams.append(joined[one])
            of.append(owner[n - 1 :][one])
    gram, of = np.concatenate(grams), np.concatenate(of)
    plain = gram != 32
    gram, of = gram[plain], of[plain]
    # sorting text by text is faster than one sort by two keys
    order = np.argsort(of, kind="stable")
    gram, of = gram[order], of[order]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        gram[a:b].sort()
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    return of[at], gram[at], np.diff(np.append(at, len(gram))), has


def top(of: np.ndarray, gram: np.ndarray, n: np.ndarray, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, n-grams and ranks (from 0) of each text's most frequent n-grams; of equally frequent ones the least code comes first."""
    order = np.lexsort((gram, -n, of))
    of, gram = of[order], gram[order]
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
    most = rank < ranks
    return of[most], gram[most], rank[most]


class Profiles:
    """The languages' ranks as a matrix over all n-grams that are in any profile."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS):
        self.names = sorted({r[0] for r in rows})
        self.ranks = ranks
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.table = np.full((len(self.grams), len(self.names)), -1, np.int64)
        for name, gram, rank in rows:
            self.table[np.searchsorted(self.grams, gram), self.names.index(name)] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        of, gram, n, has = counts(texts)
        out, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.names or not len(of):
            return out, score
        of, gram, rank = top(of, gram, n, self.ranks)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        place = np.where((self.grams[at] == gram)[:, None], self.table[at], -1)
        far = np.where(place < 0, self.ranks, np.abs(place - rank[:, None]))
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        total = np.add.reduceat(far, begin)
        best = total.argmin(1)
        least = total[np.arange(len(total)), best]
        second = np.partition(total, 1, axis=1)[:, 1] if len(self.names) > 1 else self.ranks * np.diff(np.append(begin, len(of)))
        for k, d in enumerate(of[begin]):
            if has[d]:
                out[d] = self.names[best[k]]
                score[d] = (second[k] - least[k]) / max(second[k], 1)
        return out, np.clip(score, 0.0, 1.0)


def learn(docs: DataFrame, ranks: int = RANKS, text: str = "text", lang: str = "lang") -> list[tuple[str, int, int]]:
    """(language, n-gram, rank) of each language among the rows with one, counted over all their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for a, b in slices(batch.column(1)):
                of, gram, n, _ = counts(batch.column(1).slice(a, b - a).to_pylist())
                names, code = np.unique(np.array(batch.column(0).slice(a, b - a).to_pylist(), object).astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    own = code[of] == i
                    g0, n0 = sums.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    g, where = np.unique(np.concatenate([g0, gram[own]]), return_inverse=True)
                    sums[name] = g, np.bincount(where, np.concatenate([n0, n[own]]), len(g)).astype(np.int64)
            if sum(len(g) for g, _ in sums.values()) > 500_000:
                yield from given(sums)
                sums = {}
        yield from given(sums)

    def given(sums: dict) -> Iterator[pa.RecordBatch]:
        for name, (g, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    sums = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the first of each of PARTS parts of a language's n-grams come here, so that no task ranks all of a language
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(PARTS))).orderBy(F.desc("n"), "gram")
    first: dict[str, list[tuple[int, int]]] = {}
    for name, gram, n in sums.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= ranks).select("lang", "gram", "n").collect():
        first.setdefault(name, []).append((-n, gram))
    return [(name, gram, rank) for name, grams in first.items() for rank, (_, gram) in enumerate(sorted(grams)[:ranks])]


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of every row, with lang_pred and score: the lead of the best language over the second, as a share of the
    second's distance.

    A text that is null or has no letter is `und` with score 0, as is every text if no language was learned. Ties go to the first name. Repeated
    rows each get their row; other columns are not read; an empty table gives no rows."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(carry))):
                names, score = sent.value.predict(batch.column(len(carry)).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


def held_out_predictions(docs: DataFrame, folds: int = 4, out: int = 2, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Learns from the rows whose crc32 of the id modulo `folds` isn't `out`, predicts all: doc_id, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    held = crc_mod(doc_id, folds) == out
    profiles = Profiles(learn(docs.where(~held), text=text, lang=lang))
    found = identify(docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")), profiles, carry=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
