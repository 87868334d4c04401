"""Hashed word features of texts, bounded samples for fitting on the driver, and scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import TABLE, Words, byte_hashes, mix, prepare, slices

#: Bits of the feature hash.
BITS = 18
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def plain_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and text numbers of words, in lower case, without ASCII characters other than letters and digits, so that
    `word.` counts as `word`."""
    stays = _PLAIN[words.data]
    total = np.concatenate([[0], np.cumsum(stays)])
    off = total[words.off]
    some = np.diff(off) > 0
    return words.data[stays], np.append(off[:-1][some], off[-1]), words.doc_of()[some]


def _counted(of: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, n = np.unique((of << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), n


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, hashed words and how often each text has each."""
    data, off, of = plain_words(words)
    return _counted(of, byte_hashes(data, off), bits)


#: Bits of the features that a model lists one by one, wide enough that no two words share one.
WIDE = 40


def listed_features(words: Words, wanted: np.ndarray | None = None, starts: tuple[int, ...] = (4, 6, 8), times: tuple[int, ...] = (1, 2, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and features: hashed words and word beginnings of so many bytes, one feature for each number of
    `times` that the text has it at least. wanted: only these are asked for; others may be missing."""
    data, off, of = plain_words(words)
    size = np.diff(off)
    hashes, owners = [byte_hashes(data, off)], [of]
    so_far = np.zeros(len(of), np.uint64)
    for i in range(max(starts)):
        own = np.flatnonzero(size > i)
        so_far[own] += TABLE[i, data[off[:-1][own] + i]]
        if i + 1 in starts:
            hashes.append(mix(so_far[own] ^ np.uint64(i + 1)))
            owners.append(of[own])
    hashes, of = np.concatenate(hashes) & ~np.uint64((4 << 24) - 1), np.concatenate(owners)
    if wanted is not None:
        kept = np.zeros(1 << 20, bool)
        kept[wanted >> (WIDE - 20)] = True
        own = kept[(hashes >> np.uint64(44)).astype(np.int64)]
        hashes, of = hashes[own], of[own]
    of, feature, n = _counted(of, hashes, WIDE)
    out = [(of[n >= t], feature[n >= t] | k) for k, t in enumerate(times)]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def listed_features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """listed_features() of many texts, a slice at a time."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in slices(column):
        of, feature = listed_features(Words(column.slice(a, b - a), lower=True))
        parts.append((of + a, feature))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def share_below(share: float, *columns: str) -> Column:
    """Whether the row's hash, as a number from 0 to 1, is below `share`: the same rows in any partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(29), *columns), 11) * F.lit(2.0**-53)) < F.lit(share)


def sample(rows: DataFrame, columns: tuple[str, ...], most_rows: int, text: str, by: tuple[str, ...], most_bytes: int = 20_000) -> list[tuple]:
    """About most_rows rows by the hash of `by`, twice that at most, whose text has at most `most_bytes`; all of fewer rows.
    For fitting only; the bound does not grow with the corpus."""
    n = max(1, rows.count())
    few = rows.where(share_below(most_rows / n, *by)).where(F.octet_length(text) <= most_bytes)
    return [tuple(r) for r in few.select(*columns).limit(2 * most_rows).collect()]


def score_texts(docs: DataFrame, text: str, carry: tuple[str, ...], extra: T.StructType, score: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns `carry` of every row, with the columns `extra` that `score` makes of a batch of texts."""
    prepare(docs.sparkSession)
    schema = T.StructType(docs.select(*carry).schema.fields + extra.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(carry))):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(carry)]), *score(batch.column(len(carry)).slice(a, b - a))], names=schema.names)

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


class Adam:
    """Steps for a parameter vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
