"""Benchmark decontamination by q-gram filtering in diagonal bands, and banded alignment.

Texts and items are normalised: A-Z and the capitals of Latin-1 in lower case, every run of other ASCII characters than letters and digits one blank. A region is `REACH`
characters of an item (all of a shorter one) that occur in a text within a budget of EDITS of them in edits. By the q-gram
lemma it shares at least REACH + 1 - Q * (budget + 1) q-grams with the item on diagonals that differ by no more than
the budget. Shared q-grams are counted in bands of diagonals, twice that wide, that overlap by half, so that one band
has all of a region's. Windows that meet the bound are aligned in a band around their first q-gram.

The items go to every task in blocks of at most BLOCK_BYTES, one scan of the texts for each block; texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mix, prepare, slices, text_bytes

Q, REACH, EDITS = 10, 80, 0.08
#: Shorter items must occur as they are; those of fewer than Q characters are not searched.
SHORT = 25
BLOCK_BYTES = 2 << 20
_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where each begins in them, and each byte's place in its text as given."""
    raw, at = text_bytes(column)
    data = _FOLD[raw]
    accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)  # capitals U+00C0 to U+00DE
    data[1:][accented] += 0x20
    stays = np.ones(len(data), bool)
    stays[1:] = (data[1:] != 32) | (data[:-1] != 32)
    first = at[:-1][at[:-1] < at[1:]]
    stays[first] = True
    total = np.concatenate([[0], np.cumsum(stays)])
    kept = np.flatnonzero(stays)
    begin = total[at]
    return data[stays], begin, kept - np.repeat(at[:-1], np.diff(begin))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    low = np.ndarray((n,), "<u8", data.data, 0, (1,)).copy()
    high = np.ndarray((n,), "<u2", data.data, 8, (1,)).astype(np.uint64)
    return mix(low ^ mix(high))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.data, self.begin, _ = normalised(pa.array(texts, pa.string()))
        size = np.diff(self.begin)
        self.reach = np.minimum(size, REACH)
        self.budget = np.where(size < SHORT, 0, (self.reach * EDITS).astype(np.int64))
        self.least = np.maximum(1, self.reach + 1 - Q * (self.budget + 1))
        codes = grams(self.data)
        item = np.searchsorted(self.begin, np.arange(len(codes)), "right") - 1
        whole = np.arange(len(codes)) + Q <= self.begin[item + 1] if len(codes) else np.zeros(0, bool)
        place = np.flatnonzero(whole)
        order = np.argsort(codes[place], kind="stable")
        self.place, self.codes = place[order], codes[place][order]
        self.bits = max(20, int(len(self.codes) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.codes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def search(self, column: pa.Array) -> list[list[tuple[int, int, list[tuple[int, int]]]]]:
        """For each text its items: (number, normalised characters covered, spans of bytes of the text as given)."""
        data, begin, back = normalised(column)
        found: list[list] = [[] for _ in range(len(column))]
        codes = grams(data)
        at = np.flatnonzero(self.seen[(codes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(at) or not len(self.codes):
            return found
        lo, hi = np.searchsorted(self.codes, codes[at], "left"), np.searchsorted(self.codes, codes[at], "right")
        n = hi - lo
        p = np.repeat(at, n)
        o = self.place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        doc, item = np.searchsorted(begin, p, "right") - 1, np.searchsorted(self.begin, o, "right") - 1
        inside = p + Q <= begin[doc + 1]
        p, o, doc, item = p[inside], o[inside], doc[inside], item[inside]
        half = self.budget[item] + 1
        band = (p - o) // half
        # a pair counts in the band that begins in its half band and in the one before
        p, o, doc, item = (np.concatenate([x, x]) for x in (p, o, doc, item))
        band = np.concatenate([band, band - 1])
        order = np.lexsort((p, o, band, item, doc))
        p, o, doc, item, band = (x[order] for x in (p, o, doc, item, band))
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]))) if len(p) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(p))
        many = np.flatnonzero(ends - new >= self.least[item[new]]) if len(p) else []
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k in many:
            own = slice(new[k], ends[k])
            d, i = int(doc[new[k]]), int(item[new[k]])
            spans.setdefault((d, i), []).extend(self._windows(data, begin[d : d + 2], i, p[own], o[own]))
        for (d, i), parts in spans.items():
            joined: list[list[int]] = []
            for a, b in sorted(set(parts)):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            if joined:
                found[d].append((i, sum(b - a for a, b in joined), [(int(back[a]), int(back[b - 1]) + 1) for a, b in joined]))
        return found

    def _windows(self, data: np.ndarray, ends: np.ndarray, i: int, p: np.ndarray, o: np.ndarray) -> Iterator[tuple[int, int]]:
        """Windows of an item that meet the bound in a band, and are aligned within the budget: where they lie in the text."""
        reach, budget, least = int(self.reach[i]), int(self.budget[i]), int(self.least[i])
        last = int(self.begin[i + 1]) - reach
        places, first = np.unique(o, return_index=True)  # a q-gram of the item counts once
        done, found = -1, False
        # a region's first shared q-gram is at most budget * Q after its start; such starts are tried if no q-gram starts one
        after = np.concatenate([[self.begin[i]], places[:-1] + 1])
        early = ((1, k, x) for k, y in enumerate(places) for x in range(max(int(after[k]), int(y) - Q * budget), min(int(y), last + 1)))
        for turn, k, start in chain(((0, *x) for x in enumerate(np.minimum(places, last))), early):
            start = int(start)
            if turn and found:
                return
            if start < done:
                continue
            if np.searchsorted(places, start + reach - Q, "right") - np.searchsorted(places, start) < least:
                continue
            span = align(data, int(p[first[k]]) - (int(places[k]) - start), ends, self.data[start : start + reach].tolist(), 2 * budget)
            if span and span[0] <= budget:
                done, found = start + reach // 2, True
                yield span[1:]


def align(data: np.ndarray, start: int, ends: np.ndarray, pattern: list[int], width: int) -> tuple[int, int, int] | None:
    """The least number of edits by which the whole pattern is found in the text about `start`, on diagonals that differ from it
    by at most `width`, and where: edits, begin, end."""
    a, b = max(int(ends[0]), start - width), min(int(ends[1]), start + len(pattern) + width)
    if a >= b:
        return None
    text = data[a:b].tolist()
    off = start - a
    # cost[c]: edits of the pattern so far against a stretch of the text that ends before c; its begin beside it
    cost, begin = [0] * (len(text) + 1), list(range(len(text) + 1))
    for r, x in enumerate(pattern):
        lo, hi = max(0, off + r + 1 - width), min(len(text), off + r + 1 + width)
        new, new_begin = [len(pattern) + 1] * (len(text) + 1), [0] * (len(text) + 1)
        for c in range(lo, hi + 1):
            best, where = cost[c] + 1, begin[c]
            if c:
                if new[c - 1] + 1 < best:
                    best, where = new[c - 1] + 1, new_begin[c - 1]
                sub = cost[c - 1] + (text[c - 1] != x)
                if sub <= best:
                    best, where = sub, begin[c - 1]
            new[c], new_begin[c] = best, where
        cost, begin = new, new_begin
    c = min(range(len(cost)), key=cost.__getitem__)
    return (cost[c], a + begin[c], a + c) if c > begin[c] else None


def blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator[Index]:
    """The items, a bounded block at a time, each as an index; one of them is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
        if size >= BLOCK_BYTES:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    if texts:
        yield Index(ids, texts)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row for each text and item that it holds a region of: doc_id, item_id, matched (characters of the normalised text in
    regions), spans (begin and end in UTF-8 bytes of the text as given).

    Null and empty texts hold nothing, and null items are not searched; ids may repeat or be null, and each row is matched by itself. Items of equal
    text are found each. Other columns are not read. An empty table on either side gives no rows."""
    prepare(docs.sparkSession)
    span = T.StructType().add("begin", "long").add("end", "long")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("matched", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for index in blocks(benchmark, text, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    found = sent.value.search(batch.column(1).slice(a, b - a))
                    links = [(a + d, *x) for d, own in enumerate(found) for x in own]
                    if links:
                        ids = [sent.value.ids[x[1]] for x in links]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in links])), pa.array(ids), pa.array([x[2] for x in links], pa.int64()), pa.array([[{"begin": s, "end": e} for s, e in x[3]] for x in links], kind)], names=schema.names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs that hold no region of an item, as they are; a scan for each block, and no shuffle."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text)
    for index in blocks(benchmark, text, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(place)):
                    part = batch.slice(a, b - a)
                    yield part.filter(pa.array([not x for x in sent.value.search(part.column(place))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
