"""TF-IDF as a long table, and similarity joins over it.

A term's weight is (1 + ln tf) * idf, by the gallery of its partition alone, over terms that the document-frequency
bounds leave; norms are over these. Where no bound is given, every term counts: those that many records of a block have
are multiplied as a matrix, the others by their postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import words
from tidemark.workers import prepare, written

#: Query records of a partition that one task holds while the gallery streams past, products that it adds at once, sums that it keeps at once, and
#: pairs that it finds before it looks for those that stay.
BLOCK, PRODUCTS, SUMS, HELD = 1 << 14, 1 << 20, 1 << 20, 1 << 19
#: Terms that over this share of a block's query records, and so many of them, have are columns of a matrix; so many columns at most.
COMMON_SHARE, COMMON_ROWS, COLUMNS = 0.04, 256, 256


def word_terms(record: DataFrame) -> Column:
    return words(F.concat_ws(" ", "name_norm", "address_norm"))


def char_terms(c: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """All character n-grams of a text without blanks."""
    t = F.replace(c, F.lit(" "), F.lit(""))

    def of(n: int) -> Column:
        places = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substr(t, i, F.lit(n)))

    return F.concat(*[of(n) for n in sizes])


def term_counts(records: DataFrame, terms: Column, partition: str = "country") -> DataFrame:
    each = records.select(partition, "entity_id", F.explode(terms).alias("term"))
    return each.groupBy(partition, "entity_id", "term").agg(F.count("*").alias("tf"))


def gallery_terms(gallery: DataFrame, counts: DataFrame, max_df: float, max_rows: int, min_df: int = 1, min_df_over: int = 100, partition: str = "country") -> DataFrame:
    """partition, term, idf of the terms that stay: all of at most 1000 gallery rows, else those in no more than
    max(2, min(max_df * rows, max_rows)) of them; and, of over min_df_over rows, in at least min_df."""
    n = gallery.groupBy(partition).agg(F.count("*").alias("n"))
    df = counts.groupBy(partition, "term").agg(F.count("*").alias("df"))
    cap = F.when(F.col("n") <= 1000, F.col("n")).otherwise(F.greatest(F.lit(2), F.least(F.floor(F.col("n") * F.lit(max_df)), F.lit(max_rows))))
    low = F.when(F.col("n") > min_df_over, min_df).otherwise(1)
    kept = df.join(n, partition).where((F.col("df") <= cap) & (F.col("df") >= low))
    return kept.select(partition, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, terms: DataFrame, sublinear: bool = True, partition: str = "country") -> DataFrame:
    """partition, entity_id, term, w: vectors of length 1."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = counts.join(terms, [partition, "term"]).withColumn("w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(partition, "entity_id")))
    return raw.select(partition, "entity_id", "term", (F.col("w") / norm).alias("w"))


def top(pairs: DataFrame, by: str, other: str, n: int, partition: str = "country") -> DataFrame:
    """The n best pairs of each `by`; ties by id."""
    rank = F.row_number().over(Window.partitionBy(partition, by).orderBy(F.desc("cos"), other))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def tfidf_weights(s1: DataFrame, gallery: DataFrame, terms, max_df: float, max_rows: int, min_df: int = 1, sublinear: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vectors of both sides; terms makes an array of terms of a record."""
    counts = term_counts(gallery, terms(gallery))
    kept = written(gallery_terms(gallery, counts, max_df, max_rows, min_df))
    return weights(term_counts(s1, terms(s1)), kept, sublinear), weights(counts, kept, sublinear)


def best_of(vectors: tuple[DataFrame, DataFrame], threshold: float, n: int, partition: str = "country") -> DataFrame:
    """partition, s1, g, cos, rank: the n best gallery records of each query record over the threshold; ties by id."""
    found = met([vectors], [(threshold, n)], partition=partition).where("legs = 1")
    return top(found.select(partition, "s1", "g", F.col("cos")[0].alias("cos")), "s1", "g", n, partition)


def best_for(vectors: tuple[DataFrame, DataFrame], threshold: float, n: int, partition: str = "country") -> DataFrame:
    """partition, s1, g, cos, rank: the n best query records of each gallery record over the threshold; ties by id."""
    found = met([vectors], [(1e9, 0)], (threshold, n), partition=partition).where("back")
    return top(found.select(partition, "s1", "g", F.col("cos")[0].alias("cos")), "g", "s1", n, partition)


def met(vectors: list[tuple[DataFrame, DataFrame]], best: list[tuple[float, int]], back: tuple[float, int] | None = None, pairs: DataFrame | None = None, partition: str = "country") -> DataFrame:
    """partition, s1, g, legs, back, given, cos: each pair once, with its cosines by all vectors (rounded, so that the order of a sum decides no tie), that

    - bit k of legs: is one of the best[k] = (threshold, n) of its query record by vectors[k] = (query vectors, gallery vectors), ties by id;
    - back: may be one of the back = (threshold, n) of its gallery record by vectors[0]: it is among the query records of one task;
    - given: has these bits in pairs (partition, s1, g, leg).

    Query records go into blocks. A task holds one and adds up its products with the gallery of the partition, which streams past in the order of ids:
    of all pairs with a common term, only those that stay leave the task."""
    prepare(vectors[0][0].sparkSession)

    def entries(rows: list[DataFrame], names: bool) -> DataFrame:
        parts = [v.select(partition, "entity_id", F.lit(k).alias("k"), "term", "w") for k, v in enumerate(rows)]
        if names and pairs is not None:
            parts.append(pairs.select(partition, F.col("s1").alias("entity_id"), F.lit(-1).alias("k"), F.col("g").alias("term"), F.col("leg").cast("double").alias("w")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        one = lambda k, c: F.transform(F.filter("e", lambda x: x["k"] == k), lambda x: x[c]).alias(f"{c}{k + 1}")
        return out.where(F.col(partition).isNotNull()).groupBy(partition, "entity_id").agg(F.collect_list(F.struct("k", "term", "w")).alias("e")).select(partition, "entity_id", *[one(k, c) for k in range(-1, len(rows)) for c in ("term", "w")])

    # both are written, so that what was shuffled for vectors is gone before copies of the gallery are shuffled
    queries, gallery = written(entries([a for a, _ in vectors], True)), written(entries([b for _, b in vectors], False))
    blocks = queries.groupBy(partition).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_n"))
    hashed = F.pmod(F.xxhash64(F.lit(29), "entity_id"), F.col("_n"))
    asked = queries.join(blocks, partition).withColumns({"side": F.lit(0), "block": hashed}).drop("_n")
    passing = gallery.join(blocks, partition).withColumns({"side": F.lit(1), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))}).drop("_n")
    schema = T.StructType([queries.schema[partition], T.StructField("s1", T.StringType()), T.StructField("g", T.StringType()), T.StructField("legs", T.IntegerType()), T.StructField("back", T.BooleanType()), T.StructField("given", T.IntegerType()), T.StructField("cos", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, block, side = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            code = own.indices.to_numpy()
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                name = (own.dictionary[int(code[a])].as_py(), int(block[a]))
                if name != key:
                    if cell is not None:
                        yield from cell.close()
                    cell, key = _Cell(name[0], best, back, schema), name
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    cell.ask(part)
                else:
                    yield from cell.meet(part)
        if cell is not None:
            yield from cell.close()

    spark = vectors[0][0].sparkSession
    columns = [partition, "block", "side", "entity_id", *[f"{c}{k}" for k in range(len(vectors) + 1) for c in ("term", "w")]]
    rows = asked.select(*columns).unionByName(passing.select(*columns)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), partition, "block")
    return rows.sortWithinPartitions(partition, "block", "side", "entity_id").mapInArrow(run, schema)


class _Cell:
    """A block of query records and what is found of them. asked, and then met, get rows in the order of ids."""

    def __init__(self, partition: str, best: list[tuple[float, int]], back: tuple[float, int] | None, schema: T.StructType):
        self.partition, self.best, self.back, self.names = partition, best, back, schema.names
        self.parts: list[pa.RecordBatch] = []
        self.n, self.first = 0, 0  # query records, and gallery records that have passed
        self.ids: list[pa.Array] = []
        self.held: list[dict[str, np.ndarray]] = []
        self.size, self.kept = 0, 0

    def ask(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _lists(self, part: pa.RecordBatch, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Rows, terms and weights of column pair k."""
        terms = part.column(4 + 2 * k)
        return pc.list_parent_indices(terms).to_numpy(zero_copy_only=False), terms.flatten(), part.column(5 + 2 * k).flatten().to_numpy(zero_copy_only=False)

    def _begin(self) -> None:
        whole = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        self.parts, self.n, self.s1 = [], whole.num_rows, whole.column(3)
        self.posts, self.common = [], []  # of each vector: postings; and the columns of common terms (-1: none), with their weights in each query record
        for k in range(len(self.best) + 1):
            row, terms, w = self._lists(whole, k)
            coded = terms.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            column = np.full(len(coded.dictionary), -1)
            if k:
                size = np.bincount(code, minlength=len(column))
                many = np.argsort(-size, kind="stable")[:COLUMNS]
                many = many[size[many] > max(COMMON_ROWS, COMMON_SHARE * self.n)]
                column[many] = np.arange(len(many))
                dense, at = np.zeros((len(many), self.n)), column[code] >= 0
                np.add.at(dense, (column[code[at]], row[at]), w[at])
                self.common.append((column, dense))
                row, code, w = row[~at], code[~at], w[~at]
            order = np.argsort(code, kind="stable")
            self.posts.append((coded.dictionary, np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]), row[order], w[order]))
        self.used = np.zeros(len(self.posts[0][0]), bool)  # given gallery records that have passed
        self.floor = [np.full(self.n, -np.inf) for _ in self.best]
        self.step = max(1, SUMS // self.n)
        self.sums = [np.zeros(self.step * self.n) for _ in self.best]

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._begin()
        if not self.n:
            return
        self.ids.append(part.column(3))
        # for each vector: gallery row, code of the term, weight, and the weights of common terms; and the given pairs
        mine = []
        for k in range(1, len(self.best) + 1):
            row, terms, w = self._lists(part, k)
            code = pc.fill_null(pc.index_in(terms, self.posts[k][0]), -1).to_numpy(zero_copy_only=False)
            row, code, w = row[code >= 0], code[code >= 0], w[code >= 0]
            column, dense = self.common[k - 1]
            at = column[code] >= 0
            whole = np.zeros((part.num_rows, len(dense)))
            np.add.at(whole, (row[at], column[code[at]]), w[at])
            mine.append((row[~at], code[~at], w[~at], whole))
        given = pc.fill_null(pc.index_in(part.column(3), self.posts[0][0]), -1).to_numpy(zero_copy_only=False)
        self.used[given[given >= 0]] = True
        for a in range(0, part.num_rows, self.step):
            self._some(a, min(a + self.step, part.num_rows), mine, given)
        self.first += part.num_rows
        if self.size > self.kept + HELD:
            self._prune()
        yield from ()

    def _spread(self, k: int, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each entry its postings: the entry, the sum's place, the posting."""
        at = self.posts[k][1]
        size = at[code + 1] - at[code]
        which = np.repeat(np.arange(len(row)), size)
        post = np.arange(len(which)) + np.repeat(at[code] - np.cumsum(size) + size, size)
        return which, row[which] * self.n + self.posts[k][2][post], post

    def _some(self, a: int, b: int, mine: list, given: np.ndarray) -> None:
        touched, found = [], []
        for k, (row, code, w, whole) in enumerate(mine):
            lo, hi = np.searchsorted(row, [a, b])
            at = self.posts[k + 1][1]
            ends = np.concatenate([[0], np.cumsum(at[code[lo:hi] + 1] - at[code[lo:hi]])])
            dense = whole[a:b].any()
            many = dense or ends[-1] > SUMS // 4
            if dense:
                np.matmul(whole[a:b], self.common[k][1], out=self.sums[k][: (b - a) * self.n].reshape(b - a, self.n))
            i = 0
            while i < hi - lo:  # pieces of about PRODUCTS, whatever the rows have in common
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + PRODUCTS, "right")) - 1)
                which, place, post = self._spread(k + 1, row[lo + i : lo + j] - a, code[lo + i : lo + j])
                np.add.at(self.sums[k], place, w[lo + i : lo + j][which] * self.posts[k + 1][3][post])
                if not many:
                    touched.append((k, place))
                i = j
            if many:
                touched.append((k, slice(None)))
        for k, place in touched:
            least = self.best[k][0] if self.best[k][1] else np.inf
            if k == 0 and self.back:
                least = min(least, self.back[0])
            over = self.sums[k][place] > least - 1e-8
            found.append(np.flatnonzero(over) if isinstance(place, slice) else np.unique(place[over]))
        row = np.flatnonzero(given[a:b] >= 0)
        which, place, post = self._spread(0, row, given[a:b][row])
        bits = np.zeros(0, np.int64)
        if len(place):
            place, where = np.unique(place, return_inverse=True)
            bits = np.zeros(len(place), np.int64)
            np.bitwise_or.at(bits, where, self.posts[0][3][post].astype(np.int64))
            found.append(place)
        places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if len(places):
            out = {"s": (places % self.n).astype(np.int32), "g": places // self.n + a + self.first, "given": np.zeros(len(places), np.int32), "back": np.zeros(len(places), bool)}
            out["given"][np.searchsorted(places, place)] = bits
            out |= {f"cos{k}": np.round(x[places], 9) for k, x in enumerate(self.sums)}
            if self.back:
                may = np.flatnonzero(out["cos0"] > self.back[0])
                out["back"][may[_ranks(out["g"][may], out["cos0"][may], out["s"][may]) < self.back[1]]] = True
            stay = out["back"] | (out["given"] != 0)
            for k, (least, n) in enumerate(self.best):
                if n:
                    stay |= (out[f"cos{k}"] > least) & (out[f"cos{k}"] > self.floor[k][out["s"]])
            self.held.append({c: x[stay] for c, x in out.items()})
            self.size += int(stay.sum())
        for k, place in touched:
            self.sums[k][place] = 0

    def _prune(self) -> None:
        """Leaves of the pairs held those that stay, with the bits of legs; what is to come has to be over the last of the best, since ids grow."""
        all_ = {c: np.concatenate([x[c] for x in self.held]) for c in self.held[0] if c != "legs"}
        self.held = []
        legs = np.zeros(len(all_["s"]), np.int32)
        for k, (least, n) in enumerate(self.best):
            if n:
                may = np.flatnonzero(all_[f"cos{k}"] > least)
                rank = _ranks(all_["s"][may], all_[f"cos{k}"][may], all_["g"][may])
                legs[may[rank < n]] |= 1 << k
                last = may[rank == n - 1]
                self.floor[k][all_["s"][last]] = all_[f"cos{k}"][last]
        stay = all_["back"] | (all_["given"] != 0) | (legs != 0)
        self.held = [{c: x[stay] for c, x in all_.items()} | {"legs": legs[stay]}]
        self.size = self.kept = int(stay.sum())

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._begin()
        if self.held:
            self._prune()
            held, ids = self.held[0], pa.chunked_array(self.ids).combine_chunks()
            for a in range(0, self.size, 1 << 16):
                x = {c: v[a : a + (1 << 16)] for c, v in held.items()}
                yield self._out(self.s1.take(pa.array(x["s"])), ids.take(pa.array(x["g"])), x["legs"], x["back"], x["given"], np.stack([x[f"cos{k}"] for k in range(len(self.best))], 1))
        # given pairs whose gallery record has no vector
        names, at, row, bits = self.posts[0] if self.n else ([], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
        code = np.repeat(np.arange(len(names)), np.diff(at))
        left = np.flatnonzero(~self.used[code]) if len(code) else []
        if len(left):
            pair, where = np.unique(code[left] * self.n + row[left], return_inverse=True)
            given = np.zeros(len(pair), np.int32)
            np.bitwise_or.at(given, where, bits[left].astype(np.int32))
            none = np.zeros(len(pair))
            yield self._out(self.s1.take(pa.array(pair % self.n)), names.take(pa.array(pair // self.n)), none.astype(np.int32), none.astype(bool), given, np.zeros((len(pair), len(self.best))))

    def _out(self, s1: pa.Array, g: pa.Array, legs: np.ndarray, back: np.ndarray, given: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cos) + 1, dtype=np.int32) * cos.shape[1]), pa.array(cos.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([self.partition] * len(cos), pa.string()), s1, g, pa.array(legs), pa.array(back), pa.array(given.astype(np.int32)), lists], names=self.names)


def _ranks(group: np.ndarray, value: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Places from 0 within the group, by falling value."""
    order = np.lexsort((tie, -value, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return out


def array_top(vectors: DataFrame, key: str, vector: str, n: int, queries: Column) -> DataFrame:
    """The n nearest other rows by cosine for the rows where `queries` holds: a stated query set against all rows. Queries go into blocks. A task
    holds one and multiplies it with rows that stream past, in the order of ids; only the n best of each query leave it. A place that is null
    or that only one of two vectors has adds nothing to their product; vectors without a place have no cosine."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x"), queries.alias("is_query")).where(F.size("x") > 0)
    asked = rows.where("is_query")
    n_blocks = asked.agg(F.greatest(F.ceil(F.count("*") / F.lit(NEAR_BLOCK)), F.lit(1)).alias("_n"))
    a = asked.crossJoin(F.broadcast(n_blocks)).select(F.pmod(F.xxhash64(F.lit(31), "id"), F.col("_n")).alias("block"), F.lit(0).alias("side"), "id", "x")
    b = rows.crossJoin(F.broadcast(n_blocks)).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("block"), F.lit(1).alias("side"), "id", "x")
    schema = T.StructType([T.StructField("query_id", rows.schema["id"].dataType), T.StructField("near_id", rows.schema["id"].dataType), T.StructField("cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                if own[lo] != block:
                    if near is not None:
                        yield from near.close()
                    near, block = _Near(n), own[lo]
                part = batch.slice(lo, hi - lo)
                near.ask(part) if side[lo] == 0 else near.meet(part)
        if near is not None:
            yield from near.close()

    spark = vectors.sparkSession
    dealt = a.unionByName(b).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "side", "id")
    return dealt.mapInArrow(run, schema).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "near_id"))).where(F.col("rank") <= n)


#: Query vectors that one task holds, and rows that they are multiplied with at once.
NEAR_BLOCK, NEAR_ROWS = 2048, 512


class _Near:
    """A block of query vectors with the best rows so far, which are met in the order of ids."""

    def __init__(self, n: int):
        self.n, self.parts = n, []

    def ask(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    @staticmethod
    def _matrix(lists: pa.Array) -> np.ndarray:
        """Vectors of length 1, as rows; shorter ones end in zeros, and a null is a zero."""
        x = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False)
        row, size = pc.list_parent_indices(lists).to_numpy(), pc.list_value_length(lists).to_numpy()
        out = np.zeros((len(lists), int(size.max())))
        out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=np.full_like(out, np.nan), where=norm > 0)

    def meet(self, part: pa.RecordBatch) -> None:
        if self.parts:
            whole = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
            self.parts, self.ids, self.x = [], whole.column(2), self._matrix(whole.column(3))
            self.own = self.ids.to_numpy(zero_copy_only=False)
            self.best, self.near = np.full((len(self.x), self.n), -np.inf), np.zeros((len(self.x), self.n), self.own.dtype)
        for a in range(0, part.num_rows, NEAR_ROWS):
            some = part.slice(a, NEAR_ROWS)
            y, ids = self._matrix(some.column(3)), some.column(2).to_numpy(zero_copy_only=False)
            d = min(y.shape[1], self.x.shape[1])
            cos = np.round(self.x[:, :d] @ y[:, :d].T, 6)
            cos = np.where(np.isnan(cos) | (self.own[:, None] == ids), -np.inf, cos)
            # those so far have lower ids, so that a stable order decides ties
            both = np.concatenate([self.best, cos], 1)
            names = np.concatenate([self.near, np.broadcast_to(ids, cos.shape)], 1)
            order = np.argsort(-both, axis=1, kind="stable")[:, : self.n]
            self.best, self.near = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def close(self) -> Iterator[pa.RecordBatch]:
        row, place = np.nonzero(self.best > -np.inf)
        kind = self.ids.type
        yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), pa.array(self.near[row, place], kind), pa.array(self.best[row, place])], names=["query_id", "near_id", "cos"])
