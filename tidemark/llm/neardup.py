"""MinHash near-duplicates by a chosen-path set similarity join (after Christiani, Pagh and Sivertsen, 2018).

1. Every text becomes its set of word shingles. Texts of equal sets are one class, so copies cost one row each.
2. Every class gets `width` MinHash values, kept as 16 bits each. In each of `trees` independent trees, a node's classes branch by
   the values at places that a hash of the node chooses, 1/similarity places on average and one at least; the roots' children are
   named by all 64 bits, so that only classes which share a shingle meet there, and a class without company goes no further. The
   number of trees follows from `recall`, the share of pairs at the similarity that are to meet though all their nodes are large.
3. A node of at most `small` classes is compared exhaustively on the MinHash values. Of the candidates, those that agree closely enough,
   a forest of the closest ones is confirmed on the full shingle sets.
4. In a larger node every class is compared with the pivot, and what is confirmed is connected. If at most `small` classes are left
   unconnected with the pivot, these are compared with all classes of the node, a chunk at a time; otherwise the node branches again.
   What is still larger after `levels` goes into blocks, and every pair of blocks is compared.
5. Where a forest's edge is not confirmed, the candidates of its node that are not connected yet are compared on their full sets, all of
   them: no link is lost that a node holds.
6. Connected components of confirmed links give each document the least id that it can reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, Words, keep, marked_rows, mix, prepare, shingles, slices
from tidemark.llm.components import components, earlier_groups, joined_batches, reach, streamed


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.75
    shingle: int = 5
    #: Share of pairs at `similarity` that meet in some tree, if no node of theirs is small before the last level.
    recall: float = 0.99
    width: int = 64
    small: int = 4096
    levels: int = 8
    #: Levels at which larger nodes are compared with their pivots.
    pivot_levels: int = 2
    #: Words of a group's texts, beyond which its comparison is split.
    group_words: int = 1 << 21
    seed: int = 5
    #: Standard errors of the MinHash estimate by which candidates may fall short of the similarity.
    margin: float = 4.0

    @property
    def least_equal(self) -> int:
        """Equal MinHash places, of `width`, from which two classes are candidates."""
        p = self.similarity
        return int(np.floor(self.width * max(0.0, p - self.margin * (p * (1 - p) / self.width) ** 0.5)))

    @property
    def trees(self) -> int:
        """The least number of trees for `recall`, from the places that their roots draw and the chance that a pair shares a
        path from there to the last level, over the number of places in which a pair at the similarity agrees."""
        equal = np.arange(self.width + 1)
        share = equal / self.width
        weight = np.array([comb(self.width, int(e)) * self.similarity**e * (1 - self.similarity) ** (self.width - e) for e in equal])
        draw = min(1.0, 1 / (self.similarity * self.width))
        lost = np.zeros(self.width + 1)  # the chance that no path goes on from a node with the pair
        for _ in range(self.levels - 1):
            apart = 1 - share * (1 - lost)
            lost = (1 - draw * (1 - apart)) ** self.width - (1 - draw) ** self.width * (1 - apart)
        missed, trees = weight.copy(), 0
        while missed.sum() > 1 - self.recall and trees < MOST_TREES:
            missed *= (1 - share * (1 - lost)) ** int(chosen_places(root(trees, self), self).sum())
            trees += 1
        return trees


MOST_TREES = 64
#: Elements of sets that are compared with one set at a time.
CODES_AT_ONCE = 1 << 20


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(values: np.ndarray) -> pa.Array:
    """A matrix of bytes as a column of binaries."""
    n, w = values.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * w), pa.py_buffer(np.ascontiguousarray(values))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The other way: 16-bit MinHash values, a row for each class."""
    if not len(column):
        return np.zeros((0, width), np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), width)


def minhashes(values: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The least of `width` hashes over each set values[at[i]:at[i+1]], mixed; none of the sets is empty."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(at) - 1, width), np.uint64)
    for i in range(width):
        out[:, i] = mix(np.minimum.reduceat(values * odd[i], at[:-1]))
    return out


def low(values: np.ndarray) -> np.ndarray:
    """The 16 bits of each value that a sketch keeps."""
    return values.astype(np.uint16)


def root_children(values: np.ndarray, s: Settings) -> np.ndarray:
    """The nodes of the first level that each row of 64-bit MinHash values is in, in all trees."""
    place = mix(np.arange(s.width, dtype=np.uint64) + np.uint64(s.seed << 20))
    out = []
    for t in range(s.trees):
        r = root(t, s)
        chosen = np.flatnonzero(chosen_places(r, s)[0])
        out.append(mix(mix(r ^ place[chosen])[None, :] + values[:, chosen]))
    return np.concatenate(out, 1)


def sketches(docs: DataFrame, s: Settings, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each row: doc_id, text_key (a hash of the text), n_shingles, class (a hash of the set; null for none), sketch, nodes
    (of the first level)."""
    schema = docs.select(doc_id).toDF("doc_id").schema.add("text_key", "long").add("n_shingles", "long").add("class", "long").add("sketch", "binary").add("nodes", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                ids, keys, column = (c.slice(a, b - a) for c in batch.columns)
                values, at = shingles(Words(column, lower=True), s.shingle)
                n = np.diff(at)
                full = n > 0
                key, sketch = np.zeros(len(n), np.uint64), np.zeros((len(n), s.width * 2), np.uint8)
                nodes, off = np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int32)
                if full.any():
                    begin = at[:-1][full]
                    key[full] = mix(np.add.reduceat(mix(values), begin) ^ mix(n[full].astype(np.uint64)))
                    least = minhashes(values, np.append(begin, len(values)), s.width, s.seed)
                    sketch[full] = low(least).view(np.uint8).reshape(full.sum(), -1)
                    children = root_children(least, s)
                    nodes = children.ravel()
                    off[1:] = np.cumsum(full * children.shape[1])
                none = pa.array(~full)
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n), pc.if_else(none, pa.scalar(None, pa.int64()), _long(key)), pc.if_else(none, pa.scalar(None, pa.binary()), _rows(sketch)), pa.ListArray.from_arrays(pa.array(off), _long(nodes))], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)), F.col(text)).mapInArrow(run, schema)


def root(tree: int, s: Settings) -> np.ndarray:
    """The root's hash, in an array of one."""
    return mix(np.array([s.seed * 1000 + tree], np.uint64))


def chosen_places(nodes: np.ndarray, s: Settings) -> np.ndarray:
    """Which of `width` places each node branches by: each with probability 1 / (similarity * width), and that of the least hash."""
    place = mix(np.arange(s.width, dtype=np.uint64) + np.uint64(s.seed << 20))
    drawn = mix(nodes[:, None] ^ place) >> np.uint64(11)
    chosen = drawn.astype(np.float64) * 2.0**-53 < 1 / (s.similarity * s.width)
    chosen[np.arange(len(nodes)), drawn.argmin(1)] = True
    return chosen


def branch(nodes: np.ndarray, sketch: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The children (their hash, and the row each comes from) of rows at nodes."""
    place = mix(np.arange(s.width, dtype=np.uint64) + np.uint64(s.seed << 20))
    known, number = np.unique(nodes, return_inverse=True)
    row, column = np.nonzero(chosen_places(known, s)[number])
    return mix(mix(nodes[row] ^ place[column]) + sketch[row, column].astype(np.uint64)), row


def _children(rows: DataFrame, s: Settings) -> DataFrame:
    """rows: node, class, sketch. The next level: node, class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            children, row = branch(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2), s.width), s)
            yield pa.RecordBatch.from_arrays([_long(children), pa.array(batch.column(1).to_numpy()[row])], names=["node", "class"])

    return rows.select("node", "class", "sketch").mapInArrow(run, "node long, class long")


def forest(sketch: np.ndarray, root: np.ndarray, least: int) -> tuple[list[tuple[int, int]], list[list[int]], list[np.ndarray]]:
    """Of things with MinHash values, of which those of equal root are connected already: the closest edges that connect all
    whose values agree in `least` places or more, directly or through others. A list of edges, and for each part that they connect its edges'
    numbers and those of its things that agree so with one of another root."""
    names, label = np.unique(root, return_inverse=True)
    size = np.bincount(label)
    if len(names) < 2:
        return [], [], []
    main = np.flatnonzero(label == size.argmax()) if size.max() > 1 else np.zeros(1, np.int64)
    others = np.setdiff1d(np.arange(len(root)), main)
    place = np.full(len(root), -1)
    place[others] = np.arange(len(others))
    near = np.empty((len(others), len(root)), np.int16)
    for k, i in enumerate(others):
        near[k] = (sketch == sketch[i]).sum(1, dtype=np.int16)
    near[(near < least) | (label[others][:, None] == label[None, :])] = 0
    if not near.any():
        return [], [], []
    met = np.zeros(len(root), bool)
    met[others] = near.any(1)
    met[near.any(0)] = True
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(size)[:-1])
    done = np.zeros(len(root), bool)
    best, source = np.zeros(len(root), np.int16), np.zeros(len(root), np.int64)

    def absorb(of: int) -> None:
        done[members[of]] = True
        if place[members[of][0]] < 0:
            column = near[:, main]
            top = column.max(1)
            up = top > best[others]
            best[others[up]], source[others[up]] = top[up], main[column.argmax(1)[up]]
        else:
            for i in members[of]:
                up = near[place[i]] > best
                best[up], source[up] = near[place[i]][up], i
        best[done] = 0

    edges, parts, things = [], [], []
    for start in range(len(names)):
        if done[members[start][0]] or not met[members[start]].any():
            continue
        own, part = [start], []
        absorb(start)
        while best[j := int(best.argmax())]:
            part.append(len(edges))
            edges.append((j, int(source[j])))
            own.append(int(label[j]))
            absorb(int(label[j]))
        if part:
            inside = np.concatenate([members[k] for k in own])
            parts.append(part)
            things.append(inside[met[inside]])
    return edges, parts, things


def _edges(rows: DataFrame, s: Settings) -> DataFrame:
    """rows: node, class, sketch, root; no node has many classes. grp, u, v: the forest's edges in each node, and, with a null v,
    the classes u of each part of three or more; grp is 0 for a part of two."""

    def batch_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
        v = pa.concat_arrays([pa.nulls(len(u), pa.int64()) if v is None else pa.array(v) for _, u, v in found])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g for g, _, _ in found])), pa.array(np.concatenate([u for _, u, _ in found])), v], names=["grp", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined_batches(batches):
            node, own, sketch, root = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), s.width), part.column(3).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            two = cuts[:-1][np.diff(cuts) == 2]
            two = two[(root[two] != root[two + 1]) & ((sketch[two] == sketch[two + 1]).sum(1) >= s.least_equal)]
            found = [(np.zeros(len(two), np.int64), np.maximum(own[two], own[two + 1]), np.minimum(own[two], own[two + 1]))]
            for k in np.flatnonzero(np.diff(cuts) > 2):
                here = slice(cuts[k], cuts[k + 1])
                classes = own[here]
                edges, parts, things = forest(sketch[here], root[here], s.least_equal)
                for part_edges, inside in zip(parts, things, strict=True):
                    group = np.sort(classes[inside])
                    grp = mix(np.add.reduce(mix(group.view(np.uint64)), keepdims=True)).view(np.int64)[0] if len(group) > 2 else 0
                    ends = classes[np.array([edges[e] for e in part_edges])]
                    found.append((np.full(len(ends), grp), ends.max(1), ends.min(1)))
                    if grp:
                        found.append((np.full(len(group), grp), group, None))
            if any(len(u) for _, u, _ in found):
                yield batch_of(found)

    return rows.select("node", "class", "sketch", "root").repartition("node").sortWithinPartitions("node").mapInArrow(run, "grp long, u long, v long").distinct()


def _pivot_edges(large: DataFrame, s: Settings) -> DataFrame:
    """large: node, class, sketch, root, pivot. u, v: the classes that are candidates with their node's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2), s.width) == _matrix(batch.column(3), s.width)).sum(1) >= s.least_equal
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in batch.columns[:2]], names=["u", "v"])

    pivots = large.where(F.col("class") == F.col("pivot")).select(F.col("node").alias("n"), F.col("sketch").alias("pivot_sketch"), F.col("root").alias("pivot_root")).distinct()
    rows = large.join(pivots, F.col("node") == F.col("n")).where("root <> pivot_root")
    return rows.select(F.col("class").alias("u"), F.col("pivot").alias("v"), "sketch", "pivot_sketch").mapInArrow(run, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """pairs: u, v; texts: class, text. u, v, alike: whether 100 * intersection >= 75 * union of the full sets."""
    percent = round(100 * s.similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                one, other = (shingles(Words(batch.column(c).slice(a, b - a), lower=True), s.shingle) for c in (2, 3))
                owner = np.concatenate([np.repeat(np.arange(b - a), np.diff(at)) for _, at in (one, other)])
                values = np.concatenate([one[0], other[0]])
                order = np.lexsort((values, owner))
                owner, values = owner[order], values[order]
                common = np.bincount(owner[1:][(values[1:] == values[:-1]) & (owner[1:] == owner[:-1])], minlength=b - a)
                alike = common * (100 + percent) >= percent * (np.diff(one[1]) + np.diff(other[1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1)), pa.array(alike)], names=["u", "v", "alike"])

    first = pairs.join(texts.select(F.col("class").alias("u"), F.col("text").alias("t")), "u")
    both = first.join(texts.select(F.col("class").alias("v"), F.col("text").alias("w")), "v")
    return both.select("u", "v", "t", "w").mapInArrow(run, "u long, v long, alike boolean")


def split_groups(rows: DataFrame, most: int, words: int) -> DataFrame:
    """rows: grp, class, n_shingles. Groups of more than `most` classes, or of more than `words` shingles in all, in blocks, and a group
    for each pair of blocks: any two classes meet, and a group is no larger, but for a single class that is."""
    size = rows.groupBy(F.col("grp").alias("g")).agg(F.greatest(F.ceil(F.count("*") / F.lit(most / 3)), F.ceil(F.sum("n_shingles") / F.lit(words / 3))).alias("_n"), (F.count("*") > most).alias("_many"), (F.sum("n_shingles") > words).alias("_long"))
    sized = rows.join(size, F.col("grp") == F.col("g")).withColumn("_n", F.when(F.col("_many") | F.col("_long"), F.col("_n")).otherwise(1).cast("long"))
    each = sized.withColumn("_b", F.pmod(F.xxhash64("class", F.lit(11)), F.col("_n"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    name = F.when(F.col("_n") > 1, F.xxhash64("grp", F.least("_b", "_o"), F.greatest("_b", "_o"))).otherwise(F.col("grp"))
    return each.withColumn("grp", name).drop("g", "_n", "_many", "_long", "_b", "_o")


def exhaustive(groups: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """groups: grp, class, root; texts: class, text. Links u, v (v the least reached) within groups, on the full sets, by searching from
    each class among those not yet reached; classes of equal root are linked as they are. Two classes that share several groups are compared in the
    first one alone."""
    percent = round(100 * s.similarity)
    held = groups.groupBy(F.col("class").alias("_c")).agg(F.collect_set("grp").alias("groups"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(batches):
            own, root = group.column(1).to_numpy(), group.column(2).to_numpy()
            parts = [shingles(Words(group.column(4).slice(a, b - a), lower=True), s.shingle) for a, b in slices(group.column(4))]
            earlier = earlier_groups(group.column(3), int(group.column(0)[0].as_py()))
            values, n = np.concatenate([v for v, _ in parts]), np.concatenate([np.diff(at) for _, at in parts])
            at = np.concatenate([[0], np.cumsum(n)])
            known, code = np.unique(values, return_inverse=True)
            marked = np.zeros(len(known), bool)

            def linked(i: int, rest: np.ndarray, code=code, at=at, n=n, marked=marked, root=root, earlier=earlier) -> np.ndarray:
                hit = root[rest] == root[i]
                fit = np.flatnonzero((np.minimum(n[rest], n[i]) >= s.similarity * np.maximum(n[rest], n[i]) - 1e-9) & ~hit & ~(earlier[rest] & earlier[i]).any(1))
                marked[mine := code[at[i] : at[i + 1]]] = True
                ends = np.cumsum(n[rest[fit]])
                turns = np.append(np.searchsorted(ends, np.arange(CODES_AT_ONCE, ends[-1], CODES_AT_ONCE)), len(fit)) if len(fit) else []
                before = 0
                for to in np.unique(turns).astype(np.int64):  # many sets in turns of bounded size
                    part = rest[fit[before:to]]
                    if len(part):
                        size = n[part]
                        last = np.cumsum(size)
                        index = np.arange(last[-1]) - np.repeat(last - size, size) + np.repeat(at[part], size)
                        common = np.add.reduceat(marked[code[index]].astype(np.int32), last - size)
                        hit[fit[before:to]] = common * (100 + percent) >= percent * (size + n[i])
                    before = to
                marked[mine] = False
                return hit

            label = reach(len(own), linked)
            moved = (label != np.arange(len(own))) & (root != root[label])
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], names=["u", "v"])

    rows = groups.join(held, F.col("class") == F.col("_c")).join(texts, "class").select("grp", "class", "root", "groups", "text")
    return rows.repartition("grp").sortWithinPartitions("grp", "class").mapInArrow(run, "u long, v long").distinct()


def rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with the root of what the links connect."""
    roots = components(links).select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    return keep(classes.drop("root").join(roots, F.col("class") == F.col("_id"), "left").withColumn("root", F.coalesce("_root", "class")).drop("_id", "_root"))


def chunked(large: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """large: node, class, sketch, root, pivot_root, size, apart (how many aren't connected with the pivot). Of nodes with at most `small`
    apart, these with the others in chunks of `small`: node, class, sketch, root; and what is left of large."""
    few = large.where(F.col("apart") <= s.small)
    chunks = F.ceil((F.col("size") - F.col("apart")) / F.lit(s.small)).cast("long")
    joined = few.where("root = pivot_root").withColumn("_c", F.pmod(F.xxhash64("class", F.lit(13)), chunks))
    apart = few.where("root <> pivot_root").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    return joined.unionByName(apart).select(F.xxhash64("node", "_c").alias("node"), "class", "sketch", "root"), large.where(F.col("apart") > s.small)


def all_links(classes: DataFrame, fetch, s: Settings) -> DataFrame:
    """classes: class, sketch, nodes, n_shingles. fetch: makes the class and text of a table of classes. All confirmed links u, v."""
    classes = classes.withColumn("root", F.col("class"))
    level, found, links, hot = classes.select(F.explode("nodes").alias("node"), "class"), [], [], None
    for depth in range(1, s.levels + 1):
        sized = level.groupBy(F.col("node").alias("n")).agg(F.count("*").alias("size"), F.min("class").alias("pivot"))
        # only rows that have company go on; a hot node is one row of `sized`, and its rows can be split
        met = level.join(sized, F.col("node") == F.col("n"), "left").where(F.coalesce("size", F.lit(0)) > 1)
        placed = keep(met.select("node", "class", "size", "pivot").join(classes.select("class", "sketch", "root"), "class"))
        small, large = placed.where(F.col("size") <= s.small).select("node", "class", "sketch", "root"), placed.where(F.col("size") > s.small)
        if large.isEmpty():
            found.append(keep(_edges(small, s)))
            break
        if hot is None:  # deeper nodes have classes of these alone
            hot = keep(fetch(large.select("class").distinct()))
        if depth <= s.pivot_levels:
            links.append(keep(confirmed(_pivot_edges(large, s), hot, s).where("alike").select("u", "v")))
            classes = rooted(classes, union(links))
        seen = classes.select("class", F.col("root").alias("now"))
        pivots = seen.select(F.col("class").alias("pivot"), F.col("now").alias("pivot_root"))
        with_roots = large.join(seen, "class").drop("root").withColumnRenamed("now", "root").join(pivots, "pivot")
        apart = with_roots.groupBy(F.col("node").alias("n")).agg(F.count_if(F.col("root") != F.col("pivot_root")).alias("apart")).where("apart > 0")
        near, left = chunked(keep(with_roots.join(apart, F.col("node") == F.col("n")).drop("n")), s)
        here = small.unionByName(near)
        if depth == s.levels:
            rest = left.select(F.col("node").alias("grp"), "class", F.lit(0).alias("n_shingles"), "sketch", "root")
            here = here.unionByName(split_groups(rest, s.small, 1 << 60).select(F.col("grp").alias("node"), "class", "sketch", "root"))
        found.append(keep(_edges(here, s)))
        if left.isEmpty():
            break
        level = keep(_children(left, s))
    edges = keep(union(found))
    texts = keep(fetch(edges.select("u").unionByName(edges.select(F.col("v").alias("u"))).where("u is not null").distinct().withColumnRenamed("u", "class")))
    tested = keep(confirmed(edges.where("v is not null").select("u", "v").distinct(), texts, s))
    links.append(tested.where("alike").select("u", "v"))
    failed = edges.where("grp <> 0 and v is not null").join(tested.where("not alike"), ["u", "v"]).select("grp").distinct()
    if not failed.isEmpty():
        classes = rooted(classes, union(links))
        members = edges.where("grp <> 0 and v is null").select("grp", F.col("u").alias("class")).join(failed, "grp", "left_semi").join(classes.select("class", "n_shingles", "root"), "class")
        several = members.groupBy(F.col("grp").alias("g")).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        open_ = split_groups(members.join(several, F.col("grp") == F.col("g"), "left_semi"), s.small, s.group_words)
        links.append(keep(exhaustive(open_.select("grp", "class", "root"), texts, s)))
    return union(links)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def labelled(docs: DataFrame, s: Settings, text: str, doc_id: str) -> DataFrame:
    """Each row's doc_id, text_key, n_shingles, class, root (the component: a class) and component_id."""
    prepare(docs.sparkSession)
    rows = keep(sketches(docs, s, text, doc_id))
    # a class's sketch is the same in all its rows; `sample` finds one of its texts again
    classes = keep(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("sample"), F.min("sketch").alias("sketch"), F.min("nodes").alias("nodes"), F.min("n_shingles").alias("n_shingles")))
    own = docs.select(F.col(doc_id).alias("_own"), F.xxhash64(F.col(text)).alias("_own_key"), F.col(text).alias("text"))

    def fetch(wanted: DataFrame) -> DataFrame:
        keys = wanted.join(classes.select("class", "sample"), "class").select("class", F.col("sample.doc_id").alias("_id"), F.col("sample.text_key").alias("_key"))
        keys = keep(keys)
        found = marked_rows(own, "_own_key", keys, "_key").join(keys, (F.col("_own_key") == F.col("_key")) & F.col("_own").eqNullSafe(F.col("_id"))).select("class", "text")
        return found if unique else found.dropDuplicates(["class"])

    unique = rows.where("class is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    links = components(all_links(classes.select("class", "sketch", "nodes", "n_shingles"), fetch, s)).select(F.col("id").alias("class"), "root")
    roots = keep(classes.select("class", "least").join(links, "class", "left").withColumn("root", F.coalesce("root", "class")))
    ids = roots.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    labels = roots.join(ids, F.col("root") == F.col("_r")).select(F.col("class").alias("_c"), "root", "component_id")
    out = rows.drop("sketch", "nodes").join(labels, F.col("class") == F.col("_c"), "left").drop("_c")
    return out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A text without words, or null, has the empty set, is linked with nothing and is its own component. Ids may repeat
    or be null: each row is a document; a component's id is the least id of its rows, null if none has one. Rows of
    equal texts are one class. kept is doc_id = component_id, null being equal to null. Other columns are not read.
    An empty table gives no rows."""
    return labelled(docs, settings, text, doc_id).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def survivors(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row, of least id (then least hash of the text);
    all rows without words."""
    found = keep(labelled(docs, settings, text, doc_id))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("i"), F.col("text_key").alias("k"))).alias("f")).select("f.i", "f.k")
    stay = first.unionByName(found.where("root is null").select(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).distinct())
    own = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_own"), F.xxhash64(F.col(text)).alias("_own_key"))
    out = own.join(stay, (F.col("_own_key") == F.col("k")) & F.col("_own").eqNullSafe(F.col("i")), "left_semi")
    twice = found.where("class is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    if not twice.isEmpty():  # rows repeat: one of each
        wordy = F.coalesce(F.col(f"_row.`{text}`"), F.lit("")).rlike(WORD)
        out = out.where(wordy).dropDuplicates(["_own", "_own_key"]).unionByName(out.where(~wordy))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
