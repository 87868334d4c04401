"""Connected components: over tables by alternating large-star and small-star rounds (Kiveris et al., 2014), within a
task by search; and groups that are too large for a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, prepare


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's neighbours (the larger ones, or the others) to its least one. The least of each vertex is
    an aggregate that partial sums precede, and is joined back, so that a hub's links never meet in one task."""
    around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
    linked = around.join(least, F.col("u") == F.col("w"))
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


#: Links that one task connects at once.
IN_ONE_TASK = 1 << 20


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the links u, v with the least vertex of its component: labels fall to the least around, and to the label's own
    label, until none does."""
    ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(links: DataFrame, most_rounds: int = 60, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """links: columns u, v, long. Returns id, root: every linked vertex with the least vertex of its component.

    Nulls and loops are not links. Up to in_one_task links are connected by one task. More of them go in rounds over tables: each round is
    written to the shared folder; a count and a sum of hashes tell whether anything has changed."""
    pairs = keep(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct())
    if pairs.count() <= in_one_task:
        prepare(links.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if parts:
                u, v = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, connected(u, v))), names=["id", "root"])

        return pairs.repartition(1).mapInArrow(run, "id long, root long")
    seen = None
    for _ in range(most_rounds):
        # a state: links, and a number that changes with them
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        pairs = keep(_star(keep(_star(pairs, True)), False))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def blocked(rows: DataFrame, group: str, member: str, size: str, most: int) -> DataFrame:
    """Rows of groups of more than `most` members in blocks of about a quarter of that, and a group for each pair of
    blocks: any two members meet, and no group is much over half of `most`. Other groups stay as they are."""
    blocks = F.when(F.col(size) > most, F.ceil(F.col(size) / F.lit(most / 4))).otherwise(1).cast("long")
    dealt = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(member, F.lit(11)), F.col("_n")))
    each = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    name = F.when(F.col("_n") > 1, F.xxhash64(group, F.least("_b", "_o"), F.greatest("_b", "_o"))).otherwise(F.col(group))
    return each.withColumn(group, name).drop("_n", "_b", "_o")


def earlier_groups(groups: pa.Array, own: int) -> np.ndarray:
    """groups: of each class the groups that it is in. Which of those below `own` each class is in, a column for each."""
    owner, value = pc.list_parent_indices(groups).to_numpy(), pc.list_flatten(groups).to_numpy()
    less = value < own
    names, column = np.unique(value[less], return_inverse=True)
    out = np.zeros((len(groups), len(names)), bool)
    out[owner[less], column] = True
    return out


def joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces about as large as they come, cut where the first column changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield _one(held)
            held = []
        change = np.flatnonzero(key[1:] != key[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield _one([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield _one(held)


def reach(n: int, linked) -> np.ndarray:
    """Labels of n things: linked(i, rest) tells which of `rest` are linked with i. Each is compared with those not yet reached."""
    label = np.full(n, -1)
    rest = np.arange(n)
    while len(rest):
        start, queue = rest[0], [rest[0]]
        label[start], rest = start, rest[1:]
        while queue and len(rest):
            hit = linked(queue.pop(), rest)
            found = rest[hit]
            label[found] = start
            queue.extend(found.tolist())
            rest = rest[~hit]
    return label


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as one batch for each value of the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield _one(held)
                held = []
            held.append(part)
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
