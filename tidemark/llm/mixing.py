"""Mixing sources to target weights, in DataFrame operations.

Tokens (words) are summed per source, targets are filled up by weight under a ceiling of `most` times each source's
size, and each document is emitted floor(rate) times plus once more if its hash, as a number from 0 to 1, is under
the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, keep, unused

#: Sources beyond this number are joined by a shuffle; up to it their table goes to every task.
FEW_SOURCES = 10_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: str, text: str) -> Column:
    """A number from 0 to 1 by the hash of the seed, the id and the text; null counts as empty."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 13), 16, 10).cast("long") * F.lit(2.0**-52)


def numbered(sources: DataFrame, by: str) -> DataFrame:
    """Adds place: 0 for the smallest value by code point, and so on, null last. Only the number of rows in each of
    the sorted parts comes to the driver, so that no task has all sources."""
    ordered = keep(sources.withColumn("_null", F.col(by).isNull()).withColumn("_key", F.col(by).cast("string").cast("binary")).repartitionByRange(F.col("_null"), F.col("_key")).sortWithinPartitions("_null", "_key").withColumn("_part", F.spark_partition_id()))
    before, sizes = 0, []
    for r in sorted(ordered.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        sizes.append((r["_part"], before))
        before += r["count"]
    if not sizes:
        return ordered.select(*sources.columns, F.lit(0).cast("long").alias("place"))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in sizes for x in pair]), F.col("_part")).cast("long")
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_key")) - 1 + start).select(*sources.columns, "place")


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float, source: str = "source") -> DataFrame:
    """sizes: (source, source_size). Adds target: shares of total_share times all sizes by weight, none above `most`
    times its size; what is above goes to the others by weight, again and again until none is above."""
    placed = keep(numbered(sizes, source).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))))
    top = F.col("source_size") * F.lit(float(most))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    budget, level, before = float(total) * total_share, 0.0, -1
    while True:  # the level only rises, and each round but the last takes at least one source to its ceiling
        full = top <= F.lit(level) * F.col("weight")
        r = placed.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if r[2] == before or not r[1]:
            break
        before, level = r[2], (budget - (r[0] or 0.0)) / r[1]
    if not placed.isEmpty() and not r[1]:
        return placed.withColumn("target", top).drop("place", "weight")
    return placed.withColumn("target", F.least(top, F.lit(level) * F.col("weight"))).drop("place", "weight")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's doc_id, source and columns `carry`, with size (words), source_size, target, copies, taken
    (copies times size).

    A null text has size 0, and null is a source of its own, the last by order. A source without words has target 0 and
    its documents are not taken. The extra copy hangs on the hash of id, text and seed alone: repeated rows share it, and reruns agree. An
    empty table gives no rows. The sum of a source is made of partial sums, so that a hot source costs one row a task."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), draw(seed, doc_id, text).alias("_draw"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    sizes = docs.select(F.col(source).alias("source"), n_words(text).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    table = keep(targets(sizes, weights, total_share, most).select(F.col("source").alias("_s"), "source_size", "target"))
    few = table.count() <= FEW_SOURCES
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    extra = F.col("_draw") < F.col("_rate") - F.floor("_rate")
    return (
        rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_rate", rate)
        .withColumn("copies", (F.floor("_rate") + extra.cast("long")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
    )


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as mix() says, with copy_no from 1, in place of a column of that name if there is one. Nulls, empty
    texts and ties are as in mix(); a document without words is not taken, repeated rows are emitted each, an empty table gives no rows."""
    row = unused("_row", docs.columns)
    plain = docs.select(F.struct("*").alias(row), *docs.columns)
    mixed = mix(plain, carry=(row,), **how)
    kept = [c for c in docs.columns if c.lower() != "copy_no"]
    return mixed.where("copies > 0").select(*[F.col(row)[c].alias(c) for c in kept], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))
