"""Quality rules with cross-document line frequency, in DataFrame and SQL functions only.

Lines are normalised (lower case, white space runs as one space), hashed, and counted per host over distinct
documents. A line that more than `max_docs` of them hold is removed from all but the first of them by id, and a document
that keeps less than `least_left` of its words is rejected, as is one that fails the base rules. Documents of equal
text count as one, however many ids they have: copies are the concern of near-duplicate removal, and boilerplate is what differing
documents share. Where all documents with a line have a null id, none is the first, and the line stays.

The line table has ids, hashes and counts, no text. Counts are partly summed before each exchange, and the join
of lines with the frequent ones is a plain equi-join, so that adaptive execution can split a hot line's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, unused

SYMBOLS = "#*$%&|<>"
_GAP = r"[\\x20\\x09-\\x0D]+"  # as in a SQL string literal


def repeated_words(words: str) -> str:
    """SQL for the number of words in the 5-word windows that occur twice or more in the array `words`, an attribute
    or a lambda's variable. Windows are compared by 64-bit hashes; only an array with equal ones is sorted."""
    hashed = f"transform(sequence(1, size({words}) - 4), i -> xxhash64(slice({words}, i, 5)))"
    # v: windows with their places, in order of hash; p: places of the windows that have an equal neighbour there
    twins = "filter(transform(v, (e, i) -> if(get(v, i - 1).h <=> e.h or get(v, i + 1).h <=> e.h, e.i, null)), e -> e is not null)"
    covered = "aggregate(transform(p, (e, i) -> least(5, coalesce(get(p, i + 1), e + 5) - e)), 0L, (a, e) -> a + e)"
    slow = f"transform(array(array_sort(transform(h, (e, i) -> named_struct('h', e, 'i', i)))), v -> transform(array(array_sort({twins})), p -> {covered})[0])[0]"
    return f"if(size({words}) < 6, 0L, transform(array({hashed}), h -> if(size(array_distinct(h)) = size(h), 0L, {slow}))[0])"


def measures(text: str) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the column `text`; the split text
    is bound to a lambda's variable, so that it is made once a row."""
    q = f"coalesce(`{text}`, '')"
    lines = f"filter(split({q}, '\\\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    symbols = f"cast(length({q}) - length(translate({q}, '{SYMBOLS}', '')) as bigint)"
    return F.expr(
        f"transform(array(filter(split({q}, '{_GAP}', -1), w -> w <> '')), w -> named_struct("
        f"'n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), 'n_symbols', {symbols}, "
        f"'n_dup_lines', transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) as bigint))[0], "
        f"'n_repeat_words', {repeated_words('w')}))[0]"
    )


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def content_key(text: str, host: str) -> Column:
    """With the id, the identity of a row: rows that agree in id, text and host are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(host).cast("string"), F.lit("")), F.col(host).isNull())


def frequent_line_places(docs: DataFrame, max_docs: int = 10, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """For each document that loses lines: _id, _key, places (of the lost lines, from 0) and lost_words."""
    rows = docs.select(F.col(doc_id).alias("_id"), content_key(text, host).alias("_key"), F.xxhash64(F.col(text)).alias("_text"), F.col(host).cast("string").alias("_host"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("_place", "_line"))
    words = F.regexp_count(F.col("_line"), F.lit(WORD))
    normal = F.trim(F.regexp_replace(F.lower(F.col("_line")), r"[\x20\x09-\x0D]+", " "))
    lines = rows.select("_id", "_key", "_text", "_host", "_place", F.xxhash64(normal).alias("_hash"), words.alias("_words")).where("_words > 0")
    often = lines.groupBy("_host", "_hash").agg(F.countDistinct("_text").alias("_docs"), F.min("_id").alias("_first")).where(F.col("_docs") > max_docs)
    often = often.select(F.col("_host").alias("_h"), F.col("_hash").alias("_o"), "_first")
    lost = lines.join(often, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_hash") == F.col("_o"))).where(~F.col("_id").eqNullSafe(F.col("_first")))
    once = lost.groupBy("_id", "_key", "_place").agg(F.max("_words").alias("_words"))  # repeated rows are one document
    return once.groupBy("_id", "_key").agg(F.collect_set("_place").alias("places"), F.sum("_words").cast("long").alias("lost_words"))


def judge(docs: DataFrame, max_docs: int = 10, least_left: float = 0.3, text: str = "text", host: str = "source", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the five measures, base_failed, lost_words, kept, places (null: no line lost)
    and the columns `carry`.

    A null or empty text has no words, so it fails the base rules and is not kept. A null host is a host of its own. A
    null id is an id like others. Repeated rows get the same results. Other columns are not read, so that names
    don't clash. An empty table gives no rows."""
    lost = frequent_line_places(docs, max_docs, text, host, doc_id).select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "places", "lost_words")
    base = docs.select(F.col(doc_id).alias("_id"), content_key(text, host).alias("_key"), measures(text).alias("_m"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    out = base.join(lost, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    left = F.col("_m.n_words") - F.coalesce(F.col("lost_words"), F.lit(0))
    return out.select(
        F.col("_id").alias("doc_id"), "_m.*", base_failed().alias("base_failed"), F.coalesce("lost_words", F.lit(0).cast("long")).alias("lost_words"),
        (~base_failed() & (left >= least_left * F.col("_m.n_words"))).alias("kept"), "places", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )


def clean(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs that are kept, their frequent lines removed; columns, whatever their names, and their order stay. Nulls, empty texts, ties
    and repeated rows are as in judge(): a text without words goes, repeated rows stay or go together. An empty table stays empty."""
    row = unused("_row", docs.columns)
    judged = judge(docs.select(F.struct("*").alias(row), *docs.columns), text=text, carry=(row,), **how).where("kept")
    own = F.col(row)[text]
    left = F.when(F.col("places").isNull(), own).otherwise(F.array_join(F.filter(F.split(own, "\n", -1), lambda _, i: ~F.array_contains("places", i)), "\n"))
    return judged.select(*[left.alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns])
