"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, linededup, linefreq, lm, mixing, neardup, quality, tokencount, toxicity

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and item."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", F.size("spans").cast("long").alias("n_regions"), F.lit(True).alias("contaminated"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.vocabulary(VOCABULARY))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.judge(table(spark, sf_dir, "documents")).drop("places").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severities(docs, toxicity.learn(docs, toxicity.graded(table(spark, sf_dir, "labels"))))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, scorer = quality.learn(docs)
    return quality.score(docs, scorer, model)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_mix_sources, op4_token_counts, op5_line_dedup, op6_quality_rules, op7_near_duplicates, op8_toxicity, op9_quality_classifier, op10_language_model)}
_WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": f"""WITH d AS (SELECT *, len({_WORDS.format(t="coalesce(text, '')")})::BIGINT AS size,
  ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
l AS (SELECT *, 2.0::DOUBLE * source_size AS top, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS budget FROM s),
o AS (SELECT *, (budget - coalesce(sum(top) OVER (ORDER BY top / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY top / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, row_number() OVER (ORDER BY top / w, source) AS rn FROM l),
v AS (SELECT arg_min(lev, rn) FILTER (top / w > lev) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN top ELSE least(top, level * w) END AS target FROM o, v),
r AS (SELECT d.doc_id, d.source, size, source_size, target, draw, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT * size)::BIGINT AS taken, source, (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies FROM r""",
    "op6_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {_WORDS.format(t="t")} AS w FROM d),
g AS (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
again AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY rid),
m AS (SELECT d.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, coalesce(again.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN again USING (rid)),
lines AS (SELECT rid, doc_id, source, text, p, len({_WORDS.format(t="ln")}) AS k, trim(regexp_replace(lower(ln), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT *, string_split(t, chr(10))[p] AS ln FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS p FROM d WHERE text IS NOT NULL)) WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')),
often AS (SELECT source, norm, min(doc_id) AS first FROM lines GROUP BY source, norm HAVING count(DISTINCT text) > 10),
lost AS (SELECT rid, sum(k)::BIGINT AS n FROM lines JOIN often ON lines.source IS NOT DISTINCT FROM often.source AND lines.norm = often.norm WHERE doc_id IS DISTINCT FROM first GROUP BY rid),
j AS (SELECT m.*, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(lost.n, 0) AS lost_words FROM m LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - lost_words >= 0.3 * n_words AS kept, lost_words FROM j""",
    "op7_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
f AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(least, w.doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN f ON f.a = w.doc_id""",
}
