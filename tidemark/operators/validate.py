"""Checks of contracts and of output files, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CANDIDATE as CANDIDATE_COLUMNS
from tidemark.operators.decision import CANDIDATE, S1
from tidemark.operators.features import feature_columns


def check_candidates(candidates: DataFrame, most: int = 30) -> DataFrame:
    """rule, violations."""
    missing = [c for c in CANDIDATE_COLUMNS if c not in candidates.columns]
    each = candidates.groupBy(S1).agg(F.count("*").alias("n"))
    twice = candidates.groupBy(S1, CANDIDATE).agg(F.count("*").alias("n")).where("n > 1")
    rules = [each.agg(F.count_if(F.col("n") > most).alias("v")).select(F.lit("too_many").alias("rule"), F.col("v").alias("violations")), twice.agg(F.count("*").alias("v")).select(F.lit("repeated_pair").alias("rule"), F.col("v").alias("violations"))]
    return rules[0].unionByName(rules[1]).unionByName(candidates.sparkSession.range(1).select(F.lit("missing_columns").alias("rule"), F.lit(len(missing)).cast("long").alias("violations")))


def check_features(features: DataFrame, train: bool) -> list[str]:
    """What is wrong with a feature table's columns; NaN are counted in one pass."""
    columns = feature_columns(features.columns)
    wrong = [] if columns else ["no feature columns"]
    wrong += [f"raw count: {c}" for c in features.columns if c.endswith("_count")]
    wrong += ["label missing"] * (train and "label" not in features.columns) + ["label present"] * (not train and "label" in features.columns)
    if columns:
        nan = features.agg(*[F.count_if(F.isnan(c) | F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
        wrong += [f"NaN: {c}" for c, n in nan.items() if n]
    return wrong


def missing_records(pairs: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """Pairs whose id no record has."""
    return pairs.join(records.select(F.col("entity_id").alias(column)), column, "left_anti")


HEADERS = {"matched_entity_ids": f"{S1}\tmatched_entity_ids", "candidate_entity_ids": f"{S1}\tcandidate_entity_ids"}


def validate_lines(lines: DataFrame, required: DataFrame, column: str = "matched_entity_ids", known: DataFrame | None = None) -> DataFrame:
    """rule, violations of an output file. lines: line_no (from 1), value. required: entity_id of each S1 record. known: entity_id of
    gallery records; without it no id is unknown."""
    empty = lines.agg(F.count("*").alias("n")).select(F.lit("empty_file").alias("rule"), (F.col("n") == 0).cast("long").alias("violations"))
    head = lines.where("line_no = 1")
    commas = head.agg(F.count_if(~F.contains("value", F.lit("\t")) & F.contains("value", F.lit(","))).alias("v"))
    header = head.agg(F.count_if(F.lower(F.trim("value")) != HEADERS[column]).alias("v"))
    body = lines.where("line_no > 1")
    bad = body.agg(F.count_if(~F.contains("value", F.lit("\t"))).alias("v"))
    rows = body.where(F.contains("value", F.lit("\t"))).select(F.substring_index("value", "\t", 1).alias("s1"), F.coalesce(F.get(F.split("value", "\t", 2), F.lit(1)), F.lit("")).alias("list"))
    twice = rows.groupBy("s1").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    ids = rows.select("s1", F.filter(F.transform(F.split("list", ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))
    inside = ids.agg(F.coalesce(F.sum((F.size("ids") > F.size(F.array_distinct("ids"))).cast("long")), F.lit(0)).alias("v"))
    each = ids.select("s1", F.explode("ids").alias("id"))
    own = each.agg(F.count_if(F.col("id").startswith("S1-")).alias("v"))
    prefix = each.agg(F.count_if(~F.col("id").rlike("^S[123]-")).alias("v"))
    absent = required.select(F.col("entity_id").alias("s1")).distinct().join(rows, "s1", "left_anti").agg(F.count("*").alias("v"))
    extra = rows.select("s1").distinct().join(required.select(F.col("entity_id").alias("s1")), "s1", "left_anti").agg(F.count("*").alias("v"))
    found = {"comma_header": commas, "header": header, "malformed_row": bad, "repeated_s1": twice, "repeated_id": inside, "self_match": own, "bad_prefix": prefix, "missing_s1": absent, "unexpected_s1": extra}
    if known is not None:
        found["unknown_id"] = each.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("v"))
    out = empty
    for rule, df in found.items():
        out = out.unionByName(df.select(F.lit(rule).alias("rule"), F.col("v").cast("long").alias("violations")))
    return out


def matches_outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning only: matched pairs that are no candidates."""
    return matches.join(candidates, [S1, CANDIDATE], "left_anti")
