"""Readers and writers of the contracts."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RAW, RAW_SCHEMA
from tidemark.operators.decision import CANDIDATE, S1


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW) -> DataFrame:
    """A table of strings with a header, read by name; nulls are empty strings. A missing column is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False, enforceSchema=False)
    return raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def read_spine(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ("entity_id",))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id, candidate_entity_id: a row for each true pair."""
    return explode_truth(read_tsv(spark, path, (S1, "matched_entity_ids")))


def explode_truth(truth: DataFrame) -> DataFrame:
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.select(S1, F.explode(F.array_distinct(ids)).alias(CANDIDATE))


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).where("entity_id <> ''").distinct()


def read_token_map(spark: SparkSession, path: str) -> DataFrame:
    """token, replacement from a JSON object, a file of its own, or from parquet."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("token", "replacement"))
        return whole
    return spark.read.parquet(path).select("token", "replacement")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of a text file; malformed rows stay visible. The number is the place in the file, read as one part."""
    return spark.read.text(path, wholetext=True, lineSep=None).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)).alias("p", "value")).select((F.col("p") + 1).alias("line_no"), "value")


def exists(spark: SparkSession, path: str) -> bool:
    """Through the path's own file system, so that a remote store is asked and not the driver's disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def dataset_folder(spark: SparkSession, roots: tuple[str, ...]) -> str:
    """The first of roots that has a folder train; the first of all where none has."""
    return next((r for r in roots if exists(spark, f"{r}/train")), roots[0])


def read_model(spark: SparkSession, path: str, fallback: str | None = None) -> GBTClassificationModel:
    """The model of the last phase, or of the one before where there is none. A model that can't be read is an error."""
    return GBTClassificationModel.load(path if fallback is None or exists(spark, path) else fallback)


def read_calibrator(spark: SparkSession, path: str) -> IsotonicRegressionModel | None:
    return IsotonicRegressionModel.load(path) if exists(spark, path) else None


def write_model(model: GBTClassificationModel | IsotonicRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_summary(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON object, as a file in the folder."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_records(df: DataFrame, path: str, by_country: bool = False) -> None:
    """Parquet; by country, so that later reads of one are pruned."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("country") if by_country else writer).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def write_id_list(df: DataFrame, path: str, column: str = "entity_id") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_splits(entities: DataFrame, folder: str) -> None:
    """entities: entity_id, country, split. Lists train and val, and val of each country."""
    for split in ("train", "val"):
        write_id_list(entities.where(F.col("split") == split), f"{folder}/{split}")
    entities.where("split = 'val'").select("entity_id", "country").write.mode("overwrite").partitionBy("country").text(f"{folder}/val_by_country")


def write_token_map(table: DataFrame, path: str) -> None:
    table.select("token", "replacement").write.mode("overwrite").parquet(path)
