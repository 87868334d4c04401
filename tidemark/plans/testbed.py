"""The driver's documents as records to be linked: copies are matches, the language is the country.

Names are the first five words, addresses the next fifteen between a house number and a postal code; gallery records lose the second
word of their names now and then, and S1 records gain a legal suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_source
from tidemark.workers import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country, source, truth_id (the S1 record of the same group, or null)."""
    t = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    t = t.select("doc_id", "lang", F.split(F.trim(F.lower(F.regexp_replace("text", "[ \\t\\n\\r\\f]+", " "))), " ").alias("t"))
    t = t.select("doc_id", "lang", F.slice("t", 1, 5).alias("n"), F.array_join(F.slice("t", 6, 15), " ").alias("rest")).withColumn("sig", F.array_join("n", " "))
    w = Window.partitionBy("lang", "sig")
    t = t.withColumns({"rn": F.row_number().over(w.orderBy("doc_id")), "n_same": F.count("*").over(w), "first_id": F.min("doc_id").over(w)})
    source = F.when((F.col("rn") == 1) & ((F.col("n_same") > 1) | (F.col("doc_id") % 5 != 0)), "S1").when(F.col("doc_id") % 2 == 0, "S2").otherwise("S3")
    t = t.withColumn("source", source)
    suffix = F.when(F.col("doc_id") % 4 == 0, " GmbH").when(F.col("doc_id") % 4 == 1, " Ltd.").when(F.col("doc_id") % 4 == 2, ", Inc").otherwise("")
    short = F.array_join(F.filter("n", lambda x, i: i != 1), " ")
    name = F.when(F.col("source") == "S1", F.concat("sig", suffix)).when(F.col("doc_id") % 3 == 0, short).otherwise(F.col("sig"))
    address = F.concat_ws(" ", F.length("sig").cast("string"), "rest", (10000 + F.length("rest") * 37 % 80000).cast("string"))
    truth = F.when((F.col("source") != "S1") & (F.col("n_same") > 1), F.concat(F.lit("S1-"), F.col("first_id").cast("string")))
    return t.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), F.col("lang").alias("country"), "source", truth.alias("truth_id"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Normalised S1 records and gallery."""
    raw = records(spark, sf_dir)
    return normalize_source(raw.where("source = 'S1'"), "latin"), normalize_source(raw.where("source <> 'S1'"), "latin")


def stored_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sides from one table in the shared folder, for what reads them several times: documents are read and normalised once."""
    both = written(normalize_source(records(spark, sf_dir), "latin"))
    return both.where("entity_id like 'S1-%'"), both.where("entity_id not like 'S1-%'")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("truth_id is not null").select(F.col("truth_id").alias("source1_entity_id"), F.col("entity_id").alias("candidate_entity_id"))
