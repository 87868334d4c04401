"""The learned re-ranking of candidates: 19 cheap features of a pair, a model over slices of cities, and its recall on another slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BlockingConfig
from tidemark.functions import similarity as sim
from tidemark.operators import blocking, learning
from tidemark.operators.features import flag, hashed_order
from tidemark.workers import written

KEYS = ["country", "s1", "g"]
PRUNER_FEATURES = (
    "word_cos", "char_cos", "n_key_legs", "f_exact", "f_addr", "f_pin", "f_bidir", "f_word", "f_char", "name_tsr", "addr_tsr", "name_ratio", "house_eq", "house_conflict",
    "name_ntok_s1", "name_ntok_g", "addr_ntok_g", "g_best_ratio", "g_rank",
)


def pruner_features(pairs: DataFrame, s1: DataFrame, gallery: DataFrame) -> DataFrame:
    """pairs (country, s1, g, legs, word_cos, char_cos and others) with a pf_ column for each of PRUNER_FEATURES. A gallery record's
    competition is among all the pairs given, in its country. A null text counts as empty, and has one token."""
    texts = ("name_norm", "address_norm", "address_numbers")
    a = s1.select("country", F.col("entity_id").alias("s1"), *[F.coalesce(c, F.lit("")).alias(f"a_{c}") for c in texts])
    b = gallery.select("country", F.col("entity_id").alias("g"), *[F.coalesce(c, F.lit("")).alias(f"b_{c}") for c in texts])
    house_a, house_b = blocking.first_number("a_address_numbers"), blocking.first_number("b_address_numbers")
    legs = {"f_exact": blocking.EXACT, "f_addr": blocking.ADDRESS, "f_pin": blocking.PIN, "f_bidir": blocking.BOTH_WAYS, "f_word": blocking.WORD, "f_char": blocking.CHAR}
    tokens = lambda c: (F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) + 1).cast("double")
    out = pairs.join(a, ["country", "s1"]).join(b, ["country", "g"])
    out = out.withColumns({f"pf_{name}": flag(blocking.has(bit)) for name, bit in legs.items()})
    out = out.withColumns({
        "pf_word_cos": F.col("word_cos"), "pf_char_cos": F.col("char_cos"), "pf_n_key_legs": F.col("pf_f_exact") + F.col("pf_f_addr") + F.col("pf_f_pin"),
        "pf_name_tsr": sim.token_set(F.col("a_name_norm"), F.col("b_name_norm")), "pf_addr_tsr": sim.token_set(F.col("a_address_norm"), F.col("b_address_norm")),
        "pf_name_ratio": sim.indel_ratio(F.col("a_name_norm"), F.col("b_name_norm")),
        "pf_house_eq": flag((house_a == house_b) & (house_a != "")), "pf_house_conflict": flag((house_a != house_b) & (house_a != "") & (house_b != "")),
        "pf_name_ntok_s1": tokens("a_name_norm"), "pf_name_ntok_g": tokens("b_name_norm"), "pf_addr_ntok_g": tokens("b_address_norm"),
    })
    theirs = Window.partitionBy("country", "g")
    out = out.withColumn("_h", F.round(F.col("word_cos") + F.col("char_cos") + 0.25 * F.col("pf_n_key_legs"), 9))
    out = out.withColumn("_most", F.max("_h").over(theirs))
    out = out.withColumns({"pf_g_best_ratio": F.when(F.col("_most") > 0, F.col("_h") / F.col("_most")).otherwise(1.0), "pf_g_rank": F.rank().over(theirs.orderBy(F.desc("_h"))).cast("double")})
    return out.select(*pairs.columns, *[F.col(f"pf_{c}") for c in PRUNER_FEATURES])


def columns() -> list[str]:
    return [f"pf_{c}" for c in PRUNER_FEATURES]


def city(records: DataFrame, country: str, pattern: str) -> DataFrame:
    """The country's records whose address has a word that the pattern matches whole."""
    return records.where((F.col("country") == country) & F.col("address_norm").rlike(rf"\b(?:{pattern})\b"))


def query_sample(records: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """The `most` records of least hash; ties by id."""
    return records.orderBy(hashed_order("entity_id", seed), "entity_id").limit(most)


def training_pairs(s1: DataFrame, gallery: DataFrame, truth: DataFrame, country: str, pattern: str, queries: int = 40_000, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Features and label of the best union_k pairs of a sample of a slice's S1 records. Written once: learning reads it in rounds."""
    asked, near = query_sample(city(s1, country, pattern), queries), city(gallery, country, pattern)
    pool = blocking.best(blocking.scored_pairs(asked, near, config=config), max(config.union_k, config.max_candidates))
    true = truth.select(F.col("source1_entity_id").alias("s1"), F.col("candidate_entity_id").alias("g")).distinct().withColumn("label", F.lit(1))
    return written(pruner_features(pool, asked, near).join(true, ["s1", "g"], "left").fillna(0, ["label"]))


def fit_pruner(train: DataFrame, held: DataFrame | None = None, rounds: int = 60, depth: int = 6) -> GBTClassificationModel:
    """Trees over training_pairs; rows of the slice held out stop the rounds early."""
    rows = train.select(*columns(), "label", F.lit(False).alias("is_val"))
    if held is None:
        return learning.fit_trees(rows.drop("is_val"), columns(), rounds, depth)
    return learning.fit_trees(rows.unionByName(held.select(*columns(), "label", F.lit(True).alias("is_val"))), columns(), rounds, depth)


def as_pruner(model: GBTClassificationModel, s1: DataFrame, gallery: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What blocking.generate_candidates takes: pairs with the model's probability as blocking_score."""
    def prune(pairs: DataFrame) -> DataFrame:
        kept = [c for c in pairs.columns if c != "blocking_score"]
        return learning.predict(pruner_features(pairs, s1, gallery), model, columns(), vetoes=False).select(*kept, F.col("prob").alias("blocking_score"))

    return prune


def pruner_recall(held: DataFrame, model: GBTClassificationModel, n_truth: int, cuts: tuple[int, ...] = (30, 40, 50)) -> DataFrame:
    """k, heuristic, pruner: the share of n_truth true pairs among the best k of each S1 record, by score and by model."""
    scored = learning.predict(held, model, columns(), vetoes=False)
    ranks = {f"_{c}": F.row_number().over(Window.partitionBy("country", "s1").orderBy(F.desc(c), "g")) for c in ("blocking_score", "prob")}
    hits = scored.withColumns(ranks).where("label = 1").select(F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k"), "_blocking_score", "_prob")
    share = lambda c: F.round(F.count_if(F.col(c) <= F.col("k")) / max(1, n_truth), 6)
    return hits.groupBy("k").agg(share("_blocking_score").alias("heuristic"), share("_prob").alias("pruner"))
