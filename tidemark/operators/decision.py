"""From match probabilities to one answer for each S1 record."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DecisionConfig
from tidemark.functions.similarity import prior_shift
from tidemark.workers import written

S1, CANDIDATE = "source1_entity_id", "candidate_entity_id"


def apply_hard_vetoes(features: DataFrame, prob: str = "prob", address_most: float = 0.30, name_most: float = 0.30, embedding_most: float = 0.40) -> DataFrame:
    """Probability 0 where house numbers conflict in unlike addresses; and where names and embeddings are both unlike, if
    any embedding of the whole table isn't 0. That flag is one row, joined as a scalar."""
    any_embedding = features.agg(F.coalesce(F.max(F.abs("sem__embedding_cosine")) > 0, F.lit(False)).alias("_any"))
    house = (F.col("addr__house_number_conflict") > 0) & (F.col("addr__lev_ratio") < address_most)
    name = F.col("_any") & (F.col("name__lev_ratio") < name_most) & (F.col("sem__embedding_cosine") < embedding_most)
    return features.crossJoin(F.broadcast(any_embedding)).withColumn(prob, F.when(house | name, 0.0).otherwise(F.col(prob))).drop("_any")


def shift_prior(pairs: DataFrame, alpha: float, prob: str = "prob") -> DataFrame:
    return pairs.withColumn(prob, prior_shift(F.col(prob), alpha))


def expected(pairs: DataFrame, prob: str = "prob", formula: str = "expected", min_prob: float = 0.0) -> DataFrame:
    """Adds k, cum, total, ef (the expected F0.5 of taking the first k) and ef0 (of taking none)."""
    group = Window.partitionBy(S1)
    order = group.orderBy(F.desc(prob), CANDIDATE)
    p = pairs.where(F.col(prob) >= min_prob)
    p = p.withColumns({"k": F.row_number().over(order), "cum": F.sum(prob).over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(prob).over(group), "ef0": F.product(1 - F.col(prob)).over(group)})
    rest = F.col("cum") if formula == "pdf" else F.col("total")
    ef = F.round(1.25 * F.col("cum") / (F.col("k") + 0.25 * rest), 12)
    return p.withColumns({"ef": ef, "ef0": F.lit(0.0) if formula == "pdf" else F.round("ef0", 12)})


def select_matches(pairs: DataFrame, prob: str = "prob", formula: str = "expected", min_prob: float = 0.0) -> DataFrame:
    """The pairs up to the least k of the greatest expected F0.5 of each S1 record, if that is more than of taking none."""
    group = Window.partitionBy(S1)
    scored = expected(pairs, prob, formula, min_prob).withColumn("best", F.max(F.struct("ef", (-F.col("k")).alias("k"))).over(group))
    return scored.where((F.col("best.ef") > F.col("ef0")) & (F.col("k") <= -F.col("best.k"))).select(*pairs.columns)


def enforce_exclusivity(selected: DataFrame, prob: str = "prob", tie_break: str = "smallest") -> DataFrame:
    """Each candidate for the S1 record of greatest probability alone; a tie for the smallest id, or the largest."""
    order = Window.partitionBy(CANDIDATE).orderBy(F.desc(prob), F.col(S1).asc() if tie_break == "smallest" else F.col(S1).desc())
    return selected.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def decide(pairs: DataFrame, config: DecisionConfig = DecisionConfig(), prob: str = "prob") -> DataFrame:
    if config.prior_shift != 1.0:
        pairs = shift_prior(pairs, config.prior_shift, prob)
    chosen = select_matches(pairs, prob, config.formula, config.min_prob)
    return enforce_exclusivity(chosen, prob, config.tie_break) if config.exclusivity else chosen


def f05(tp: Column, fp: Column, fn: Column) -> Column:
    """1 if there is nothing to find and nothing found, 0 without a hit."""
    return F.when(tp + fn == 0, F.when(fp == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise(1.25 * tp / (1.25 * tp + 0.25 * fn + fp))


def entity_scores(selected: DataFrame, truth: DataFrame, entities: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each of entities (source1_entity_id and the columns `by`): tp, fp, fn, f05. An entity without any row counts as empty."""
    keys = [*by, S1]
    a = selected.select(*keys, CANDIDATE).distinct().withColumn("_p", F.lit(1))
    b = truth.select(S1, CANDIDATE).distinct().withColumn("_t", F.lit(1))
    b = entities.select(*keys).distinct().join(b, S1) if by else b
    both = a.join(b, [*keys, CANDIDATE], "full").groupBy(*keys).agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    out = entities.select(*keys).distinct().join(both, keys, "left").fillna(0, ["tp", "fp", "fn"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f05(selected: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    return entity_scores(selected, truth, entities).agg(F.count("*").alias("entities"), F.round(F.avg("f05"), 6).alias("macro_f05"))


def threshold_scores(pairs: DataFrame, truth: DataFrame, entities: DataFrame, thresholds: tuple[float, ...], formula: str = "pdf", prob: str = "prob") -> DataFrame:
    """threshold, source1_entity_id, tp, fp, fn, f05 at each floor, all in one plan: rows are repeated for each floor that they pass,
    and the floor joins every key."""
    spark = pairs.sparkSession
    table = F.broadcast(spark.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    each = pairs.join(table, F.col(prob) >= F.col("threshold"))
    tagged = each.withColumns({"_s": F.col(S1), "_c": F.col(CANDIDATE), S1: F.concat_ws("\u0001", F.col("threshold").cast("string"), S1), CANDIDATE: F.concat_ws("\u0001", F.col("threshold").cast("string"), CANDIDATE)})
    chosen = enforce_exclusivity(select_matches(tagged, prob, formula), prob).select("threshold", F.col("_s").alias(S1), F.col("_c").alias(CANDIDATE))
    wanted = entities.select(S1).distinct().crossJoin(table)
    return entity_scores(chosen, truth, wanted, ("threshold",))


def threshold_sweep(pairs: DataFrame, truth: DataFrame, entities: DataFrame, thresholds: tuple[float, ...], formula: str = "pdf", prob: str = "prob") -> DataFrame:
    """macro F0.5 at each floor."""
    return threshold_scores(pairs, truth, entities, thresholds, formula, prob).groupBy("threshold").agg(F.round(F.avg("f05"), 6).alias("macro_f05"))


def decision_grid(pairs: DataFrame, truth: DataFrame, entities: DataFrame, formulas: tuple[str, ...] = ("expected", "pdf"), floors: tuple[float, ...] = (0.0, 0.3, 0.5), exclusive: tuple[bool, ...] = (True, False), prob: str = "prob") -> DataFrame:
    """formula, min_prob, exclusivity, macro_f05 of each setting; the settings are a handful, each a plan of its own in a union."""
    out = None
    for formula in formulas:
        for floor in floors:
            for one in exclusive:
                chosen = decide(pairs, DecisionConfig(formula=formula, min_prob=floor, exclusivity=one), prob)
                row = macro_f05(chosen, truth, entities).select(F.lit(formula).alias("formula"), F.lit(floor).alias("min_prob"), F.lit(one).alias("exclusivity"), "macro_f05")
                out = row if out is None else out.unionByName(row)
    return out


def matching_results(selected: DataFrame, spine: DataFrame) -> DataFrame:
    """One row for each S1 id: its matches, sorted, without repeats, by commas; empty if there are none."""
    lists = selected.groupBy(S1).agg(F.array_join(F.array_sort(F.collect_set(CANDIDATE)), ",").alias("matched_entity_ids"))
    return spine.select(F.col("entity_id").alias(S1)).join(lists, S1, "left").fillna("", ["matched_entity_ids"])


def candidate_pairs(candidates: DataFrame, spine: DataFrame, score: str = "blocking_score") -> DataFrame:
    """One row for each S1 id: its candidates, best first."""
    ordered = F.array_sort(F.collect_set(F.struct((-F.col(score)).alias("s"), F.col(CANDIDATE).alias("c"))))
    lists = candidates.groupBy(S1).agg(F.array_join(F.transform(ordered, lambda x: x["c"]), ",").alias("candidate_entity_ids"))
    return spine.select(F.col("entity_id").alias(S1)).join(lists, S1, "left").fillna("", ["candidate_entity_ids"])


def summary(selected: DataFrame, spine: DataFrame) -> DataFrame:
    """entities, matches, matches_per_entity, singletons (entities without a match), singleton_rate."""
    each = spine.select(F.col("entity_id").alias(S1)).distinct().join(selected.groupBy(S1).agg(F.countDistinct(CANDIDATE).alias("n")), S1, "left").fillna(0, ["n"])
    return each.agg(F.count("*").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.round(F.avg("n"), 6).alias("matches_per_entity"), F.count_if(F.col("n") == 0).alias("singletons"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("singleton_rate"))


def variant(name: str) -> DecisionConfig:
    """Settings by name, as in alpha0.7_floor0.05_pdf; what is not named is as by default. An unknown part is an error."""
    found = re.fullmatch(r"(?:alpha(?P<alpha>\d+(?:\.\d+)?))?(?:(?:^|_)floor(?P<floor>\d+(?:\.\d+)?))?(?:(?:^|_)(?P<pdf>pdf))?", name)
    if found is None:
        raise ValueError(f"no variant: {name}")
    return DecisionConfig(formula="pdf" if found["pdf"] else "expected", min_prob=float(found["floor"] or 0), prior_shift=float(found["alpha"] or 1))


def variants(pairs: DataFrame, spine: DataFrame, names: tuple[str, ...], prob: str = "prob") -> DataFrame:
    """A row for each variant: its settings and summary. Names are a handful, each a plan of its own in a union."""
    out = None
    for name in names:
        c = variant(name)
        row = summary(decide(pairs, c, prob), spine).select(F.lit(name).alias("variant"), F.lit(c.prior_shift).alias("alpha"), F.lit(c.min_prob).alias("floor"), F.lit(c.formula).alias("formula"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def tune(pairs: DataFrame, truth: DataFrame, entities: DataFrame, calibrations: dict[str, str], formulas: tuple[str, ...] = ("expected", "pdf"), floors: tuple[float, ...] = (0.0, 0.02, 0.05, 0.1)) -> DataFrame:
    """calibration, formula, min_prob, vetoes, exclusivity, part (all, or a country), macro_f05. pairs: features, and a probability column for
    each of calibrations (name: column); entities: source1_entity_id, country. Vetoes are lifted at the first formula and floor alone, and so
    is exclusivity, of the first calibration. Settings of one formula and exclusivity are one plan, whose keys the setting joins."""
    columns = {}
    for name, column in calibrations.items():
        pairs = apply_hard_vetoes(pairs.withColumn(f"_v_{name}", F.col(column)), f"_v_{name}")
        columns |= {(name, True): f"_v_{name}", (name, False): column}
    first = next(iter(calibrations))
    settings = [(c, f, t, v, True) for c in calibrations for f in formulas for t in floors for v in (True, False) if v or (f, t) == (formulas[0], floors[0])]
    settings.append((first, formulas[0], floors[0], True, False))
    pairs = written(pairs.select(S1, CANDIDATE, *dict.fromkeys(columns.values())))
    spine = entities.select(S1, F.coalesce("country", F.lit("")).alias("country")).dropDuplicates([S1])
    chosen = None
    for formula, exclusive in dict.fromkeys((f, e) for _, f, _, _, e in settings):
        mine = [(i, s) for i, s in enumerate(settings) if (s[1], s[4]) == (formula, exclusive)]
        each = F.array(*[F.struct(F.lit(i).alias("setting"), F.col(columns[s[0], s[3]]).alias("prob"), F.lit(float(s[2])).alias("floor")) for i, s in mine])
        rows = pairs.select(F.col(S1).alias("_s"), F.col(CANDIDATE).alias("_c"), F.explode(each).alias("e")).select("_s", "_c", "e.*").where("prob >= floor")
        rows = rows.withColumns({name: F.concat_ws("\u0001", F.col("setting").cast("string"), of) for name, of in ((S1, "_s"), (CANDIDATE, "_c"))})
        got = select_matches(rows, formula=formula)
        got = (enforce_exclusivity(got) if exclusive else got).select("setting", F.col("_s").alias(S1), F.col("_c").alias(CANDIDATE))
        chosen = got if chosen is None else chosen.unionByName(got)
    table = F.broadcast(pairs.sparkSession.createDataFrame([(i, *map(str, s[:2]), float(s[2]), *s[3:]) for i, s in enumerate(settings)], "setting int, calibration string, formula string, min_prob double, vetoes boolean, exclusivity boolean"))
    scores = entity_scores(chosen, truth, spine.select(S1).crossJoin(table.select("setting")), ("setting",)).join(spine, S1)
    means = scores.select("setting", "f05", F.explode(F.array(F.lit("all"), F.col("country"))).alias("part")).groupBy("setting", "part").agg(F.round(F.avg("f05"), 6).alias("macro_f05"))
    return means.join(table, "setting").select("calibration", "formula", "min_prob", "vetoes", "exclusivity", "part", "macro_f05")
