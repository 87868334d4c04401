"""Registered queries over the driver's tables, one for each operator or family of them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import BlockingConfig, DecisionConfig
from tidemark.functions import alternative, similarity, text
from tidemark.operators import blocking, decision, features, learning, pruner, validate, vectorize
from tidemark.plans import oracle, testbed
from tidemark.sources import io
from tidemark.workers import prepare, written

S1, CANDIDATE = "source1_entity_id", "candidate_entity_id"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL = oracle.ORACLE_SQL
KEYS = (blocking.EXACT, blocking.ADDRESS, blocking.PIN)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def six(c: str) -> Column:
    """Six decimals of a number that has nine; what is added decides halves."""
    return F.round(F.col(c) + 1e-10, 6)


def keys() -> list:
    return [k for k in blocking.key_columns(KEYS) if k[0] in KEYS]


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, gallery = testbed.stored_sides(spark, sf_dir)
    return blocking.generate_candidates(s1, gallery, keys=keys())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a probability that grows with the score."""
    prob = F.round(F.least(F.col("blocking_score") / 3.5, F.lit(0.99)), 6)
    return cand(spark, sf_dir).select(S1, CANDIDATE, "country", "blocking_score", prob.alias("prob"))


def pair_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, gallery = testbed.stored_sides(spark, sf_dir)
    return features.with_records(blocking.generate_candidates(s1, gallery, keys=keys()), s1, gallery)


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), ((F.col("doc_id") * 7919 % 1000) / 1000.0 * 0.5 + F.col("quality") * 0.3).alias("prob"))


@query
def matching_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, _ = testbed.sides(spark, sf_dir)
    return decision.matching_results(decision.decide(scored(spark, sf_dir)), s1)


@query
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, gallery = testbed.stored_sides(spark, sf_dir)
    return decision.candidate_pairs(blocking.generate_candidates(s1, gallery, keys=keys()), s1)


@query
def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.normalize_source(testbed.records(spark, sf_dir), "latin")


@query
def legal_suffix_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.get(F.array(*map(F.lit, ("pvt ltd", "gmbh", "", "company inc", "private limited", "co"))), (F.col("p_partkey") % 6).cast("int"))
    name = F.concat(F.lower("p_name"), F.lit(" "), more)
    return testbed.table(spark, sf_dir, "part").select("p_partkey", text.collapse_whitespace(text.name_core(name)).alias("name_core"), text.legal_suffix(name).alias("legal_suffix"))


@query
def address_normalize_numbers_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(spark, sf_dir).select("entity_id", "address_norm", "address_numbers", "address_pin")


@query
def alt_name_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = testbed.records(spark, sf_dir).withColumn("business_name", F.concat("business_name", F.when(F.col("source") == "S2", F.concat(F.lit(" aka "), "country", F.lit(" pvt"))).otherwise("")))
    return alternative.name_views(r, scripts="latin").select("entity_id", "name_core", "name_norm", "name_suffix", "name_nospace", "name_sorted", "name_alt")


@query
def domain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.lower(F.regexp_extract("url", "^(https?://[^/]+)", 1))
    host = alternative.domain_host(site)
    return testbed.table(spark, sf_dir, "pages").select("page_id", host.alias("host"), (host != "").cast("int").alias("is_domain"))


@query
def alt_address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.get(F.array(*map(F.lit, ("5th ave", "apt 12b", "nr rd", ""))), F.length("entity_id") % 4)
    r = testbed.records(spark, sf_dir).withColumn("business_address", F.concat("business_address", F.lit(" "), more))
    return alternative.address_parts(r, scripts="latin").select("entity_id", "addr_norm", "house_no", "postcode", "addr_nums", "street", "addr_ntok")


def _leg(spark: SparkSession, sf_dir: str, leg: int) -> DataFrame:
    s1, gallery = testbed.sides(spark, sf_dir)
    return blocking.key_pairs(s1, gallery, [k for k in blocking.key_columns((leg,))]).select("country", "s1", "g").distinct()


@query
def block_exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg(spark, sf_dir, blocking.EXACT)


@query
def block_address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg(spark, sf_dir, blocking.ADDRESS)


@query
def block_pin_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg(spark, sf_dir, blocking.PIN)


@query
def block_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg(spark, sf_dir, blocking.PHONETIC)


@query
def block_phonetic_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.best_of(blocking.phonetic_weights(*testbed.stored_sides(spark, sf_dir)), 0.5, 10)


@query
def alt_block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = alternative.address_parts(alternative.name_views(testbed.records(spark, sf_dir), scripts="latin"), scripts="latin")
    return blocking.key_pairs(r.where("source = 'S1'"), r.where("source <> 'S1'"), blocking.alternative_key_columns()).groupBy("country", "s1", "g").agg(F.bit_or("leg").alias("legs"))


@query
def block_word_tfidf_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By all words: none is left out for being in many records."""
    return vectorize.best_of(blocking.word_weights(*testbed.stored_sides(spark, sf_dir), BlockingConfig(word_max_df=1.0, max_df_rows=1 << 62)), 0.15, 40).withColumn("cos", six("cos"))


@query
def block_char_tfidf_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.best_of(blocking.char_weights(*testbed.stored_sides(spark, sf_dir)), 0.30, 40).withColumn("cos", six("cos"))


@query
def block_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.best_for(blocking.word_weights(*testbed.stored_sides(spark, sf_dir)), 0.30, 3).withColumn("cos", six("cos"))


@query
def candidate_union_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand(spark, sf_dir).withColumn("blocking_score", six("blocking_score"))


@query
def candidates_cap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_candidates(cand(spark, sf_dir))


@query
def adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.adaptive_k(cand(spark, sf_dir)).select(S1, CANDIDATE, six("blocking_score").alias("blocking_score"))


@query
def sibling_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gallery = testbed.stored_sides(spark, sf_dir)
    pool = cand(spark, sf_dir).select("country", F.col(S1).alias("s1"), F.col(CANDIDATE).alias("g"), "blocking_score")
    return blocking.siblings(pool.where("blocking_score >= 1.5"), pool, gallery)


@query
def blocking_recall_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.recall_report(cand(spark, sf_dir), testbed.truth(spark, sf_dir), testbed.sides(spark, sf_dir)[0])


@query
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.recall_at(cand(spark, sf_dir), testbed.truth(spark, sf_dir))


@query
def leg_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.leg_hit_rates(cand(spark, sf_dir))


@query
def token_set_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a_name_norm"), F.col("b_name_norm")
    return pair_texts(spark, sf_dir).select(S1, CANDIDATE, F.round(similarity.token_jaccard(a, b), 6).alias("token_jaccard"), F.round(similarity.token_overlap(a, b), 6).alias("token_overlap"), similarity.length_diff(a, b).alias("length_diff"), F.round(similarity.length_ratio(a, b), 6).alias("length_ratio"))


@query
def edit_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indel, token-sort, partial and token-set ratios and Jaro-Winkler in one crossing."""
    return pair_texts(spark, sf_dir).select(S1, CANDIDATE, similarity.edit_measures(F.col("a_name_norm"), F.col("b_name_norm")).alias("m")).select(S1, CANDIDATE, *[F.round(f"m.{k}", 6).alias(k) for k in similarity.EDIT_MEASURES])


@query
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_texts(spark, sf_dir).where("a_name_core <> '' and b_name_core <> ''")
    return p.select(S1, CANDIDATE, F.round(similarity.jw(F.col("a_name_core"), F.col("b_name_core")), 6).alias("jaro_winkler"))


@query
def char_wb_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, gallery = testbed.stored_sides(spark, sf_dir)
    return features.pair_dot(cand(spark, sf_dir), features.gram_vectors(s1.unionByName(gallery), "name_norm"), "cosine")


@query
def embedding_cosine_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.array_top(testbed.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5, F.col("vec_id") % 20 == 0)


@query
def house_pin_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = features.record_flags()
    named = {"house_number_exact": "addr__house_number_exact", "house_number_conflict": "addr__house_number_conflict", "pin_exact": "addr__pin_exact", "suffix_conflict": "name__suffix_conflict"}
    return pair_texts(spark, sf_dir).select(S1, CANDIDATE, *[flags[c].alias(n) for n, c in named.items()])


@query
def numeric_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_texts(spark, sf_dir).select(S1, CANDIDATE, features.numeric_conflict().alias("numeric_conflict"))


@query
def cross_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.cross_features(F.round(F.col("l_quantity") / 50, 6), F.col("l_discount") * 10)
    names = ("product", "total", "low", "high", "high_low", "low_high", "diff", "harmonic")
    cols = [(F.round(c, 9) if n == "harmonic" else c).alias(n) for n, c in zip(names, f.values(), strict=True)]
    return testbed.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), *cols)


@query
def competition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.competition(cand(spark, sf_dir))
    exact = ("comp__rank", "comp__g_rank")
    return out.select(S1, CANDIDATE, *[F.col(c) if c in exact else six(c).alias(c) for c in ("comp__rank", "comp__score_percentile", "comp__score_gap_top1", "comp__g_best_ratio", "comp__g_rank")])


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, gallery = testbed.stored_sides(spark, sf_dir)
    pairs = blocking.generate_candidates(s1, gallery, testbed.truth(spark, sf_dir), keys=keys())
    return features.build_features(pairs, s1, gallery)


@query
def splits_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.split_entities(testbed.sides(spark, sf_dir)[0].select("entity_id", "country"))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.stratified_sample(testbed.sides(spark, sf_dir)[0].select("entity_id", "country"), 200)


@query
def hard_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testbed.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") == 1).cast("double").alias("addr__house_number_conflict"), (F.col("l_discount") * 10).alias("addr__lev_ratio"),
        F.round(F.col("l_quantity") / 50, 6).alias("name__lev_ratio"), (F.col("l_tax") * 10).alias("sem__embedding_cosine"), F.lit(0.9).alias("prob"))
    veto = decision.apply_hard_vetoes(rows.withColumn("sem__embedding_cosine", F.col("sem__embedding_cosine")))
    return veto.select("l_orderkey", "l_linenumber", "prob")


@query
def prior_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(similarity.prior_shift(F.col("l_discount") * 9, 1.5), 9).alias("prob"))


@query
def select_expected_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.select_matches(scored(spark, sf_dir)).select(S1, CANDIDATE, "prob")


@query
def select_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.select_matches(scored(spark, sf_dir), formula="pdf", min_prob=0.2).select(S1, CANDIDATE, "prob")


@query
def exclusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scored(spark, sf_dir)
    one, other = (decision.enforce_exclusivity(pairs, tie_break=t).select(F.lit(t).alias("tie_break"), S1, CANDIDATE, "prob") for t in ("smallest", "largest"))
    return one.unionByName(other)


@query
def macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = testbed.sides(spark, sf_dir)[0].select(F.col("entity_id").alias(S1))
    return decision.macro_f05(decision.decide(scored(spark, sf_dir)), testbed.truth(spark, sf_dir), s1)


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = testbed.sides(spark, sf_dir)[0].select(F.col("entity_id").alias(S1))
    return decision.threshold_sweep(scored(spark, sf_dir), testbed.truth(spark, sf_dir), s1, (0.3, 0.5, 0.7))


@query
def decision_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = testbed.sides(spark, sf_dir)[0].select(F.col("entity_id").alias(S1))
    return decision.decision_grid(scored(spark, sf_dir), testbed.truth(spark, sf_dir), s1, floors=(0.0, 0.4))


@query
def validate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output with faults put in: the ids that end in 3 are missing, and some rows are wrong."""
    s1, gallery = testbed.sides(spark, sf_dir)
    good = s1.where(F.substr("entity_id", F.lit(4)).cast("long") % 10 != 3).select(F.concat("entity_id", F.lit("\t")).alias("value"))
    first = s1.agg(F.min(F.when(F.substr("entity_id", F.lit(4)).cast("long") % 10 != 3, F.col("entity_id"))).alias("f"))
    real = gallery.agg(F.min("entity_id").alias("g"))
    bad = first.crossJoin(F.broadcast(real)).select(F.explode(F.array(F.lit("no tab here"), F.concat("f", F.lit("\tX9-1,S1-1")), F.concat(F.lit("S1-none\t"), "g", F.lit(","), "g"))).alias("value"))
    lines = spark.range(1).select(F.lit(1).alias("line_no"), F.lit(f"{S1}\tmatched_entity_ids").alias("value")).unionByName(good.unionByName(bad).select(F.lit(2).alias("line_no"), "value"))
    return validate.validate_lines(lines, s1, known=gallery)


@query
def token_map_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.learn_token_map(_name_pairs(spark, sf_dir), least=1)


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, gallery = testbed.sides(spark, sf_dir)
    pairs = testbed.truth(spark, sf_dir).join(s1.select(F.col("entity_id").alias(S1), F.col("name_core").alias("s1_name")), S1).join(gallery.select(F.col("entity_id").alias(CANDIDATE), F.col("name_core").alias("g")), CANDIDATE)
    cut = F.substr("s1_name", F.lit(1), F.greatest(F.length("s1_name") - 1, F.lit(0)))
    return pairs.select(F.col(CANDIDATE).alias("pair_id"), "s1_name", F.concat("g", F.lit(" "), cut).alias("g_name"))


@query
def token_map_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.apply_token_map(testbed.sides(spark, sf_dir)[1], token_map_learn(spark, sf_dir))


@query
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.reliability(labelled_scores(spark, sf_dir))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.roc_auc(labelled_scores(spark, sf_dir))


@query
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_scores(spark, sf_dir)
    return learning.isotonic(rows).setPredictionCol("calibrated").transform(rows.withColumn("label", F.col("label").cast("double")))


@query
def gbt_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match probabilities of a model trained on the train split, for the pairs of the val split."""
    s1, gallery = testbed.sides(spark, sf_dir)
    rows = written(feature_matrix(spark, sf_dir))
    split = features.split_entities(s1.select(F.col("entity_id").alias(S1)), id_column=S1)
    train, val = (rows.join(split.where(F.col("split") == x).select(S1), S1, "left_semi") for x in ("train", "val"))
    model, calibrator, columns = learning.two_phase(written(train))
    return learning.predict(val, model, columns, calibrator).select(S1, CANDIDATE, "label", F.round("prob", 6).alias("prob"))


@query
def pruner_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of the learned re-ranking that need no edit distance, for the best 80 pairs of each S1 record."""
    s1, gallery = testbed.stored_sides(spark, sf_dir)
    pool = blocking.best(blocking.scored_pairs(s1, gallery, keys()), 80)
    whole = ("n_key_legs", "f_exact", "f_addr", "f_pin", "f_bidir", "f_word", "f_char", "house_eq", "house_conflict", "name_ntok_s1", "name_ntok_g", "addr_ntok_g", "g_rank")
    parts = [six(f"pf_{c}").alias(f"pf_{c}") for c in ("word_cos", "char_cos", "g_best_ratio")]
    return pruner.pruner_features(pool, s1, gallery).select("country", "s1", "g", *[F.col(f"pf_{c}") for c in whole], *parts)


@query
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = testbed.sides(spark, sf_dir)[0].select(F.col("entity_id").alias(S1), "country")
    return learning.evaluate(scored(spark, sf_dir), testbed.truth(spark, sf_dir), s1)


@query
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.summary(decision.decide(scored(spark, sf_dir)), testbed.sides(spark, sf_dir)[0])


@query
def decision_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.variants(written(scored(spark, sf_dir)), testbed.sides(spark, sf_dir)[0], ("alpha1.0", "alpha0.53", "alpha0.7_floor0.3_pdf"))


@query
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.label_summary(labelled_scores(spark, sf_dir))


@query
def query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruner.query_sample(testbed.sides(spark, sf_dir)[0].select("entity_id", "country"), 200)


@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return testbed.table(spark, sf_dir, "orders").withColumn("r", first).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query
def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    o = w.orderBy(F.desc("l_quantity"), "l_linenumber")
    return testbed.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(o).alias("k"), F.round(F.sum("l_quantity").over(o.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("cum"), F.round(F.sum("l_quantity").over(w), 6).alias("total"))


@query
def avg_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    ties = F.count("*").over(Window.partitionBy("l_orderkey", "l_discount"))
    return testbed.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round((F.rank().over(w.orderBy("l_discount")) + (ties - 1) / 2) / F.count("*").over(w), 9).alias("pct"))


@query
def raw_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.records(spark, sf_dir).select("entity_id", "business_name", "business_address", "country")


@query
def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = testbed.truth(spark, sf_dir).groupBy(S1).agg(F.array_join(F.collect_list(CANDIDATE), ",").alias("matched_entity_ids"))
    return io.explode_truth(lists)


@query
def city_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(spark, sf_dir).where(F.col("address_norm").rlike(r"\b(?:the|der|les)\b")).groupBy("country").agg(F.count("*").alias("n"))


@query
def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s2 = testbed.sides(spark, sf_dir)[1].where("entity_id like 'S2-%'")
    return validate.missing_records(cand(spark, sf_dir).select(S1, CANDIDATE), s2, CANDIDATE).select(S1, CANDIDATE)


__all__ = ["DecisionConfig", "ORACLE_SQL", "QUERIES"]
