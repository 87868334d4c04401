import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import decision, learning, pruner
from tidemark.operators.decision import CANDIDATE, S1
from tidemark.sources import io

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma tau omega phi chi psi rho mu nu".split()


def companies(n, seed):
    """Three raw sources and the truth: S2 has a variant of most S1 records, S3 has records of its own."""
    rng = random.Random(seed)
    s1, s2, s3, truth = [], [], [], []
    for i in range(n):
        name, street = rng.sample(WORDS, 3), rng.sample(WORDS, 2)
        country = "US" if i % 3 else "India"
        address = f"{rng.randrange(1, 99)} {' '.join(street)} road tx {rng.randrange(10000, 99999)}"
        s1.append((f"S1-{i}", " ".join(name) + " Inc", address, country))
        if i % 4:
            s2.append((f"S2-{i}", " ".join(name[: 2 + i % 2]), address, country))
            truth.append((f"S1-{i}", f"S2-{i}"))
        s3.append((f"S3-{i}", " ".join(rng.sample(WORDS, 3)), f"{rng.randrange(1, 99)} {' '.join(street)} lane tx {rng.randrange(10000, 99999)}", country))
    return s1, s2, s3, truth


def test_evaluation_equals_its_parts(spark):
    rng = random.Random(1)
    spine = spark.createDataFrame([(f"S1-{i}", "US" if i % 3 else "FR") for i in range(20)] + [("S1-none", None)], f"{S1} string, country string")
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{rng.randrange(25)}", rng.random()) for i in range(20) for _ in range(4)], f"{S1} string, {CANDIDATE} string, prob double").dropDuplicates([S1, CANDIDATE]).cache()
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(15)], f"{S1} string, {CANDIDATE} string")
    got = {r.part: r for r in learning.evaluate(pairs, truth, spine, thresholds=(0.3, 0.6)).collect()}
    assert set(got) == {"all", "US", "FR", ""} and got["all"].entities == 21 and got[""].f05_candidates is None
    chosen = decision.decide(pairs)
    assert got["all"].f05 == decision.macro_f05(chosen, truth, spine).first().macro_f05
    french = spine.where("country = 'FR'")
    assert got["FR"].f05 == decision.macro_f05(chosen.join(french, S1, "left_semi"), truth, french).first().macro_f05
    sweep = {r.threshold: r.macro_f05 for r in decision.threshold_sweep(pairs, truth, spine, (0.3, 0.6)).collect()}
    assert (got["all"].f05_threshold_best, -got["all"].threshold_best) == max((v, -k) for k, v in sweep.items())


def test_tuning_equals_single_decisions(spark):
    rng = random.Random(2)
    rows = [(f"S1-{i}", f"S2-{rng.randrange(12)}", rng.random(), rng.random(), float(rng.random() < 0.3), rng.random()) for i in range(10) for _ in range(3)]
    pairs = spark.createDataFrame(rows, f"{S1} string, {CANDIDATE} string, p double, q double, addr__house_number_conflict double, addr__lev_ratio double").dropDuplicates([S1, CANDIDATE])
    pairs = pairs.withColumns({"name__lev_ratio": F.lit(0.5), "sem__embedding_cosine": F.lit(0.0)}).cache()
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(10)], f"{S1} string, {CANDIDATE} string")
    spine = truth.select(S1, F.lit("US").alias("country"))
    got = decision.tune(pairs, truth, spine, {"one": "p", "two": "q"}, floors=(0.0, 0.1)).where("part = 'all'").collect()
    assert len(got) == 2 * 5 + 1
    for r in got:
        one = pairs.withColumn("prob", F.col({"one": "p", "two": "q"}[r.calibration]))
        one = decision.apply_hard_vetoes(one) if r.vetoes else one
        config = decision.DecisionConfig(formula=r.formula, min_prob=r.min_prob, exclusivity=r.exclusivity)
        assert r.macro_f05 == decision.macro_f05(decision.decide(one, config), truth, spine).first().macro_f05, r


def test_variants_by_name():
    c = decision.variant("alpha0.7_floor0.05_pdf")
    assert (c.prior_shift, c.min_prob, c.formula) == (0.7, 0.05, "pdf")
    assert decision.variant("pdf") == decision.DecisionConfig(formula="pdf") and decision.variant("") == decision.DecisionConfig()
    with pytest.raises(ValueError):
        decision.variant("alpha1_other")


def test_hardest_rows(spark):
    df = spark.createDataFrame([(f"S1-{i}", "S2-1", i / 100) for i in range(100)] + [(f"S1-x{i}", "S2-1", 0.905) for i in range(40)], f"{S1} string, {CANDIDATE} string, prob double")
    assert {r.prob for r in learning.hardest(df, 9, 0.3).collect()} == {x / 100 for x in range(91, 100)}
    assert learning.hardest(df, 1000, 0.3).count() == 110
    got = learning.hardest(df, 29, 0.3).collect()
    assert sum(r.prob > 0.906 for r in got) == 9 and 8 <= len(got) - 9 <= 32 and {r.prob for r in got if r.prob <= 0.906} == {0.905}


def test_calibration_by_country(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(c, p, int(rng.random() < (p if c == "US" else 0.2))) for c in ("US", "FR", None) for p in (rng.random() for _ in range(60))], "country string, prob double, label int").cache()
    models = learning.isotonic_by_country(rows, least=50)
    assert set(models) == {"US", "FR"}
    out = learning.calibrated_by_country(rows, models, learning.isotonic(rows))
    assert out.count() == 180 and out.where("prob is null or prob < 0 or prob > 1").count() == 0


def test_missing_model_columns(spark):
    with pytest.raises(ValueError, match="name__b"):
        learning.check_columns(spark.createDataFrame([(1.0,)], "name__a double"), ["name__a", "name__b"])


def test_command_lines_from_raw_to_output(spark, tmp_path):
    work = f"file://{tmp_path}"
    for part, seed in (("train", 5), ("test", 6)):
        *sources, truth = companies(80, seed)
        for i, rows in enumerate(sources, 1):
            io.write_tsv(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), f"{work}/raw/{part}/{part}_source{i}.tsv")
        lists = spark.createDataFrame(truth, f"{S1} string, matched_entity_ids string")
        io.write_tsv(lists, f"{work}/raw/{part}/{part}_ground_truth.tsv")
    cli.main(["run", "--work", work, "--stages", "normalize"], spark)
    sides = ["--s1", f"{work}/normalized/train/source1", "--gallery", f"{work}/normalized/train/source2", f"{work}/normalized/train/source3"]
    cli.main(["prune", *sides, "--truth", f"{work}/raw/train/train_ground_truth.tsv", "--slices", "US:tx", "India:tx", "--queries", "30", "--output", f"{work}/models/pruner"], spark)
    model = io.read_model(spark, f"{work}/absent", f"{work}/models/pruner")
    assert model.numFeatures == len(pruner.PRUNER_FEATURES)
    cli.main(["run", "--work", work, "--stages", "block,features,splits,train,decide"], spark)
    summary = json.loads(spark.read.text(f"{work}/models/summary").first().value)
    assert len(summary["feature_cols"]) == 62 and summary["results"]["all"]["f05"] > 0.7
    result = io.read_truth(spark, f"{work}/output/matching_results")
    true = io.read_truth(spark, f"{work}/raw/test/test_ground_truth.tsv")
    assert result.join(true, [S1, CANDIDATE]).count() > 40
    with pytest.raises(SystemExit):
        cli.main(["run", "--work", work, "--stages", "no"], spark)


def test_the_query_learns_all_rounds_of_the_operator(spark, monkeypatch):
    """The registered query learned five trees a phase."""
    import inspect

    from tidemark.plans import catalogue, testbed

    rng = random.Random(14)
    rows = [(f"S1-{i}", f"S2-{j}", x, y, int(x + 0.5 * y + rng.gauss(0, 0.1) > 0.9)) for i in range(250) for j in range(4) for x, y in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(rows, f"{S1} string, {CANDIDATE} string, name__x float, addr__y float, label int").withColumns({c: F.lit(0.0) for c in ("addr__house_number_conflict", "addr__lev_ratio", "name__lev_ratio", "sem__embedding_cosine")})
    s1 = df.select(F.col(S1).alias("entity_id"), F.lit("US").alias("country")).distinct()
    monkeypatch.setattr(catalogue, "feature_matrix", lambda spark, sf_dir: df)
    monkeypatch.setattr(testbed, "sides", lambda spark, sf_dir: (s1, s1))
    seen, fit = [], learning.fit_trees
    monkeypatch.setattr(learning, "fit_trees", lambda rows, *x, **y: seen.append(fit(rows, *x, **y)) or seen[-1])
    out = catalogue.QUERIES["gbt_two_phase"](spark, "").toPandas()
    assert [model.getNumTrees for model in seen] == [inspect.signature(learning.two_phase).parameters["rounds"].default] * 2
    assert 0 < len(out) < len(rows) and ((out.prob > 0.5) == (out.label == 1)).mean() > 0.8  # labels are noisy
