import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import CANDIDATE, LEG_FLAGS, BlockingConfig
from tidemark.functions.text import normalize_source
from tidemark.operators import blocking, decision, features, learning, validate
from tidemark.operators.decision import S1

SCHEMA = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def sides(spark):
    s1 = [("S1-100", "Alpha Technologies Inc", "100 Main Street 94105", "US"), ("S1-101", "Tata Consultancy Services Ltd", "12 MG Road 560001", "India"), ("S1-102", "Boulangerie Dupont", "5 Rue de Paris 75001", "France"), ("S1-103", "Sharma Traders", "44 Nehru Place 110019", "India")]
    gallery = [("S2-100", "Alpha Technologies", "100 Main St 94105", "US"), ("S3-100", "Alpha Foods", "7 Oak Avenue 94105", "US"), ("S2-101", "TCS", "12 MG Rd 560001", "India"), ("S3-102", "Scharma Traders", "44 Nehru Pl 110019", "India"), ("S2-999", "Alpha Technologies Inc", "100 Main Street 94105", "Canada"), ("S2-102", "Boulangerie Dupont SARL", "5 rue de Paris", "France")]
    return tuple(normalize_source(spark.createDataFrame(x, SCHEMA), "latin").cache() for x in (s1, gallery))


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([("S1-100", "S2-100"), ("S1-101", "S2-101"), ("S1-103", "S3-102"), ("S1-102", "S2-102")], f"{S1} string, candidate_entity_id string")


def test_contract_and_partitions(sides, truth):
    out = blocking.generate_candidates(*sides, truth)
    assert out.columns == [*CANDIDATE, "is_true_match"]
    rows = out.collect()
    assert all(r.num_legs_retrieved == sum(r[c] for c in LEG_FLAGS) and not r.embedding_block_hit for r in rows)
    pairs = {(r[S1], r.candidate_entity_id) for r in rows}
    assert len(pairs) == len(rows) and not any(c == "S2-999" for _, c in pairs)
    assert {("S1-100", "S2-100"), ("S1-101", "S2-101"), ("S1-103", "S3-102")} <= pairs
    assert validate.check_candidates(out).agg(F.sum("violations")).first()[0] == 0
    assert blocking.generate_candidates(*sides).columns == list(CANDIDATE)


def test_partitions_do_not_matter(spark, sides):
    keys = [k for k in blocking.key_columns() if k[0] != blocking.PHONETIC]
    got = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, blocking.generate_candidates(*(x.repartition(n) for x in sides), keys=keys).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1]


def test_bucket_cap(spark):
    rows = [(f"S2-{i:03}", "US", "abc") for i in range(31)] + [(f"S3-{i:03}", "US", "def") for i in range(201)]
    keys = spark.createDataFrame([(c, e, 8, 1, k) for e, c, k in rows], "country string, entity_id string, leg int, kind int, key string")
    out = blocking.capped(keys)
    assert {r.entity_id for r in out.collect()} == {f"S2-{i:03}" for i in range(30)}


def test_adaptive_k(spark):
    df = spark.createDataFrame([("a", f"{i:02}", 1 - 0.01 * i) for i in range(50)], f"{S1} string, candidate_entity_id string, blocking_score double")
    assert blocking.adaptive_k(df).count() == 11


def test_pruner_and_siblings(sides):
    def pruner(pairs):
        return pairs.withColumn("blocking_score", F.least(F.lit(1.0), 0.6 + F.col("word_cos") / 10))

    out = blocking.generate_candidates(*sides, pruner=pruner, config=BlockingConfig(sibling_seed=0.5))
    assert out.groupBy(S1).count().agg(F.max("count")).first()[0] <= 30


def select(probs, formula="expected"):
    """The scalar form: sizes in turn."""
    p = sorted(probs, reverse=True)
    best, k_best, none = -1.0, 0, 1.0
    for x in p:
        none *= 1 - x
    if formula == "pdf":
        none = 0.0
    for k in range(1, len(p) + 1):
        ef = round(1.25 * sum(p[:k]) / (k + 0.25 * (sum(p[:k]) if formula == "pdf" else sum(p))), 12)
        if ef > best:
            best, k_best = ef, k
    return k_best if best > round(none, 12) else 0


@pytest.mark.parametrize("formula", ["expected", "pdf"])
def test_selection_against_the_scalar_form(spark, formula):
    rng = random.Random(3)
    groups = {f"S1-{i}": [round(rng.random() ** rng.choice((1, 4)), 3) for _ in range(rng.randrange(1, 9))] for i in range(60)}
    df = spark.createDataFrame([(s, f"S2-{s}-{j}", p) for s, ps in groups.items() for j, p in enumerate(ps)], f"{S1} string, candidate_entity_id string, prob double")
    got = {r[S1]: r["count"] for r in decision.select_matches(df, formula=formula).groupBy(S1).count().collect()}
    assert {s: got.get(s, 0) for s in groups} == {s: select(p, formula) for s, p in groups.items()}


def test_exclusivity_and_scores(spark):
    df = spark.createDataFrame([("S1-1", "S2-47", 0.9), ("S1-2", "S2-47", 0.9), ("S1-1", "S2-193", 0.8), ("S1-1", "S3-812", 0.7)], f"{S1} string, candidate_entity_id string, prob double")
    assert [r[S1] for r in decision.enforce_exclusivity(df).where("candidate_entity_id = 'S2-47'").collect()] == ["S1-1"]
    assert [r[S1] for r in decision.enforce_exclusivity(df, tie_break="largest").where("candidate_entity_id = 'S2-47'").collect()] == ["S1-2"]
    truth = spark.createDataFrame([("S1-1", "S2-47"), ("S1-1", "S3-812")], f"{S1} string, candidate_entity_id string")
    entities = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], f"{S1} string")
    got = {r[S1]: round(r.f05, 3) for r in decision.entity_scores(decision.enforce_exclusivity(df), truth, entities).collect()}
    assert got == {"S1-1": 0.714, "S1-2": 1.0, "S1-3": 1.0}


def test_features_have_the_contract(sides, truth):
    out = features.build_features(blocking.generate_candidates(*sides, truth), *sides)
    names = features.feature_columns(out.columns)
    counts = {p: sum(n.startswith(p) for n in names) for p in ("name__", "addr__", "cross__", "block__", "comp__", "sem__")}
    assert counts == {"name__": 18, "addr__": 16, "cross__": 10, "block__": 9, "comp__": 5, "sem__": 4} and len(names) == 62
    assert validate.check_features(out, True) == []
    r = out.where(f"{S1} = 'S1-100' and candidate_entity_id = 'S2-100'").first()
    assert r.name__exact_core_match == 1 and r.addr__pin_exact == 1 and r.addr__lev_ratio == 1 and r.label == 1


def test_reliability_and_auc(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(300)] + [(1.0, 1)]
    df = spark.createDataFrame(rows, "prob double, label int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / len(pos) / len(neg)
    assert learning.roc_auc(df).first().auc == pytest.approx(auc, abs=1e-6)
    bins = learning.reliability(df).collect()
    assert sum(r.n for r in bins) == 301 and max(r.bin for r in bins) == 9


def test_output_rules(spark):
    lines = spark.createDataFrame([(1, f"{S1}\tmatched_entity_ids"), (2, "S1-1\tS2-1,S2-1"), (3, "S1-1\t"), (4, "bad"), (5, "S1-9\tS1-1,Q1")], "line_no int, value string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    got = {r.rule: r.violations for r in validate.validate_lines(lines, required).collect()}
    assert got == {"empty_file": 0, "comma_header": 0, "header": 0, "malformed_row": 1, "repeated_s1": 1, "repeated_id": 1, "self_match": 1, "bad_prefix": 1, "missing_s1": 1, "unexpected_s1": 1}


def test_stream_of_batches(spark, sides, tmp_path):
    from tidemark.streaming import incremental

    rows = spark.createDataFrame([("S1-100", "Alpha Technologies Inc", "100 Main Street 94105", "US")], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = []
    q = incremental.run_batches(stream, sides[1], lambda df, n: got.extend(r.candidate_entity_id for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert "S2-100" in got


def test_tsv_round_trip(spark, tmp_path):
    from tidemark.sources import io

    df = spark.createDataFrame([("S1-1", "aé", "", "US"), ("S1-2", "NA", "x, y", "")], SCHEMA)
    io.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, io.read_tsv(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))
