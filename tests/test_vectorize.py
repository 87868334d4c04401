import collections
import random

import pytest

from tidemark.operators import vectorize

SCHEMA = "country string, entity_id string, term string, w double"


def vectors(rng, side, n, words):
    """Short vectors of few weights, so that cosines tie; some have no term."""
    return {(rng.choice("AB"), f"{side}-{i}"): {t: rng.choice((0.2, 0.4, 0.5)) for t in rng.sample(words, rng.randrange(0, 4))} for i in range(n)}


def frame(spark, v):
    return spark.createDataFrame([(c, e, t, w) for (c, e), terms in v.items() for t, w in terms.items()], SCHEMA)


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_block_products_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectorize, "BLOCK", block)
    rng = random.Random(block)
    words = [f"t{i}" for i in range(9)]
    two = [(vectors(rng, "S1", 50, words), vectors(rng, "S2", 70, words)) for _ in range(2)]
    best, back = [(0.1, 4), (0.15, 2)], (0.2, 2)
    cos = collections.defaultdict(lambda: [0.0, 0.0])
    for k, (a, b) in enumerate(two):
        for (c, s), x in a.items():
            for (d, g), y in b.items():
                if c == d and set(x) & set(y):
                    cos[c, s, g][k] = round(sum(x[t] * y[t] for t in set(x) & set(y)), 9)
    legs, both = collections.Counter(), set()
    for k, (least, n) in enumerate(best):
        mine = collections.defaultdict(list)
        for (c, s, g), x in cos.items():
            if x[k] > least:
                mine[c, s].append((-x[k], g))
        for (c, s), x in mine.items():
            for _, g in sorted(x)[:n]:
                legs[c, s, g] |= 1 << k
    theirs = collections.defaultdict(list)
    for (c, s, g), x in cos.items():
        if x[0] > back[0]:
            theirs[c, g].append((-x[0], s))
    both = {(c, s, g) for (c, g), x in theirs.items() for _, s in sorted(x)[: back[1]]}
    given = {("A", "S1-3", "S2-5"): 4, ("B", "S1-0", "S2-none"): 8, ("A", "S1-none", "S2-1"): 16}
    pairs = spark.createDataFrame([(*k, v) for k, v in given.items()] + [("A", "S1-3", "S2-5", 8)], "country string, s1 string, g string, leg int")
    given["A", "S1-3", "S2-5"] = 12
    out = vectorize.met([(frame(spark, a), frame(spark, b)) for a, b in two], best, back, pairs).collect()
    got = {(r.country, r.s1, r.g): r for r in out}
    assert len(got) == len(out)
    assert {k: r.legs for k, r in got.items() if r.legs} == dict(legs)
    assert {k: r.given for k, r in got.items() if r.given} == given
    assert both <= {k for k, r in got.items() if r.back}
    assert all(r.cos == pytest.approx(cos.get(k, [0.0, 0.0]), abs=1e-9) for k, r in got.items())
    # what no leg takes doesn't leave a task
    assert all(r.legs or r.given or r.back for r in out) and len(out) < len(cos)


def test_a_cell_forgets_no_pair_when_it_prunes(monkeypatch):
    """Ten times more pairs over the threshold than are held."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    monkeypatch.setattr(vectorize, "HELD", 40)
    monkeypatch.setattr(vectorize, "SUMS", 30)
    rng = np.random.default_rng(5)
    x, y = rng.integers(1, 5, (10, 3)) / 10, rng.integers(1, 5, (80, 3)) / 10

    def batch(rows, a):
        none = pa.array([[] for _ in rows], pa.list_(pa.string())), pa.array([[] for _ in rows], pa.list_(pa.float64()))
        ids = pa.array([f"{i + a:03}" for i in range(len(rows))])
        return pa.RecordBatch.from_arrays([ids, ids, ids, ids, *none, pa.array([list("abc") for _ in rows]), pa.array(rows.tolist())], names=list("pqrstuvw"))

    cell = vectorize._Cell("A", [(0.05, 3)], None, T.StructType([T.StructField(c, T.StringType()) for c in ("country", "s1", "g", "legs", "back", "given", "cos")]))
    cell.ask(batch(x, 0))
    for a in range(0, 80, 16):
        assert not list(cell.meet(batch(y[a : a + 16], a)))
    got = {(r["s1"], r["g"]) for b in cell.close() for r in b.to_pylist()}
    cos = np.round(x @ y.T, 9)
    want = {(f"{i:03}", f"{j:03}") for i in range(10) for j in np.lexsort((np.arange(80), -cos[i]))[:3]}
    assert got == want


def test_nearest_rows_equal_brute_force(spark, monkeypatch):
    """Every block and tie; only the best of a block leave a task, where each product's places did before."""
    import numpy as np

    monkeypatch.setattr(vectorize, "NEAR_BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (1300, 4)).astype(float) + [0.5, 0, 0, 0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(5000, []), (5001, None)], "id long, v array<double>")
    out = vectorize.array_top(df, "id", "v", 4, vectorize.F.col("id") % 100 == 0)
    assert "Generate posexplode" not in out._jdf.queryExecution().toString()
    got = {(r.query_id, r["rank"]): (r.near_id, r.cos) for r in out.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 6)
    want = {}
    for q in range(0, 1300, 100):
        for rank, j in enumerate([j for j in np.lexsort((np.arange(1300), -cos[q])) if j != q][:4], 1):
            want[q, rank] = (j, cos[q, j])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_products_of_given_pairs(spark, monkeypatch):
    """In blocks, and in pieces; no row for each term of a pair is dealt out."""
    from tidemark.operators import features

    monkeypatch.setattr(features, "PAIR_BLOCK", 7)
    rng = random.Random(4)
    words = [f"t{i}" for i in range(12)]
    vec = {f"S{s}-{i}": {t: rng.random() for t in rng.sample(words, rng.randrange(1, 5))} for s in (1, 2) for i in range(40)}
    pairs = {(f"S1-{rng.randrange(42)}", f"S2-{rng.randrange(42)}") for _ in range(400)}
    df = spark.createDataFrame([(e, t, w) for e, x in vec.items() for t, w in x.items()], "entity_id string, term string, w double")
    out = features.pair_dot(spark.createDataFrame(sorted(pairs), "source1_entity_id string, candidate_entity_id string"), df, "cos")
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = out.collect()
    want = {(a, b): sum(w * vec[b][t] for t, w in vec[a].items() if t in vec[b]) for a, b in pairs if a in vec and b in vec and set(vec[a]) & set(vec[b])}
    assert len(got) == len(want) and {(r[0], r[1]): r.cos for r in got} == pytest.approx(want, abs=2e-9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_done_before_the_gallery_is_copied(spark):
    """What is shuffled to make vectors of either side is over once blocks are dealt."""
    rng = random.Random(2)
    words = [f"t{i}" for i in range(9)]
    a, b = vectors(rng, "S1", 20, words), vectors(rng, "S2", 20, words)
    plan = plan_of(vectorize.met([(frame(spark, a), frame(spark, b))], [(0.1, 4)]))
    assert "MapInArrow" in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_pairs_are_found_before_they_are_ranked(spark):
    from tidemark.functions.text import normalize_source
    from tidemark.operators import blocking

    rows = [(f"{s}-{i}", f"alpha beta {i}", f"{i} high street 12345", "en") for s in ("S1", "S2") for i in range(5)]
    both = normalize_source(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), "latin")
    got = blocking.generate_candidates(both.where("entity_id like 'S1-%'"), both.where("entity_id like 'S2-%'"), keys=[k for k in blocking.key_columns((blocking.EXACT,))])
    assert "MapInArrow" not in plan_of(got)
    assert {(r.source1_entity_id, r.candidate_entity_id) for r in got.collect()} >= {(f"S1-{i}", f"S2-{i}") for i in range(5)}


def test_words_of_many_records_count(spark, tmp_path):
    """Over 1000 gallery records, a word that a third of them have, and pairs with none but such words in common."""
    import math

    from tidemark.plans import catalogue, testbed

    rng = random.Random(8)
    ids = [*range(0, 6000, 5), *range(1, 500, 5)]  # of texts without a copy, multiples of 5 make the gallery
    texts = [f"widely widely widely widely z{i}" if i < 100 else " ".join([f"n{i}a", *(["widely"] if i % 3 else []), *(f"w{rng.randrange(900)}" for _ in range(3))]) for i in ids]
    rows = [(i, t, "en", "web", 9) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sides = [[(r.entity_id, collections.Counter((r.name_norm + " " + r.address_norm).split())) for r in x.collect()] for x in testbed.sides(spark, str(tmp_path))]
    n, df = len(sides[1]), collections.Counter(t for _, x in sides[1] for t in x)
    assert n > 1000 and df["widely"] > 0.02 * n
    vec = []
    for side in sides:
        raw = [(e, {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in x.items() if t in df}) for e, x in side]
        vec.append([(e, {t: w / math.sqrt(sum(v * v for v in x.values())) for t, w in x.items()}) for e, x in raw])
    post = collections.defaultdict(list)
    for g, x in vec[1]:
        for t, w in x.items():
            post[t].append((g, w))
    want = {}
    for s, x in vec[0]:
        cos = collections.Counter()
        for t, w in x.items():
            for g, v in post[t]:
                cos[g] += w * v
        best = sorted((-round(c, 9), g) for g, c in cos.items() if round(c, 9) > 0.15)[:40]
        want |= {(s, g): -c for c, g in best}
    got = {(r.s1, r.g): r.cos for r in catalogue.QUERIES["block_word_tfidf_topn"](spark, str(tmp_path)).collect()}
    words = [{e: set(x) for e, x in side} for side in sides]
    assert sum(all(df[t] > 0.02 * n for t in words[0][s] & words[1][g]) for s, g in got) > 20
    assert set(got) == set(want) and all(c == pytest.approx(want[p], abs=1e-6) for p, c in got.items())


def test_common_terms_as_a_matrix_change_no_product(monkeypatch):
    """None, some or all terms of a block as columns: a block of 30 records that 50 pass."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    rng = np.random.default_rng(6)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("country", "s1", "g", "legs", "back", "given", "cos")])

    def batch(n):
        none = pa.array([[] for _ in range(n)], pa.list_(pa.string())), pa.array([[] for _ in range(n)], pa.list_(pa.float64()))
        terms = [[f"t{t}" for t in np.flatnonzero(rng.random(12) < np.arange(12) / 12)] for _ in range(n)]
        ids = pa.array([f"{i:03}" for i in range(n)])
        return pa.RecordBatch.from_arrays([ids, ids, ids, ids, *none, pa.array(terms, pa.list_(pa.string())), pa.array([rng.random(len(t)).tolist() for t in terms], pa.list_(pa.float64()))], names=list("pqrstuvw"))

    x, y, found = batch(30), batch(50), []
    for rows, columns in ((1000, 256), (14, 256), (0, 256), (0, 3)):
        monkeypatch.setattr(vectorize, "COMMON_ROWS", rows)
        monkeypatch.setattr(vectorize, "COLUMNS", columns)
        cell = vectorize._Cell("A", [(0.05, 5)], (0.2, 2), schema)
        cell.ask(x)
        assert not list(cell.meet(y))
        found.append({(r["s1"], r["g"]): (r["legs"], r["back"], *r["cos"]) for b in cell.close() for r in b.to_pylist()})
        assert (len(cell.common[0][1]) > 0) == (rows < 1000)
    assert len(found[0]) > 100 and all(set(f) == set(found[0]) for f in found)
    assert all(f[k][:2] == found[0][k][:2] and f[k][2] == pytest.approx(found[0][k][2], abs=2e-9) for f in found for k in f)
