"""The operators on a small table with every odd case, against brute force."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, linededup, linefreq, lm, mixing, neardup, quality, tokencount, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("word30", "other"), "en", None), (4, None, "en", "a"), (5, "", None, "b"), (6, "   \n ", "fr", "b"),
    (None, BASE + " tail", "fr", None), (8, "short one", "fr", "b"), (8, "short one", "fr", "b"), (9, "\n".join(["same line here again and again"] * 4 + ["a last line that differs from all"]), "fr", "b"),
    (10, " ".join(f"x{i}" for i in range(3000)), "en", "c"), (11, "a b c d e f a b c d e g " + " ".join(f"q{i}" for i in range(20)), "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({"kept": F.lit(1), "node": F.lit("x"), "class": F.lit(2)}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return WORD.findall(t or "")


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    size = collections.Counter()
    for _, t, _, s in ROWS:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= share * w[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: share * w[s] for s in open_}
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken in (0, r["size"], 2 * r["size"])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.emit(docs).count() == sum(r.copies for r in rows)


def test_token_counts(docs, empty):
    rows = tokencount.token_counts(docs, tokencount.vocabulary("word_bpe_49k.json")).collect()
    assert len(rows) == len(ROWS) and {(r.doc_id, r.n_tokens) for r in rows} >= {(4, 0), (5, 0), (8, 2)} and tokencount.token_counts(empty, tokencount.vocabulary("word_bpe_49k.json")).count() == 0


def repeated(w):
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)})


def test_quality_rules(docs, empty):
    rows = linefreq.judge(docs).collect()
    want = []
    for i, t, _, _ in ROWS:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * repeated(w) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeated(w), failed))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert linefreq.judge(empty).count() == 0
    lost = {r.doc_id: r.lost_words for r in linefreq.judge(docs, max_docs=1).collect()}
    assert lost[1] == lost[2] == 0  # equal texts count as one document
    cleaned = linefreq.clean(docs)
    assert cleaned.columns == docs.columns and {r.doc_id for r in cleaned.collect()} == {r.doc_id for r in rows if r.kept}


def test_frequent_lines_go(spark):
    """A line in over max_docs texts of a host goes from all but the first; a document that it leaves with too little is rejected."""
    rows = [(i, f"menu home about contact\nown text number {i} " + " ".join(f"w{i}x{k}" for k in range(20 if i else 2)), "h") for i in range(5)]
    rows += [(10, "menu home about contact\n" + " ".join(f"z{k}" for k in range(12)), "other"), (11, "Menu  home about CONTACT\n" * 1 + "menu home about contact " * 1 + "a b c d e f g", "h")]
    rows += [(12, "menu home about contact\nmenu home about contact\nx y z q", "h")]
    got = {r.doc_id: (r.lost_words, r.base_failed, r.kept) for r in linefreq.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=3, least_left=0.5).collect()}
    assert got[0][0] == 0 and all(got[i] == (4, False, True) for i in (1, 2, 3, 4)) and got[10][0] == 0 and got[12] == (8, False, False)
    cleaned = {r.doc_id: r.text for r in linefreq.clean(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, _row int"), max_docs=3, least_left=0.5).collect()}
    assert 12 not in cleaned and cleaned[1].startswith("own text") and cleaned[10].startswith("menu")


def test_mixing_twice(spark, docs):
    again = mixing.emit(mixing.emit(docs.withColumn("_row", F.lit(3))))
    assert again.columns == [*docs.columns, "_row", "copy_no"] and again.count() > 0


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert got[2].component_id == got[1].component_id == got[3].component_id == got[None].component_id == 1
    assert got[4].n_shingles == 0 and got[4].component_id == 4 and got[8].n_shingles == 1 and got[1].n_shingles == 56
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.survivors(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 4, 5, 6, 8, 9, 10, 11]))


def test_line_dedup(docs, empty):
    got = {r.doc_id: r for r in linededup.digest(docs).collect()}
    assert got[9].n_lines == 5 and got[9].dropped == [1, 2, 3] and got[2].dropped == [0] and got[1].dropped == [] and got[8].dropped == []
    assert linededup.digest(empty).count() == 0
    left = {r.doc_id: r.text for r in linededup.clean(docs).collect()}
    assert 2 not in left and left[9].count("\n") == 1 and 4 in left and 6 in left


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, BASE), (2, None), (3, "zz")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert decontaminate.matches(empty, bench).count() == decontaminate.matches(docs, bench.where("false")).count() == 0
    assert decontaminate.clean(docs, bench).count() == len(ROWS) - 4


def test_language(docs, empty):
    rows = langid.held_out_predictions(docs).collect()
    assert len(rows) == len(ROWS) and all(r.lang_pred == "und" for r in rows if r.doc_id in (4, 5, 6)) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) for r in rows) and langid.held_out_predictions(empty).count() == 0


def test_classifiers(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (10, 1, 1), (11, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, toxicity.graded(labels))
    assert toxicity.severities(docs, model).count() == len(ROWS)
    none = toxicity.learn(docs, toxicity.graded(labels.where("false")))
    assert toxicity.severities(docs, none).agg(F.max("severity")).first()[0] < 1e-6
    label_model, scorer = quality.learn(docs)
    assert quality.score(docs, scorer, label_model).count() == len(ROWS)
    label_model, scorer = quality.learn(empty)
    assert quality.score(empty, scorer, label_model).count() == 0


def test_language_model(docs, empty):
    rows = lm.score(docs).collect()
    train = [t for i, t, _, _ in ROWS if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c = collections.Counter(w.lower() for t in train for w in words(t))
    n = sum(c.values()) + len(train)
    assert len(rows) == len(ROWS) and all(r.train_tokens == n for r in rows) and all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[4] == 1 and lm.score(empty).count() == 0
