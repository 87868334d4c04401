"""Brute-force versions of the kernels, without Spark."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate, langid, linededup, lm, neardup, quality, tokencount, toxicity
from tidemark.llm.common import Words, byte_hashes, crc_mod_of, shingles, slices
from tidemark.llm.components import reach

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAé \n\t\x0b<|>'1中", max_size=60)), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()))
    got = [x.decode() for x in words.array().to_pylist()]
    want = [WORD.findall(t or "") for t in texts]
    assert got == sum(want, []) and words.per_doc().tolist() == list(map(len, want))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_counts(texts):
    _, at = shingles(Words(pa.array(texts, pa.string()), lower=True), 5)
    want = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want.append(len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))
    assert np.diff(at).tolist() == want


def test_slices_cover_all_rows():
    column = pa.array(["a" * n for n in (5, 0, 900, 3, 3, 3)])
    parts = list(slices(column, 8))
    assert parts[0][0] == 0 and parts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_hashes_tell_long_words_apart():
    a, b = b"x" * 200, b"x" * 199 + b"y"
    h = byte_hashes(np.frombuffer(a + b, np.uint8), np.array([0, 200, 400]))
    assert h[0] != h[1] and crc_mod_of([5, None], 10).tolist() == [zlib.crc32(b"5") % 10, 0]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_token_counts_are_the_librarys(texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokencount.vocabulary("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    texts = [*texts, "a<|endoftext|>b <|startoftext|>", "it's I'LL é ́x ΣΑΣ", "x y z"]
    want = [len(whole.encode(t or "", add_special_tokens=False)) for t in texts]
    assert tokencount.counter(path).count(pa.array(texts, pa.string())).tolist() == want


def test_language_profiles():
    docs = {"aa": ["abba baab abab"] * 3, "bb": ["xyz zyx yxz"] * 3}
    rows = []
    for lang, texts in docs.items():
        _, gram, n, _ = langid.counts([" ".join(texts)])
        _, gram, rank = langid.top(np.zeros(len(gram), int), gram, n)
        rows += [(lang, int(g), int(r)) for g, r in zip(gram, rank)]
    names, score = langid.Profiles(rows).predict(["baba", "zyx", "12 !", None, ""])
    assert names == ["aa", "bb", "und", "und", "und"] and (score[2:] == 0).all() and (score >= 0).all()
    assert langid.Profiles([]).predict(["abc"])[0] == ["und"]


def test_ngram_counts_by_hand():
    of, gram, n, has = langid.counts(["Ab!", ""])
    text = " ab "
    want = {}
    for k in (1, 2, 3):
        for i in range(len(text) - k + 1):
            g = text[i : i + k]
            if g != " ":
                code = 0
                for c in g:
                    code = code << 21 | ord(c)
                want[code] = want.get(code, 0) + 1
    assert dict(zip(gram.tolist(), n.tolist())) == want and has.tolist() == [True, False]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_edit_distance(a, b):
    assert linededup.edit_distance(a, b) == levenshtein(a, b)


def test_simhash_is_that_of_signed_grams(monkeypatch):
    """The bits are the signs of a Hadamard transform of signed counts; a text counted in pieces has the same."""
    texts = [b"", b"ab", b"abc", b"some line of text", b"x" * 90]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = linededup.simhashes(data, off)
    assert whole.shape == (5, linededup.BITS // 8) and not whole[:3].any() and whole[3:].any(1).all()
    assert (whole[3] == linededup.simhashes(np.frombuffer(texts[3], np.uint8), np.array([0, len(texts[3])]))[0]).all()
    monkeypatch.setattr(linededup, "PIECE", 7)
    assert (linededup.simhashes(data, off) == whole).all()


def test_runs_keep_keys_whole():
    rng = random.Random(4)
    for _ in range(200):
        keys = sorted(rng.choices(range(8), k=rng.randrange(0, 40)))
        cuts = sorted({0, len(keys), *(rng.randrange(len(keys) + 1) for _ in range(rng.randrange(6)))})
        batches = [pa.RecordBatch.from_arrays([pa.array([k << linededup.EXTRA | rng.randrange(9) for k in keys[a:b]], pa.int64()), pa.array(range(a, b), pa.int64())], names=["k", "i"]) for a, b in zip(cuts[:-1], cuts[1:])]
        parts = [([k >> linededup.EXTRA for k in part.column(0).to_pylist()], part.column(1).to_pylist(), hot) for part, hot in linededup.runs(iter(batches), 6)]
        assert [i for _, own, _ in parts for i in own] == list(range(len(keys)))
        many = {k for k in keys if keys.count(k) > 6}
        assert all(set(own) <= many if hot else not set(own) & many for own, _, hot in parts)
        whole = [own for own, _, hot in parts if not hot]
        assert all(not set(a) & set(b) for i, a in enumerate(whole) for b in whole[i + 1 :])


def test_reach_finds_components():
    near = {(0, 2), (2, 4), (1, 3)}
    label = reach(6, lambda i, rest: np.array([(min(i, j), max(i, j)) in near for j in rest]))
    assert label.tolist() == [0, 1, 0, 1, 0, 5]


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    other = np.concatenate([base[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)])
    values = np.concatenate([base, other])
    m = neardup.minhashes(values, np.array([0, 400, 800]), 256, 3)
    assert abs((m[0] == m[1]).mean() - 320 / 480) < 0.12


def test_regions_of_items():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    item = " ".join(word() for _ in range(40))
    index = decontaminate.Index([7, 8], [item, "tiny one"])
    filler = " ".join(word() for _ in range(200))
    edited = list(item.upper())
    for i in range(20, len(edited), 30):
        edited[i] = "z"
    texts = [f"{filler} {item} {filler}", f"{filler}, {''.join(edited)}!", filler, None, "", item[: len(item) // 2] + " " + filler, "a tiny -- ONE more"]
    found = [[x[0] for x in r] for r in index.search(pa.array(texts))]
    assert found[0] == [0] and found[1] == [0] and found[2] == [] and found[3] == [] and found[4] == [] and found[5] == [0]
    begin, end = index.search(pa.array(texts[:1]))[0][0][2][0]
    assert item[:60] in texts[0].encode()[begin:end].decode() or begin >= len(filler)


def test_alignment_against_the_table():
    rng = random.Random(2)
    for _ in range(50):
        pattern, text = ("".join(rng.choices("ab", k=n)) for n in (8, 14))
        best = min(levenshtein(pattern, text[i:j]) for i in range(15) for j in range(i, 15))
        got = decontaminate.align(np.frombuffer(text.encode(), np.uint8), 3, np.array([0, 14]), list(pattern.encode()), 14)
        assert got is None or got[0] == best or got[0] >= best


def test_ordinal_regression_orders_grades():
    rng = random.Random(3)
    texts, grade = [], []
    for _ in range(600):
        g = rng.randrange(3)
        texts.append(" ".join(rng.choices("lorem ipsum dolor sit amet".split(), k=30) + ["bad"] * (g > 0) + ["worse"] * (g > 1)))
        grade.append(g)
    from tidemark.llm.linear import listed_features

    of, feature = listed_features(Words(pa.array(texts), lower=True))
    model = toxicity.fit(of, feature, np.array(grade), 3)
    p = model.chances(of, feature, len(texts))
    assert (np.diff(model.thresholds) >= 0).all() and np.allclose(p.sum(1), 1)
    assert (p.argmax(1) == np.array(grade)).mean() > 0.95
    empty = toxicity.fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 3)
    assert empty.chances(np.zeros(0, int), np.zeros(0, int), 2) @ np.arange(3) == pytest.approx(0, abs=1e-6)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(5000) < 0.8
    votes = np.full((5000, len(quality.LABELLERS)), quality.GOOD)
    for j in range(votes.shape[1]):
        bad = np.where(good, rng.random(5000) < 0.01, rng.random(5000) < 0.5)
        votes[bad, j] = quality.BAD
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, n.astype(float))
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.97 and abs(model.share - 0.8) < 0.05


def test_network_is_a_distribution_and_learns():
    rng = random.Random(6)
    texts = [" ".join(("a b" if rng.random() < 0.5 else "c d") for _ in range(20)) for _ in range(300)]
    words = Words(pa.array(texts), lower=True)
    hashes, n = np.unique(words.hashes(), return_counts=True)
    rank = np.argsort(np.argsort(-n))
    members = np.zeros(lm.CLASSES * lm.MEMBERS)
    members[rank] = n
    members = members.reshape(lm.CLASSES, lm.MEMBERS)
    vocab = lm.Vocabulary(hashes, n, rank, np.zeros(lm.OPEN), np.zeros(lm.OPEN), np.concatenate([members.sum(1), np.zeros(lm.OPEN), [300]]), members, 300, int(n.sum()) + 300, 5)
    net = lm.Network(vocab)
    _, _, _, number, open_class = vocab.look_up(words)
    seq = lm.sequences(words, number, open_class)
    before = lm.log_chances(net, *seq).sum()
    lm.train(net, *seq[:3], lanes=8, window=16, rounds=4)
    after = lm.log_chances(net, *seq).sum()
    assert after > before * 0.75 and math.isfinite(after)  # a log chance: nearer to 0
    states = np.random.default_rng(1).normal(size=(5, lm.HIDDEN)).astype(np.float32)
    assert np.allclose(np.exp(net.classes(states)).sum(1), 1, atol=1e-4) and np.allclose(np.exp(net.members(states, 0)).sum(1), 1, atol=1e-4)
    one = lm.log_chances(net, *lm.sequences(Words(pa.array(texts[:1]), lower=True), number[:40], open_class[:40]))
    assert one[0] == pytest.approx(lm.log_chances(net, *seq)[0], rel=1e-3)
