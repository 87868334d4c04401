"""Recall of the chosen-path trees, measured on pairs at the similarity bound whose nodes never become small."""

import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import neardup


def share_met(s, pairs=3000):
    """The share of pairs, each place equal with the similarity as its chance, that share a node of the last level."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (pairs, s.width)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < s.similarity, a, a ^ 1).astype(np.uint16)
    met = np.zeros(pairs, bool)
    for t in range(s.trees):
        pair, node = np.arange(pairs), np.full(pairs, neardup.mix(np.array([s.seed * 1000 + t], np.uint64))[0])
        for _ in range(s.levels):
            (x, i), (y, j) = neardup.branch(node, a[pair], s), neardup.branch(node, b[pair], s)
            assert (i == j).all()
            pair, node = np.unique(np.stack([pair[i][x == y].astype(np.uint64), x[x == y]]), axis=1)
            pair = pair.astype(np.int64)
        met[pair] = True
    return met.mean()


@pytest.mark.parametrize("levels", [4, 8])
def test_pairs_at_the_bound_meet_in_large_nodes(levels):
    s = neardup.Settings(levels=levels)
    assert share_met(s) >= s.recall - 0.01


def test_every_node_draws_a_place():
    s = neardup.Settings()
    nodes = np.concatenate([neardup.mix(np.array([s.seed * 1000 + t], np.uint64)) for t in range(s.trees)] + [neardup.mix(np.arange(500, dtype=np.uint64))])
    row = neardup.branch(nodes, np.zeros((len(nodes), s.width), np.uint16), s)[1]
    assert (np.bincount(row, minlength=len(nodes)) > 0).all()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows):
    """doc_id to component_id by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def varied(seed=4, bases=12, each=9):
    """Texts with edits, and edits of edits, that are about the bound apart; shared passages; copies; short and empty ones."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(0, None), (1, ""), (2, " Short  one"), (3, "short one"), (4, "short two")]
    for b in range(bases):
        words = [f"b{b}w{i}" for i in range(100)]
        for _ in range(each):
            if rng.random() < 0.7:
                words = words[:]
                for _ in range(rng.randrange(1, 4)):
                    words[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
            text = " ".join(words) + (" " + passage if b % 3 == 0 else "")
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("how", [{}, {"small": 8, "levels": 3}, {"small": 4, "levels": 2, "group_words": 500}])
def test_components_are_those_of_all_pairs(spark, how):
    rows = varied()
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), neardup.Settings(**how)).collect()}
    assert got == brute_force(rows)


def test_a_crowd_round_a_hub_loses_no_link(spark):
    """Each like the hub (0.836 to 0.85), none like another, in nodes that are too large to compare at once."""
    base = [f"w{j}" for j in range(125)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = base[:]
        words[(7 * i) % 121 + 2], words[(11 * i + 60) % 121 + 2] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Settings(small=32)).collect()
    assert sum(r.component_id == 0 for r in got) == 400


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{j}" for j in range(40))
    rows = [(7, text), (7, text), (None, text + " tail"), (9, "own text of another kind that is not like the others at all"), (None, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("7", "7", True), ("7", "7", True), ("None", "7", False), ("9", "9", True), ("None", "None", True)])


def test_forest_connects_what_is_close():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sketch = rng.integers(0, 3, (12, 16)).astype(np.uint16)
        root = rng.integers(0, 6, 12)
        edges, parts, things = neardup.forest(sketch, root, 8)
        near = (sketch[:, None] == sketch[None]).sum(2) >= 8
        label = {r: r for r in root}
        for i, j in itertools.combinations(range(12), 2):
            if near[i, j] and label[root[i]] != label[root[j]]:
                label = {r: (label[root[i]] if x == label[root[j]] else x) for r, x in label.items()}
        mine = {r: r for r in root}
        for i, j in edges:
            assert near[i, j] and mine[root[i]] != mine[root[j]]
            mine = {r: (mine[root[i]] if x == mine[root[j]] else x) for r, x in mine.items()}
        assert {(a, b) for a in root for b in root if label[a] == label[b]} == {(a, b) for a in root for b in root if mine[a] == mine[b]}
        assert sum(map(len, parts)) == len(edges) and len(parts) == len(things)
