"""Connected components, in one task and in rounds over tables."""

import random

import pytest

from tidemark.llm.components import components


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_components_against_search(spark, in_one_task):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(180, 200)] + [(None, 3), (5, 5)]
    label = {}
    for a, b in [x for x in links if None not in x and x[0] != x[1]]:
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        for k in label:
            if label[k] == max(x, y):
                label[k] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "u long, v long"), in_one_task=in_one_task).collect()}
    assert got == label
