"""Regions that begin with edits."""

import random

import pyarrow as pa

from tidemark.llm import decontaminate


def test_region_with_edits_at_its_beginning():
    rng = random.Random(9)
    item = "".join(rng.choices("abcdefghijklmnop", k=200))
    region = list(item[60:140])
    for i in (9, 50):
        region[i] = "z"
    text = "".join(rng.choices("qrstuvwxy", k=100)) + "".join(region) + "".join(rng.choices("qrstuvwxy", k=100))
    assert decontaminate.Index([1], [item]).search(pa.array([text])) != [[]]
