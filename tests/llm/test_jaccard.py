"""The Jaccard join against brute force, with regions that are dealt anew, blocks and hot shingles."""

from __future__ import annotations

import random
import re

import pytest

from quern.llm import jaccard


def brute(rows: list[tuple], percent: int = 75, width: int = 5) -> dict[int, tuple]:
    """(n_shingles, component_id) by row: all pairs of sets of word tuples."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[top(i)] = top(j)
    ids: dict[int, list] = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    least = {k: min([d for d in v if d is not None], default=None) for k, v in ids.items()}
    return {i: (len(sets[i]), least[top(i)]) for i in range(len(rows))}


def cloud(seed: int, families: int, members: int, words: int = 60) -> list[tuple]:
    """Families of texts at all distances: each member is a changed copy of an earlier one."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    license = " ".join(draw.choices(vocabulary, k=30))
    rows = []
    for f in range(families):
        own = [draw.choices(vocabulary, k=words)]
        for _ in range(members):
            new = list(draw.choice(own))
            for _ in range(draw.randint(0, 3)):
                at = draw.randrange(len(new))
                new[at : at + draw.randint(0, 2)] = draw.choices(vocabulary, k=draw.randint(0, 2))
            own.append(new)
        rows += [" ".join(w) + (" " + license if f % 2 else "") for w in own]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # regions are dealt anew by further pivots, in blocks
        for name, value in (("WIDE", 8), ("LEAF", 4), ("PIVOTS", 6), ("SMALL", 4), ("FEW", 0)):
            monkeypatch.setattr(jaccard, name, value)
    rows = cloud(3, 4, 16)
    rows += [(1000, None), (1001, ""), (1002, " \t "), (1003, "One two"), (1004, "one TWO"), (None, rows[0][1]), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "x"), (7, "y " * 5000)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = sorted(((d, *brute(rows)[i]) for i, (d, _) in enumerate(rows)), key=str)
    want = [(d, n, d if n == 0 else c) for d, n, c in want]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_clashing_names(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y")], "doc_id long, text string, v long, component_id string")
    assert {r.component_id for r in jaccard.near_duplicates(rows).collect()} == {1}
    assert [(r.doc_id, r.v, r.component_id) for r in jaccard.one_of_each(rows).collect()] == [(1, 1, "x")]


def test_sketches_bound_the_distance():
    draw = random.Random(1)
    import numpy as np

    for _ in range(200):
        base = np.array([draw.getrandbits(64) for _ in range(draw.randint(1, 300))], np.uint64)
        a = np.unique(base[: draw.randint(1, len(base))])
        b = np.unique(base[draw.randint(0, len(base) - 1) :])
        common = len(np.intersect1d(a, b))
        d, may = jaccard.may_link(jaccard.sketch(a), jaccard.sketch(b), len(a), len(b), 75)
        assert d <= jaccard.distance(common, len(a), len(b)) + 1e-12
        assert may or not jaccard.linked(common, len(a), len(b), 75)
