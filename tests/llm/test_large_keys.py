"""Large keys of the Jaccard join: what parities rule out is not shipped, and no link is lost."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from gaugewise.llm import jaccard_join as jj


def test_parities_keep_every_link_and_drop_the_rest():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in rng.integers(3, 300, 150)]
    sets += [np.unique(np.concatenate((x[len(x) // 20:], rng.integers(0, 1 << 63, 1).astype(np.uint64)))) for x in sets[:40]]
    root = np.arange(len(sets))
    root[150:160] = root[:10]  # in one component already
    odd = np.array([jj.parities(x).view(np.uint64) for x in sets])
    n = np.array([len(x) for x in sets])
    for most in ((80, 100), (85, 100)):
        want = np.zeros(len(sets), bool)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                common = len(np.intersect1d(a, b))
                want[i] |= root[i] != root[j] and common * most[1] >= (len(a) + len(b) - common) * most[0]
        hit = jj.may_link(odd, n, root, most, step=7)
        assert want.sum() > 40 and (hit | ~want).all() and hit.sum() <= want.sum() + 6


def test_sets_of_a_large_key_without_a_possible_link_are_not_compared_whole(spark, monkeypatch):
    """Short texts share keys of empty segments with very many others."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(rng.randrange(9, 30))) for _ in range(500)]
    texts += [t + " more" for t in texts[:25]]
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    seen = []
    shipped = jj.linked_in_blocks

    def spy(rest, sets, most):
        seen.append(rest.count())
        return shipped(rest, sets, most)

    monkeypatch.setattr(jj, "linked_in_blocks", spy)
    monkeypatch.setattr(jj, "SMALL", 4)
    monkeypatch.setattr(jj, "BLOCK", 64)
    got = {r[0]: r[1] for r in jj.linked(docs, 2, (80, 100)).select("doc_id", "component_id").collect()}
    grams = [{tuple(t.split()[i:i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    want = {f"d{i:03d}": f"d{i:03d}" for i in range(500)}
    for i in range(25):
        common = len(grams[i] & grams[500 + i])
        want[f"d{500 + i:03d}"] = f"d{i:03d}" if common * 100 >= (len(grams[i] | grams[500 + i])) * 80 else f"d{500 + i:03d}"
    assert got == want and sum(a != b for a, b in got.items()) >= 20
    assert seen[0] < 200


def test_keys_are_dealt_in_passes(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("key"), "id")
    parts = jj.in_passes(rows, 4, "key")
    keys = [{r[0] for r in p.select("key").distinct().collect()} for p in parts]
    assert sum(map(len, keys)) == len(set().union(*keys)) == 100 and sum(p.count() for p in parts) == 1000
    assert min(map(len, keys)) > 10
